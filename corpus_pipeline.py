"""The corpus pipeline: five stages, each from a table of documents to the next one's.

In all stages null and empty texts are documents without words, rows without a doc_id are kept as they are, repeated
rows share one fate (but for near duplicates, which keep one doc_id of a group with all rows of it), an empty table
gives an empty one, and further columns, whatever their names, pass through all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.op1_pii import pseudonymise
from textloom.llm.op4_minhash import near_duplicates
from textloom.llm.op7_decontaminate import decontaminate
from textloom.llm.op8_toxicity import toxicity
from textloom.llm.op9_mixing import mix
from textloom.llm.work import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model, fitted on these documents and the labels, rejects. Rows that share a
    doc_id go together if one of them is rejected; documents without a label are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = toxicity(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked at a similarity of 0.8 over five-word shingles.
    Texts without words have no links and stay."""
    dropped = near_duplicates(docs, shingle=5, num=80, den=100).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a piece of a benchmark item of 32 characters or more; see decontaminate()."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms and brings n_chars, where there is such a column, up to date."""
    out = pseudonymise(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The schedule: how many words of each document the mix takes; a null source is one of its own, empty texts are never taken."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("pii", hide_pii), ("mixing", mix_sources)]
#: The label model and the classifier can't be expressed in SQL. Tests hold the other stages against brute force, and the
#: first against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored in the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
