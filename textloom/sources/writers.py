"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.corpus import letters_only
from textloom.operators.lexical import lexical_summary, top_words
from textloom.operators.shared import stored


#: Orders that a task writes at a time; beyond so many it would sort the model's rows by order.
ORDERS = ("spark.sql.maxConcurrentOutputFileWriters", "16")


def save_model(model: DataFrame, path: str) -> None:
    """A folder for each order. Tasks keep a file of each order open instead of sorting their rows by it."""
    conf = model.sparkSession.conf
    before = conf.get(ORDERS[0])
    conf.set(*ORDERS)
    try:
        model.write.mode("overwrite").partitionBy("n").parquet(path)
    finally:
        conf.set(ORDERS[0], before)


def write_lines(df: DataFrame, path: str, column: str = "value", bom: bool = False) -> None:
    """One value per line in several parts; with bom the first line of the first part begins with a byte-order mark. For
    that the rows are stored with their places, since the first partitions may be empty, and written in that order."""
    lines = df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value"))
    if bom:
        placed = stored(lines.withColumn("at", F.monotonically_increasing_id()))
        first = placed.agg(F.min("at")).first()[0]
        lines = placed.orderBy("at").select(F.when(F.col("at") == first, F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_clean_tree(records: DataFrame, path: str) -> None:
    """text by source_type and source file, as the sources were laid out, in one pass; sets of docx, txt and all are
    read back by clean_set()."""
    out = records.withColumn("source_file", F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]*$", ".clean"))
    out.select("text", "source_type", "source_file").write.mode("overwrite").partitionBy("source_type", "source_file").text(path)


def clean_set(spark: SparkSession, path: str, name: str = "all") -> DataFrame:
    """text, source_type and source_file of a tree that write_clean_tree() wrote: 'all' or one source type, whose folders alone are read."""
    tree = spark.read.schema("value string, source_type string, source_file string").text(path).withColumnRenamed("value", "text")
    return tree if name == "all" else tree.where(F.col("source_type") == name)


def write_shortcuts(shortcuts: DataFrame, path: str) -> None:
    """!key for removals, else key, tab, value."""
    line = F.when(F.col("removed"), F.concat(F.lit("!"), "key")).otherwise(F.concat_ws("\t", "key", "value"))
    shortcuts.orderBy("row_no").select(line.alias("value")).write.mode("overwrite").text(path)


def export_sources(rows: DataFrame, path: str) -> None:
    """rows(sentence, source_count, path, type, reference) in order, as corpus.source_records() or source_rows() give them."""
    letters_only(rows).orderBy("sentence", "path", "reference").write.mode("overwrite").csv(path, header=True)


def export_unique(sentences: DataFrame, path: str) -> None:
    letters_only(sentences).select("sentence", "source_count").orderBy("sentence").write.mode("overwrite").csv(path, header=True)


def export_document(rows: DataFrame, path: str) -> None:
    """Each sentence, then its sources indented, from rows as export_sources() takes them. Lines are sorted as rows, so a
    sentence of very many sources may fill any number of tasks."""
    r = letters_only(rows)
    heads = r.select("sentence").distinct().select("sentence", F.lit(0).alias("part"), F.lit("").alias("path"), F.lit("").alias("reference"), F.col("sentence").alias("value"))
    line = F.concat(F.lit("  - "), "path", F.lit(", "), "reference")
    below = r.where("path is not null").select("sentence", F.lit(1).alias("part"), "path", "reference", line.alias("value"))
    heads.unionByName(below).orderBy("sentence", "part", "path", "reference").select("value").write.mode("overwrite").text(path)


def export_lexical(counts: DataFrame, path: str, k: int = 100) -> None:
    counts = stored(counts)  # read for each of the three
    lexical_summary(counts).write.mode("overwrite").json(f"{path}/summary")
    top_words(counts, k).select(F.concat_ws("\t", "word", F.col("cnt").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/top")
    counts.select("word").orderBy("word").write.mode("overwrite").text(f"{path}/vocabulary")
