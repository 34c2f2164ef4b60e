"""Records to sentences with their sources, filters, and exports' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.shared import stored


#: unit_no of a document's line is its doc_id times this plus the line; a longer document is refused.
MAX_LINES = 1 << 24


def document_records(docs: DataFrame) -> DataFrame:
    """The lines of documents as records: text, source_path, source_type, reference, source_rank, unit_no; blank lines count but give none."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    line = F.when(F.col("i") < MAX_LINES - 1, F.col("i") + 1).otherwise(F.raise_error(F.lit("a document of too many lines")).cast("int"))
    return lines.where(F.trim("text") != "").select(
        "text", F.col("source").alias("source_path"), F.lit("txt").alias("source_type"), F.concat(F.lit("line "), line).alias("reference"), F.lit(0).alias("source_rank"),
        (F.col("doc_id") * MAX_LINES + line).alias("unit_no"),
    )


def exclude_meta(records: DataFrame, phrases: list[str], cleaned: Column, text: str = "text") -> DataFrame:
    """Drops records whose raw or cleaned text, lower-cased, holds one of the phrases."""
    if not phrases:
        return records
    pattern = T._quoted(p.lower() for p in phrases)
    return records.where(~(F.lower(F.coalesce(text, F.lit(""))).rlike(pattern) | F.lower(cleaned).rlike(pattern)))


def cleaned_records(records: DataFrame, rules: T.Rules = (), tone_rules: T.Rules = (), phrases: list[str] = ()) -> DataFrame:
    """records with their cleaned sentence; null and empty texts and those with a phrase give none."""
    r = records.withColumn("sentence", T.once(T.clean_text(T.strip_note_markers(F.col("text")), rules, tone_rules)))
    return exclude_meta(r, list(phrases), F.col("sentence")).where("sentence <> ''")


def _place() -> Column:
    return F.struct("source_rank", "source_path", "unit_no")


def distinct_sentences(records: DataFrame, rules: T.Rules = (), tone_rules: T.Rules = (), phrases: list[str] = ()) -> DataFrame:
    """sentence, first_rank (where it was seen first) and tokens of the distinct cleaned sentences: one shuffle, combined
    before it. What counts words or n-grams needs no more."""
    s = cleaned_records(records, rules, tone_rules, phrases).groupBy("sentence").agg(F.min(_place()).alias("first_rank"))
    return s.withColumn("tokens", T.once(T.split_words(F.col("sentence"))))


def sentence_sources(records: DataFrame, rules: T.Rules = (), tone_rules: T.Rules = (), phrases: list[str] = ()) -> DataFrame:
    """sentence, path, reference, type, at: a row for each distinct source of each sentence, so a line that very many
    documents hold is as many rows rather than one."""
    r = cleaned_records(records, rules, tone_rules, phrases)
    each = r.groupBy("sentence", F.col("source_path").alias("path"), "reference", F.col("source_type").alias("type"))
    return each.agg(F.min(_place()).alias("at"))


def sentence_table(records: DataFrame, rules: T.Rules = (), tone_rules: T.Rules = (), phrases: list[str] = (), max_sources: int = 3) -> DataFrame:
    """sentence, first_rank, tokens, sources, source_count of the distinct cleaned sentences.

    sources are the first max_sources distinct (path, reference, type) by arrival; source_count counts all, which
    source_records() lists. Tasks hand on no more than so many sources of a sentence each. The sources are stored, since
    they are read for both."""
    each = stored(sentence_sources(records, rules, tone_rules, phrases))
    first = W.partitionBy("sentence").orderBy("at", "path", "reference", "type")
    top = each.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_sources)
    top = top.groupBy("sentence").agg(F.min("at").alias("first_rank"), F.array_sort(F.collect_list(F.struct("at", "path", "reference", "type"))).alias("sources"))
    s = top.join(each.groupBy("sentence").agg(F.count("*").cast("int").alias("source_count")), "sentence")
    bare = F.transform("sources", lambda x: F.struct(x["path"].alias("path"), x["type"].alias("type"), x["reference"].alias("reference")))
    return s.select("sentence", "first_rank", T.split_words(F.col("sentence")).alias("tokens"), bare.alias("sources"), "source_count")


def source_records(records: DataFrame, rules: T.Rules = (), tone_rules: T.Rules = (), phrases: list[str] = ()) -> DataFrame:
    """sentence, source_count, path, type, reference: all sources of the sentences, a row each, none gathered into one row."""
    each = stored(sentence_sources(records, rules, tone_rules, phrases))
    counts = each.groupBy(F.col("sentence").alias("s")).agg(F.count("*").cast("int").alias("source_count"))
    return each.join(counts, F.col("sentence") == F.col("s")).select("sentence", "source_count", "path", "type", "reference")


def letters_only(sentences: DataFrame) -> DataFrame:
    return sentences.where(T.has_letter(F.col("sentence")))


def source_rows(sentences: DataFrame) -> DataFrame:
    """The sources that a sentence table lists, a row each, source columns null where there is none."""
    s = sentences.select("sentence", "source_count", F.explode_outer("sources").alias("s"))
    return s.select("sentence", "source_count", F.col("s.path").alias("path"), F.col("s.type").alias("type"), F.col("s.reference").alias("reference"))


def source_stats(rows: DataFrame) -> DataFrame:
    """Per source type, and for all (type null): unique sentences, files and references of rows(sentence, path, reference, type)."""
    stats = [F.count_distinct("sentence").alias("sentences"), F.count_distinct("path").alias("files"), F.count_distinct("path", "reference").alias("refs")]
    return rows.rollup("type").agg(*stats, F.grouping("type").alias("is_total")).where("is_total = 1 or type is not null")


def number_rows(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """1-based numbers in the given order: range-partitioned and sorted, stored with each row's place in its partition,
    then offset by the rows of the partitions before, one small row each; no single task sees all rows."""
    place = F.monotonically_increasing_id()
    s = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place))
    s = s.withColumn("__part", F.shiftright("__place", 33)).withColumn("__place", F.col("__place").bitwiseAND((1 << 33) - 1))
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    parts = s.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("n")
    return s.join(F.broadcast(parts), "__part").select(*df.columns, (F.col("__before") + F.col("__place") + 1).alias(name))
