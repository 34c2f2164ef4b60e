"""Readers. Everything yields rows with their provenance; order columns are explicit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.lookup import duplicates, last_wins, split_kinds
from textloom.operators.shared import broadcast_if_small, exists, stored
from textloom.sources import docx

RECORD = ["text", "source_path", "source_type", "reference", "source_rank", "unit_no"]


def _whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, content of files below path; editors' temporary files (~$...) are left out, other names aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return f.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")


def _utf8(content: Column) -> Column:
    """Bytes as UTF-8 with bad ones dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each line's place in its range; a task reads a range's lines one after the other. Lines pass through unread."""
    now, n = None, 0
    for batch in batches:
        paths, starts = batch.column(0), batch.column(1)
        size = batch.num_rows
        if not size:
            continue
        new = pc.or_(pc.not_equal(paths.slice(1), paths.slice(0, size - 1)), pc.not_equal(starts.slice(1), starts.slice(0, size - 1)))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), size]
        places = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (key := (paths[a].as_py(), starts[a].as_py())) != now:
                now, n = key, 0
            places.append(np.arange(n, n + b - a))
            n += b - a
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(places), pa.int64())], ["path", "start", "text", "place"])


def numbered_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, no (1-based) and text of all lines of files below path, blank ones too.

    Files are split into ranges of bytes. Each range's lines are counted and placed on their own, the counts of the
    ranges before are added up for each file, a row a range, and added to the places: no task reads a whole file, and
    nothing but the counts is shuffled while these are few."""
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    f = f.where(~F.element_at(F.split("_metadata.file_path", "/"), -1).startswith("~$"))
    ranges = f.groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("s")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("p").orderBy("s").rowsBetween(W.unboundedPreceding, -1))
    ranges = stored(ranges.withColumn("before", F.coalesce(before, F.lit(0))).drop("n"))
    lines = f.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    lines = lines.mapInArrow(_placed, "path string, start long, text string, place long")
    j = lines.join(broadcast_if_small(ranges), (F.col("path") == F.col("p")) & (F.col("start") == F.col("s")))
    return j.select("path", (F.col("before") + F.col("place") + 1).alias("no"), "text")


def read_lines(spark: SparkSession, path: str, source_type: str = "txt", source_rank: int = 0, bom: bool = True, glob: str = "*.txt") -> DataFrame:
    """Non-blank lines; blank ones count in 'line N', bad bytes are dropped. Files of any size are read in ranges by many
    tasks. A leading byte-order mark is dropped; without bom it stays, and since Spark's line reader always drops it,
    such files, of up to 2 GB, are read whole."""
    if bom:
        rows = numbered_lines(spark, path, glob).withColumn("text", _utf8(F.col("text")))
        rows = rows.withColumn("text", F.when(F.col("no") == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))).withColumn("i", F.col("no") - 1)
    else:
        rows = _whole(spark, path, glob).select("path", F.posexplode(F.split(_utf8(F.col("content")), "\r\n|\r|\n", -1)).alias("i", "text"))
    return _records(rows.where(T.collapse_spaces(F.col("text")) != ""), "line ", source_type, source_rank)


def _records(rows: DataFrame, word: str, source_type: str, rank: int) -> DataFrame:
    n = (F.col("i") + 1).cast("long")
    return rows.select("text", F.col("path").alias("source_path"), F.lit(source_type).alias("source_type"), F.concat(F.lit(word), n).alias("reference"), F.lit(rank).alias("source_rank"), n.alias("unit_no"))


def read_srt(spark: SparkSession, path: str, source_rank: int = 0, glob: str = "*.srt") -> DataFrame:
    """Subtitle blocks without index and time lines, joined by spaces; only blocks with text are numbered."""
    blocks = F.split(F.regexp_replace(_utf8(F.col("content")), "\r\n?", "\n"), r"\n[ \t]*\n+")

    def words(b):
        lines = F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "﻿"))
        lines = F.filter(lines, lambda x, i: ~((i == 0) & F.regexp_replace(x, "^﻿", "").rlike(r"^\d+$")))
        return F.array_join(F.filter(lines, lambda x: ~x.contains("-->")), " ")

    kept = F.filter(F.transform(blocks, words), lambda x: x != "")
    return _records(_whole(spark, path, glob).select("path", F.posexplode(kept).alias("i", "text")), "subtitle ", "srt", source_rank)


def _from_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from docx.whole_rows(path, pa.BufferReader(content.as_buffer()))


def read_docx(spark: SparkSession, path: str, source_rank: int = 0, glob: str = "*.docx") -> DataFrame:
    """Paragraphs with text, numbered over all paragraphs; files that can't be opened give no rows. Files are opened by
    the tasks that read them; in a store that only Spark can open they come as whole values."""
    if docx.can_open(path):
        return _records(docx.read_paragraphs(spark, path, glob), "paragraph ", "docx", source_rank)
    return _records(_whole(spark, path, glob).mapInArrow(_from_bytes, docx.SCHEMA), "paragraph ", "docx", source_rank)


def read_directory(spark: SparkSession, path: str, source_rank: int = 0) -> DataFrame:
    """All .txt, .docx and .srt files below path."""
    return read_lines(spark, path, "txt", source_rank).unionByName(read_docx(spark, path, source_rank)).unionByName(read_srt(spark, path, source_rank))


def read_corpus(spark: SparkSession, sources: list[str]) -> DataFrame:
    """Directories in order of priority; missing ones are empty."""
    out = None
    for rank, path in enumerate(sources):
        if exists(spark, path):
            d = read_directory(spark, path, rank)
            out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], "text string, source_path string, source_type string, reference string, source_rank int, unit_no long")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, as strings; a byte-order mark before the first name is dropped."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return d.toDF(*[c.lstrip("﻿") for c in d.columns])


def _numbered(d: DataFrame, *columns: Column) -> DataFrame:
    """The columns of a multi-line CSV's rows with file and row_no (1-based in each file). Such a file is read by one task from
    top to bottom, so a task's running number keeps the order of a file's rows; the numbers start anew in each file. The
    rows are stored with their running numbers, so these are drawn once."""
    rows = stored(d.select(*columns, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")))
    first = rows.groupBy("file").agg(F.min("at").alias("first"))
    return rows.join(first, "file").withColumn("row_no", F.col("at") - F.col("first") + 1).drop("at", "first")


def read_lexicon(spark: SparkSession, path: str, columns: list[str] = ("keyword", "audio_file")) -> DataFrame:
    """word: the first of the columns that exists and isn't blank, else the third column."""
    d = read_csv(spark, path)
    names = [c for c in columns if c in d.columns] or d.columns[2:3]
    return d.select(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names]).alias("word")).where("word is not null").distinct()


def read_asset_map(spark: SparkSession, path: str, key: str = "word", value: str = "asset_id", text: bool = False) -> DataFrame:
    """word, asset_id from CSV or from text lines "key": "value"; blank ones are left out, the last duplicate wins; raises if nothing is left."""
    if text:
        pair = r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"'
        d = _whole(spark, path, "*").select("path", F.posexplode(F.regexp_extract_all(_utf8(F.col("content")), F.lit(pair), F.lit(0))).alias("i", "m"))
        d = d.select(F.struct("path", "i").alias("row_no"), T.unescape(F.regexp_extract("m", pair, 1)).alias("word"), T.unescape(F.regexp_extract("m", pair, 2)).alias("asset_id"))
    else:
        d = _numbered(read_csv(spark, path), F.col(key).alias("word"), F.col(value).alias("asset_id")).withColumn("row_no", F.struct("file", "row_no"))
    d = d.select("row_no", F.trim(T.normalize_text(F.col("word"))).alias("word"), F.trim("asset_id").alias("asset_id")).where("word <> '' and asset_id <> ''")
    out = last_wins(d, "word", "row_no").select("word", "asset_id")
    if out.isEmpty():
        raise ValueError("no usable row")
    return out


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value, kind of a flat JSON object."""
    pairs = F.from_json(_utf8(F.col("content")), "map<string,string>")
    return split_kinds(_whole(spark, path, "*").select(F.explode(pairs).alias("key", "value")))


HEADERS = ["key", "shortcut", "source", "from"]


def read_shortcuts(spark: SparkSession, path: str, sep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(row_no, key, value, removed) and the lines that don't parse (row_no, line). Separators are tried in the order tab, =>, ->, =, ; and comma."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r\n|\n")).alias("i", "line"))
    lines = lines.select((F.col("i") + 1).alias("row_no"), F.trim("line").alias("line"), F.col("line").alias("raw")).where("line <> '' and not startswith(line, '#')")
    removed = F.col("line").startswith("!") & ~F.col("line").rlike(r"\t|=>|->|=|;|,")
    split = F.lit(None).cast("array<string>")
    for s in reversed([sep] if sep else ["\t", "=>", "->", "=", ";", ","]):
        at = F.instr("raw", s)
        split = F.when(at > 1, F.array(F.left("raw", at - 1), F.substr("raw", at + F.lit(len(s))))).otherwise(split)
    d = lines.select("row_no", "line", F.when(removed, F.trim(F.substr("line", F.lit(2)))).otherwise(F.trim(split[0])).alias("key"), F.when(~removed, F.trim(split[1])).alias("value"), removed.alias("removed"))
    header = (F.col("row_no") == 1) & F.lower("key").isin(*HEADERS)
    d = d.where(~F.coalesce(header, F.lit(False)))
    good = F.coalesce((F.col("key") != "") & (F.col("removed") | (F.col("value") != "")), F.lit(False))
    return d.where(good).select("row_no", "key", "value", "removed"), d.where(~good).select("row_no", "line")


def read_verbs(spark: SparkSession, path: str) -> DataFrame:
    """verb, gloss: the translation, else the joined French ones, else a dash."""
    d = spark.read.schema("verb string, translated_verb string, french_trans array<string>").json(path, multiLine=True)
    return d.select("verb", F.coalesce(F.nullif(F.trim("translated_verb"), F.lit("")), F.nullif(F.array_join("french_trans", ", "), F.lit("")), F.lit("—")).alias("gloss"))


def read_sheet(spark: SparkSession, path: str, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(key, value) of complete rows of an exported sheet, the last duplicate winning, and the duplicate keys with their row numbers."""
    d = _numbered(read_csv(spark, path), F.trim(F.col(f"`{key}`")).alias("key"), F.trim(F.col(f"`{value}`")).alias("value")).where("key <> '' and value <> ''")
    d = d.withColumn("row_no", F.col("row_no") + 1).withColumn("order", F.struct("file", "row_no"))  # the header is row 1
    return last_wins(d, "key", "order").select("key", "value"), duplicates(d, "key")


def load_model(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    m = spark.read.parquet(path)
    return m if n is None else m.where(F.col("n") == n)

