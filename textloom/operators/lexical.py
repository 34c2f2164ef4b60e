"""Word statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.shared import stored


def lexical_tokens(sentences: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """word rows: right-hand sides of assignments in sentences with letters, without numbers, pointers and excluded words."""
    s = sentences.where(T.has_letter(F.col("sentence"))).select(F.explode(F.filter(F.split(T.rhs_of_assignment(F.col("sentence")), T.SPACES), lambda x: x != "")).alias("word"))
    s = s.where(T.has_letter(F.col("word")) & ~T.is_numeric_pointer(F.col("word")))
    return s if exclude is None else s.join(exclude.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("cnt"), F.max(T.is_alpha_word(F.col("word"))).alias("is_alpha"))


def lexical_summary(counts: DataFrame) -> DataFrame:
    alpha = lambda c: F.coalesce(F.sum(F.when(F.col("is_alpha"), c)), F.lit(0))
    return counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_tokens"), alpha(F.col("cnt")).alias("total_alpha_tokens"), F.count("*").alias("distinct_words"), alpha(F.lit(1)).alias("distinct_alpha_words"))


def top_words(counts: DataFrame, k: int = 100) -> DataFrame:
    return counts.orderBy(F.col("cnt").desc(), "word").limit(k)


def vocabulary(words: DataFrame) -> DataFrame:
    return words.select("word").distinct().orderBy("word")


def zipf(tokens: DataFrame) -> DataFrame:
    """lang, word, cnt, zipf for tokens(lang, word): log10 of occurrences per thousand million tokens of the language. The
    counts are stored, as the totals are sums of them."""
    n = stored(tokens.groupBy("lang", "word").agg(F.count("*").alias("cnt")))
    total = n.groupBy(F.col("lang").alias("l")).agg(F.sum("cnt").alias("total"))
    return n.join(total, F.expr("lang <=> l")).select("lang", "word", "cnt", F.log10(F.col("cnt") * 1e9 / F.col("total")).alias("zipf"))


def cloud_sizes(top: DataFrame) -> DataFrame:
    """size 16 to 48 and bar width in per cent of a top list (bounded by its limit, so one partition holds it)."""
    every = W.partitionBy()
    low, high = F.min("cnt").over(every), F.max("cnt").over(every)
    return top.select("word", "cnt", (16 + F.round((F.col("cnt") - low) / F.greatest(high - low, F.lit(1)) * 32)).cast("long").alias("size"), F.round(F.col("cnt") * 100.0 / F.greatest(high, F.lit(1)), 6).alias("width_pct"))


def vocab_diff(a: DataFrame, b: DataFrame, sample: int = 50) -> DataFrame:
    """Words of a(word) that b(word) lacks, in order, up to the sample size of the report."""
    return a.select("word").distinct().join(b.select("word").distinct(), "word", "left_anti").orderBy("word").limit(sample)


def pair_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines and tokens of two texts: (text) rows each."""
    one = lambda d, p: d.agg(F.count("*").alias(f"{p}_lines"), F.coalesce(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), T.SPACES), lambda x: x != ""))), F.lit(0)).alias(f"{p}_tokens"))
    return one(a, "original").crossJoin(one(b, "cleaned"))  # one row each


def insert_palette(values: DataFrame, limit: int = 96) -> DataFrame:
    """Distinct outputs of 1 to 4 characters, by length, then in Unicode collation, then by code point."""
    v = values.select("value").where(F.length("value").between(1, 4)).distinct()
    return v.orderBy(F.length("value"), F.collate("value", "UNICODE"), "value").limit(limit)
