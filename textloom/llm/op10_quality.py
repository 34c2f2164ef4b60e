"""Quality rules with adaptive thresholds, in DataFrame functions only.

Rates of symbols, repeated lines, repeated words and mean word length are gathered in mergeable
quantile sketches (log-linear histograms: exact below 16, relative bin width 1/8 above) for each
language and source. Merging is adding counts, so the sketches of a language and of the whole corpus
are sums of the finer ones, and the result doesn't depend on the order of tasks. A group of under
MIN_GROUP documents takes its language's thresholds, a small language those of the corpus.
The fences (third quartile plus SPREAD interquartile ranges plus a least width) are joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.work import WORD, let, stored, table

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MIN_GROUP, SPREAD = 100, 5
#: Metric: least width of its fence in its own unit (per mille; hundredths of a character).
WIDTH = {"symbols": 100, "dup_lines": 300, "repeats": 200, "word_length": 150}


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the list, first occurrences included."""

    def covered(grams: Column) -> Column:
        def repeated(by_gram: Column) -> Column:
            same = lambda s, other: F.coalesce(F.get(by_gram, other)["h"] == s["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(by_gram, lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(5)), F.lit(5))), F.lit(0), lambda a, b: a + b))

        by_gram = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(by_gram, repeated))

    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, 5)))
    return let(words, lambda w: F.when(F.size(w) < 5, 0).otherwise(let(grams(w), covered)))


def text_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("t"), words.alias("w"), lines.alias("l"))
    n = lambda c: c.cast("long")
    return d.select(
        "doc_id", "lang", "source", n(F.col("w.n")).alias("n_words"), n(F.length(F.translate("t", WHITE, ""))).alias("word_chars"),
        n(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"), n(F.col("l.n") - F.col("l.d")).alias("n_dup_lines"),
        n(F.col("w.r")).alias("n_repeat_words"), n(F.col("l.n")).alias("n_lines"),
    )


def metrics() -> dict[str, Column]:
    rate = lambda a, b, k: F.expr(f"{k} * {a} div greatest({b}, 1)")
    return {"symbols": rate("n_symbols", "n_words", 1000), "dup_lines": rate("n_dup_lines", "n_lines", 1000), "repeats": rate("n_repeat_words", "n_words", 1000), "word_length": rate("word_chars", "n_words", 100)}


def sketch_bin(x: Column) -> Column:
    shift = F.length(F.bin(x)) - 4
    return F.when(x < 16, x).otherwise(8 * shift + F.call_function("shiftright", x, shift))


def bin_top(b: Column) -> Column:
    """The largest value of a bin."""
    return F.when(b < 16, b).otherwise(F.call_function("shiftleft", b % 8 + 9, (F.floor(b / 8) - 1).cast("int")) - 1)


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, q1, q3) of the sketches merged to these keys. The windows run over bins, of which
    each key has a few hundred at most."""
    s = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "metric")
    s = s.withColumn("below", F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    top = bin_top(F.col("bin")).cast("long")
    at = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("all") * q, top))
    return s.groupBy(*keys, "metric").agg(F.max("all").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(measured: DataFrame) -> DataFrame:
    """For each (lang, source): a low and a high fence of every metric."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), sketch_bin(v).alias("bin")) for k, v in metrics().items()])
    s = measured.where("n_words > 0").select("lang", "source", F.inline(each)).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))
    s = stored(s)
    fine = quartiles(s, ["lang", "source"])
    lang = quartiles(s, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), *[F.col(c).alias(f"{c}_l") for c in ("n", "q1", "q3")])
    every = quartiles(s, []).select(F.col("metric").alias("m2"), *[F.col(c).alias(f"{c}_a") for c in ("q1", "q3")])
    t = fine.join(lang, F.expr("lang <=> l and metric = m")).join(every, F.expr("metric = m2"))
    pick = lambda q: F.when(F.col("n") >= MIN_GROUP, F.col(q)).when(F.col("n_l") >= MIN_GROUP, F.col(f"{q}_l")).otherwise(F.col(f"{q}_a"))
    width = F.coalesce(*[F.when(F.col("metric") == k, w) for k, w in WIDTH.items()])
    t = t.select("lang", "source", "metric", pick("q1").alias("q1"), pick("q3").alias("q3"), width.alias("w"))
    t = t.withColumn("spread", SPREAD * (F.col("q3") - F.col("q1")) + F.col("w"))
    fence = lambda k, c: F.max(F.when(F.col("metric") == k, c))
    high = [fence(k, F.col("q3") + F.col("spread")).alias(f"max_{k}") for k in WIDTH]
    return t.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*high, fence("word_length", F.col("q1") - F.col("spread")).alias("min_word_length"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: the counts, base_failed and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. Otherwise kept
    unless a metric lies outside its fence. Null and empty texts have no words and fail; null languages
    and sources are groups of their own; repeated rows count each; an empty table gives no rows.
    A value on its fence passes; texts of any length are read whole; further columns are not read."""
    d = stored(text_metrics(docs, id_col, text_col, lang_col, source_col))
    t = stored(thresholds(d))
    ok = F.lit(True)
    for k, v in metrics().items():
        ok = ok & F.coalesce(v <= F.col(f"max_{k}"), F.lit(True))
    ok = ok & F.coalesce(metrics()["word_length"] >= F.col("min_word_length"), F.lit(True))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    d = d.join(t, F.expr("lang <=> t_lang and source <=> t_source"), "left")
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ok).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("lang", "source")


def _sql_quartiles(keys: str) -> str:
    of = f"{keys}," if keys else ""
    top = "CASE WHEN bin < 16 THEN bin ELSE ((bin % 8 + 9) << (bin // 8 - 1)::INT) - 1 END"
    return f"""SELECT {of} metric, max(total) AS n, min(CASE WHEN below * 4 >= total THEN {top} END) AS q1, min(CASE WHEN below * 4 >= total * 3 THEN {top} END) AS q3
    FROM (SELECT {of} metric, bin, sum(n) OVER (PARTITION BY {of} metric ORDER BY bin) AS below, sum(n) OVER (PARTITION BY {of} metric) AS total
          FROM (SELECT {of} metric, bin, count(*) AS n FROM bins GROUP BY {of} metric, bin)) GROUP BY {of} metric"""


ORACLE_SQL = rf"""
WITH d0 AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT rid, i, list_slice(w, i, i + 4) AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d0 WHERE len(w) >= 5)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
r AS (SELECT rid, sum(k)::BIGINT AS rep FROM (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS k FROM c WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d0)
      WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
d AS MATERIALIZED (SELECT d0.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines FROM d0 LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
m AS MATERIALIZED (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS m1, 1000 * n_dup_lines // greatest(n_lines, 1) AS m2,
    1000 * n_repeat_words // greatest(n_words, 1) AS m3, 100 * word_chars // greatest(n_words, 1) AS m4 FROM d),
x AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS metric, unnest([m1, m2, m3, m4]) AS x FROM m WHERE n_words > 0),
bins AS MATERIALIZED (SELECT lang, source, metric, CASE WHEN x < 16 THEN x ELSE 8 * (length(bin(x)) - 4) + (x >> (length(bin(x)) - 4)::INT) END AS bin FROM x),
fine AS ({_sql_quartiles("lang, source")}), lng AS ({_sql_quartiles("lang")}), al AS ({_sql_quartiles("")}),
q AS (SELECT f.lang, f.source, f.metric, CASE WHEN f.n >= {MIN_GROUP} THEN f.q1 WHEN lng.n >= {MIN_GROUP} THEN lng.q1 ELSE al.q1 END AS q1,
    CASE WHEN f.n >= {MIN_GROUP} THEN f.q3 WHEN lng.n >= {MIN_GROUP} THEN lng.q3 ELSE al.q3 END AS q3,
    CASE f.metric {" ".join(f"WHEN '{k}' THEN {v}" for k, v in WIDTH.items())} END AS w
    FROM fine f JOIN lng ON f.lang IS NOT DISTINCT FROM lng.lang AND f.metric = lng.metric JOIN al ON f.metric = al.metric),
t AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{k}' THEN q3 + {SPREAD} * (q3 - q1) + w END) AS h{i}" for i, k in enumerate(WIDTH, 1))},
    max(CASE WHEN metric = 'word_length' THEN q1 - {SPREAD} * (q3 - q1) - w END) AS low FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(m1 <= h1 AND m2 <= h2 AND m3 <= h3 AND m4 <= h4 AND m4 >= low, true) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""
