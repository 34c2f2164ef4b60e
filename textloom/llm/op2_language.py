"""Language identification by Bayesian evidence fusion.

Text: naive Bayes over hashed byte trigrams, counted over all documents that state a language. Markup
(<html lang>) and address suffix (path segment or country domain): each one's confusion with the text's
verdict is counted over all rows and smoothed, which says how far it can be trusted. Host: languages seen
on the host, smoothed towards those of its domain, these towards all rows, each without the row itself.
The four are added as log-probabilities; everything but the trigrams is joined grouped counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import broadcast_if_small, stored, table

BUCKETS, HOST_WEIGHT, DOMAIN_WEIGHT = 1 << 14, 5.0, 20.0
#: Trigrams of a text repeat each other's evidence: all are read, but their mean log-likelihood counts as that of so many at most.
EVIDENCE = 60
#: Languages with counts of their own; where the column holds more values, those of fewer documents are counted together as OTHER.
LANGUAGES, OTHER = 500, "other"
#: Fixed: country domains that suggest a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
MARKUP = r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})"


def trigrams(text: str | None) -> np.ndarray:
    x = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(18) if len(x) > 2 else np.zeros(0, np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            np.add.at(n.setdefault(lang, np.zeros(BUCKETS, np.int64)), trigrams(text), 1)
    for lang, counts in n.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "bucket", "n"])


def pooled(docs: DataFrame, n: int) -> DataFrame:
    """docs(lang, text) with at most n languages and OTHER: those of the most documents (ties: the first by name) keep their names."""
    most = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(n + 1).collect()  # n + 1 names
    return docs if len(most) <= n else docs.withColumn("lang", F.when(F.col("lang").isin([r.lang for r in most[:n]]), F.col("lang")).otherwise(OTHER))


class TextModel:
    """log P(trigram | language); one row of BUCKETS floats per language, of which pooled() leaves a bounded number."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", languages: int = LANGUAGES):
        d = docs.select(F.lower(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
        rows = pooled(d, languages).mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
        self.langs = sorted({r.lang for r in rows}) or ["und"]
        counts = np.full((len(self.langs), BUCKETS), 0.5)
        for r in rows:  # (LANGUAGES + 1) x BUCKETS at most
            counts[self.langs.index(r.lang), r.bucket] += r.n
        self.log_p = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)

    def scored(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """rows(id columns..., text) with text replaced by text_log: a float per language."""
        table, keep = np.ascontiguousarray(self.log_p.T), [c for c in rows.columns if c != text_col]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                    t = trigrams(text)
                    s = table[t].sum(0, dtype=np.float64)
                    out.append(s * (min(1.0, EVIDENCE / len(t)) if len(t) else 0.0))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.list_(pa.float64()))], [*keep, "text_log"])

        types = dict(rows.dtypes)
        return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", text_log array<double>")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(kind, doc_id, page_id, text, declared, suffix, host, domain) of pages(page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    country = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.substring_index(host, ".", -1)]
    empty = lambda c: F.when(c != "", c)
    return pages.select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("text"),
        empty(F.lower(F.regexp_extract(html, MARKUP, 1))).alias("declared"), F.coalesce(empty(path), country).alias("suffix"), empty(host).alias("host"),
        empty(F.substring_index(host, ".", -2)).alias("domain"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """The same of documents(doc_id, text, source): the source stands for the host; there is no markup or address."""
    none = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """kind, doc_id, page_id, text_lang, declared, suffix, lang and posterior of each evidence row.

    Missing evidence (null text, markup, address, host) says nothing; a row without any goes by the languages
    of all rows. Declared languages that the model doesn't know say nothing either. Ties go to the first
    language by name. Repeated rows agree; an empty table gives no rows; further columns are not read. Counts per host
    and per domain are broadcast while there are few of them, so a hot host isn't gathered in one task."""
    langs = model.langs
    number = lambda c: F.array_position(F.array(*[F.lit(x) for x in langs]), c)  # noqa: E731  1-based, 0 if unknown
    best = lambda logs: F.array_position(logs, F.array_max(logs))
    s = stored(model.scored(rows).withColumn("first", best(F.col("text_log")).cast("int")).withColumn("d", F.coalesce(number(F.col("declared")), F.lit(0))).withColumn("u", F.coalesce(number(F.col("suffix")), F.lit(0))))
    # languages^2 numbers for each of the two.
    confusion = {c: {(r[c], r.first): r.n for r in s.where(f"{c} > 0").groupBy(c, "first").agg(F.count("*").alias("n")).collect()} for c in ("d", "u")}
    seen = [F.sum((F.col("first") == i + 1).cast("double")).alias(f"n{i}") for i in range(len(langs))]
    n = F.array(*[F.col(f"n{i}") for i in range(len(langs))])
    total = s.agg(*seen).first()
    everything = [(x or 0.0) + 1.0 for x in total]
    share = F.array(*[F.lit(x / sum(everything)) for x in everything])
    counted = lambda key: s.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_key")).agg(*seen).select(f"{key}_key", n.alias(f"{key}_n"))
    for key in ("host", "domain"):
        s = s.join(broadcast_if_small(counted(key)), F.col(key) == F.col(f"{key}_key"), "left")
    zero = F.array(*[F.lit(0.0) for _ in langs])
    own = F.transform(zero, lambda z, i: F.when(i + 1 == F.col("first"), 1.0).otherwise(0.0))
    without = lambda c: F.when(F.col(c).isNull(), zero).otherwise(F.zip_with(F.col(c), own, lambda x, y: F.greatest(x - y, F.lit(0.0))))
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    s = s.withColumn("dn", without("domain_n")).withColumn("hn", without("host_n"))
    s = s.withColumn("dt", sum_of(F.col("dn"))).withColumn("ht", sum_of(F.col("hn")))
    s = s.withColumn("dp", F.zip_with("dn", share, lambda x, p: (x + DOMAIN_WEIGHT * p) / (F.col("dt") + DOMAIN_WEIGHT)))
    s = s.withColumn("hp", F.zip_with("hn", "dp", lambda x, p: F.ln((x + HOST_WEIGHT * p) / (F.col("ht") + HOST_WEIGHT))))
    logs = F.zip_with("text_log", "hp", lambda x, y: x + y)
    for c in ("d", "u"):
        table = _trust(confusion[c], len(langs))
        logs = F.zip_with(logs, F.array(*[F.array(*[F.lit(x) for x in row]) for row in table])[F.col(c).cast("int")], lambda x, y: x + y)
    s = s.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    p = 1 / F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    name = lambda i: F.array(*[F.lit(x) for x in langs])[i.cast("int") - 1]
    return s.select("kind", "doc_id", "page_id", name(F.col("first")).alias("text_lang"), "declared", "suffix", name(best(F.col("logs"))).alias("lang"), F.round(p, 6).alias("posterior"))


def _trust(counts: dict[tuple[int, int], int], k: int) -> list[list[float]]:
    """log P(stated language | language) by stated language; row 0, for none stated, is zeros."""
    per = [sum(counts.get((s, i), 0) for s in range(1, k + 1)) for i in range(1, k + 1)]
    return [[0.0] * k] + [[math.log((counts.get((s, i), 0) + (2.0 if s == i else 0.5)) / (per[i - 1] + 1.5 + 0.5 * k)) for i in range(1, k + 1)] for s in range(1, k + 1)]


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    return identify(page_evidence(pages).unionByName(document_evidence(docs)), TextModel(docs))
