"""Next-word suggestions: context matching with back-off, interpolation, fallbacks, display merge, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T


def contexts(tokens: Column, max_ctx: int) -> Column:
    """array<struct<k, ctx>>: the last k tokens, from the longest allowed down to one; none of an empty list."""
    size = F.least(F.size(tokens), F.lit(max_ctx))
    return F.when(size > 0, F.transform(F.sequence(size, F.lit(1), F.lit(-1)), lambda k: F.struct(k.alias("k"), F.slice(tokens, -k, k).alias("ctx"))))


def wanted_contexts(requests: DataFrame, max_ctx: int, variants: list[str] = ("tokens",)) -> DataFrame:
    """ctx: every context that requests may look up, for ngram.context_model()."""
    levels = F.concat(*[F.coalesce(contexts(F.col(v), max_ctx), F.array().cast("array<struct<k:int,ctx:array<string>>>")) for v in variants])
    return requests.select(F.explode(F.transform(levels, lambda x: x["ctx"])).alias("ctx")).distinct()


def match_contexts(requests: DataFrame, model: DataFrame, max_ctx: int, keys: list[str] = ("request_id",)) -> DataFrame:
    """(keys, k, next, p) for every level of requests(keys, tokens) that the model holds."""
    r = requests.select(*keys, F.inline(contexts(F.col("tokens"), max_ctx)))
    m = model.select(F.col("ctx").alias("c"), "next", "p")
    return r.join(m, F.col("ctx") == F.col("c")).select(*keys, "k", "next", "p")


def longest_match(requests: DataFrame, model: DataFrame, max_ctx: int, keys: list[str] = ("request_id",)) -> DataFrame:
    """All continuations of the longest matched level only."""
    hits = match_contexts(requests, model, max_ctx, keys)
    return hits.withColumn("top", F.max("k").over(W.partitionBy(*keys))).where("k = top").drop("top")


#: Weights from the longest level to the shortest, by number of levels and whether the longest is sparse.
WEIGHTS = {(1, False): [1.0], (1, True): [1.0], (2, True): [0.55, 0.45], (2, False): [0.62, 0.38], (3, True): [0.12, 0.28, 0.60], (3, False): [0.45, 0.35, 0.20]}
SPARSE = 4


def interpolated(requests: DataFrame, model: DataFrame, max_ctx: int, keys: list[str] = ("request_id",)) -> DataFrame:
    """(keys, word, score, k): the weighted sum over the levels that have a continuation; end-of-sentence mass is left out."""
    hits = match_contexts(requests, model, max_ctx, keys).where("next is not null")
    by = W.partitionBy(*keys)
    hits = hits.withColumn("level", F.dense_rank().over(by.orderBy(F.col("k").desc())))
    hits = hits.withColumn("levels", F.max("level").over(by)).withColumn("sparse", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(by) <= SPARSE)
    hits = hits.withColumn("top_k", F.max("k").over(by))
    weight = None
    for (n, sparse), w in WEIGHTS.items():
        for i, x in enumerate(w):
            on = (F.col("levels") == n) & (F.col("sparse") == sparse) & (F.col("level") == i + 1)
            weight = F.when(on, x) if weight is None else weight.when(on, x)
    half = F.pow(F.lit(0.5), F.col("level") - 1) / (2 * (1 - F.pow(F.lit(0.5), F.col("levels"))))
    return hits.withColumn("w", weight.otherwise(half)).groupBy(*keys, F.col("next").alias("word")).agg(F.sum(F.col("w") * F.col("p")).alias("score"), F.max("top_k").alias("k"))


def first_attempt(attempts: list[DataFrame], keys: list[str] = ("request_id",)) -> DataFrame:
    """For each request the rows of the first attempt that has any."""
    every = None
    for i, a in enumerate(attempts):
        a = a.withColumn("attempt", F.lit(i))
        every = a if every is None else every.unionByName(a)
    return every.withColumn("least", F.min("attempt").over(W.partitionBy(*keys))).where("attempt = least").drop("least")


def match_with_fallback(requests: DataFrame, model: DataFrame, max_ctx: int, variants: list[str], keys: list[str] = ("request_id",)) -> DataFrame:
    """Interpolated scores by the first of the token columns named in variants that matches anything."""
    return first_attempt([interpolated(requests.select(*keys, F.col(v).alias("tokens")), model, max_ctx, keys) for v in variants], keys)


def display_merge(scores: DataFrame, keys: list[str] = ("request_id",), rules: T.Rules = ()) -> DataFrame:
    """Scores of words with one cleaned form are added."""
    clean = T.clean_text(F.col("word"), rules)
    return scores.withColumn("word", clean).where("word <> ''").groupBy(*keys, "word").agg(F.sum("score").alias("score"))


def hygiene(scores: DataFrame, requests: DataFrame, pair: tuple[str, str] = ("n", "b"), keys: list[str] = ("request_id",)) -> DataFrame:
    """Drops punctuation-only words, and the second of the pair where it is the only word after the first alone."""
    s = scores.where(~T.is_punct(F.col("word"))).join(requests.select(*keys, (F.col("tokens") == F.array(F.lit(pair[0]))).alias("lone")), list(keys), "left")
    s = s.withColumn("n", F.count("*").over(W.partitionBy(*keys)))
    return s.where(~(F.coalesce("lone", F.lit(False)) & (F.col("word") == pair[1]) & (F.col("n") == 1))).drop("lone", "n")


def ranked(scores: DataFrame, limit: int, keys: list[str] = ("request_id",)) -> DataFrame:
    """The best words per request: score (to 9 places), then more non-ASCII characters, then the word."""
    order = W.partitionBy(*keys).orderBy(F.round("score", 9).desc(), T.non_ascii_count(F.col("word")).desc(), "word")
    return scores.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(limit)}")


def suggest(requests: DataFrame, model: DataFrame, limit: int = 6, max_ctx: int = 4, variants: list[str] = ("tokens",), rules: T.Rules = ()) -> DataFrame:
    """request_id, word, score, rank for requests(request_id, tokens, ...)."""
    s = match_with_fallback(requests, model, max_ctx, list(variants)).select("request_id", "word", "score")
    return ranked(hygiene(display_merge(s, rules=rules), requests), limit)
