"""Padded n-grams and the conditional-probability table ngram(n, ctx, next, cnt, p); NULL stands for the pad."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.text import let
from textloom.operators.shared import broadcast_if_small, stored


def padded_ngrams(tokens: Column, n: int) -> Column:
    """array<struct<ctx, next>>: length + n - 1 windows over the tokens with n - 1 pads on either side; none of an empty list."""
    pad = F.array_repeat(F.lit(None).cast("string"), n - 1)
    windows = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - n + 1), lambda i: F.struct(F.slice(p, i, n - 1).alias("ctx"), F.get(p, i + n - 2).alias("next")))
    return F.when(F.size(tokens) > 0, let(F.concat(pad, tokens, pad), windows))


def ngram_counts(sentences: DataFrame, orders: range) -> DataFrame:
    """(n, ctx, next, cnt) for all orders by one aggregation, with map-side combining."""
    grams = F.flatten(F.array(*[F.transform(padded_ngrams(F.col("tokens"), n), _tag(n)) for n in orders]))
    return sentences.where(F.size("tokens") > 0).select(F.inline(grams)).groupBy("n", "ctx", "next").agg(F.count("*").alias("cnt"))


def _places(tokens: Column, max_n: int) -> Column:
    """array<struct<next, l1, l2, ...>>: for each place of the tokens what stands there and the max_n - 1 tokens before it,
    last first; NULL where there is a pad. The last of the pads after the tokens are those that order max_n ends with."""
    back = [F.concat(F.array_repeat(F.lit(None).cast("string"), k), tokens).alias(f"l{k}") for k in range(1, max_n)]
    return F.arrays_zip(tokens.alias("next"), *back)


def context_counts(sentences: DataFrame, orders: range, wanted: DataFrame) -> DataFrame:
    """ngram_counts() of the contexts in wanted(ctx) only. Places whose last tokens, as many as the shortest of these contexts
    has, end none of them are dropped before any context is made, other contexts before they are shuffled."""
    c = stored(wanted.where(F.size("ctx").between(orders[0] - 1, orders[-1] - 1)).select(F.col("ctx").alias("c")).distinct())
    sizes = sorted(r[0] for r in c.select(F.size("c")).distinct().collect()) or [orders[0] - 1]  # at most one an order
    short, longest = sizes[0], sizes[-1]
    ends = c.select(*[F.element_at("c", -k).alias(f"e{k}") for k in range(1, short + 1)])
    ends = broadcast_if_small(ends if len(sizes) == 1 else stored(ends.distinct()))
    s = sentences.where(F.size("tokens") > 0).select(T.once(F.col("tokens")).alias("tokens"))
    at = s.select(F.size("tokens").alias("size"), F.posexplode(_places(F.col("tokens"), longest + 1)).alias("at", "x")).select((F.col("at") - F.col("size") + 1).alias("over"), "x.*")
    at = at.join(ends, F.expr(" and ".join(f"l{k} <=> e{k}" for k in range(1, short + 1))), "left_semi")
    ctx = lambda k: F.array(*[F.col(f"l{i}") for i in range(k, 0, -1)]).alias("ctx")
    if len(sizes) == 1:
        grams = at.where(F.col("over") <= short).select(F.lit(short + 1).alias("n"), ctx(short), "next")
    else:
        each = F.array(*[F.when(F.col("over") <= k, F.struct(F.lit(k + 1).alias("n"), ctx(k))) for k in sizes])
        grams = at.select(F.explode(each).alias("g"), "next").where("g is not null").select("g.n", "g.ctx", "next")
        grams = grams.join(broadcast_if_small(c), F.col("ctx") == F.col("c"), "left_semi")
    return grams.groupBy("n", "ctx", "next").agg(F.count("*").alias("cnt"))


def _tag(n: int):
    return lambda g: F.struct(F.lit(n).alias("n"), g["ctx"].alias("ctx"), g["next"].alias("next"))


def with_probability(counts: DataFrame) -> DataFrame:
    """p = cnt / total of its context; the totals are a second aggregation of the counts, which are stored for that, joined
    back, so that a context with very many continuations isn't held in one task."""
    counts = stored(counts)
    total = counts.groupBy("n", F.col("ctx").alias("c")).agg(F.sum("cnt").alias("total")).withColumnRenamed("n", "m")
    return counts.join(total, F.expr("n = m and ctx = c")).select("n", "ctx", "next", "cnt", (F.col("cnt") / F.col("total")).alias("p"))


#: A gram is counted where the first words of its place are.
KEY_WORDS = 2
BREAK = "\n"


def _lines(sentences: DataFrame) -> DataFrame:
    """tokens of the sentences that have any, such that they can be joined by BREAK: one in a token becomes a backslash and n,
    a backslash one and b."""
    t = F.col("tokens")
    escaped = F.transform(t, lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit(BREAK), F.lit("\\n")))
    joined = F.array_join(t, "")
    tokens = F.when(joined.contains(BREAK) | joined.contains("\\"), escaped).otherwise(t)
    return sentences.where(F.size(t) > 0).select(T.once(tokens).alias("tokens"))


def _tokens(g: Column) -> Column:
    """The tokens of a joined gram."""
    each = F.split(g, BREAK, -1)
    back = F.transform(each, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit(BREAK)), F.lit("\\b"), F.lit("\\")))
    return F.when(g.contains("\\"), back).otherwise(each)


def _first(g: str, n: int | Column) -> Column:
    """The first n tokens of a joined gram."""
    return F.call_function("substring_index", F.col(g), F.lit(BREAK), F.lit(n))


def _windows(lines: DataFrame, m: int, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """k, w: a row for each place, its longest window, shuffled to where the place's first KEY_WORDS tokens lead. Windows are m
    tokens or those up to the sentence's end, joined by BREAK; k is made of them, so nothing else travels. part is one of so
    many parts of the keys."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ahead = [F.slice("tokens", i + 1, F.size("tokens")).alias(f"t{i}") for i in range(1, m)]
    at = lines.select(F.inline(F.arrays_zip(F.col("tokens").alias("t0"), *ahead)))
    key = F.hash(_first("w", KEY_WORDS))
    w = at.select(F.concat_ws(BREAK, *[f"t{i}" for i in range(m)]).alias("w"))
    if part[1] > 1:
        w = w.where(F.pmod(F.xxhash64(_first("w", KEY_WORDS)), F.lit(part[1])) == part[0])
    return w.repartition(parts, key).select(key.alias("k"), "w")


def _prefixes(w: str, orders: range) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("n"), _first(w, n).alias("g")) for n in orders])


def _place_counts(lines: DataFrame, orders: range) -> DataFrame:
    """(k, n, g, cnt) of the grams that begin with a token: prefixes of the windows, cut out and counted where these are."""
    distinct = _windows(lines, orders[-1]).groupBy("k", "w").agg(F.count("*").alias("c"))
    return distinct.select("k", F.inline(_prefixes("w", orders)), "c").groupBy("k", "n", "g").agg(F.sum("c").alias("cnt"))


def _start_counts(lines: DataFrame, longest: int) -> DataFrame:
    """(l, g, cnt): how many sentences begin with the l tokens of g, l up to the longest; fewer tokens are whole sentences."""
    starts = F.array(*[F.struct(F.lit(n).alias("l"), F.array_join(F.slice("tokens", 1, n), BREAK).alias("g")) for n in range(1, longest + 1)])
    return lines.select(F.inline(starts)).groupBy("l", "g").agg(F.count("*").alias("cnt"))


def _told(rows: DataFrame, *more: str) -> DataFrame:
    """rows(n, l, g, ...): ctx and next of a gram of order n that is n - l pads, the tokens of g, and pads up to its length."""
    pads = lambda k: F.array_repeat(F.lit(None).cast("string"), k)
    before = F.col("n") - F.col("l")
    ctx = let(_tokens(F.col("g")), lambda t: F.concat(pads(before), F.slice(t, 1, F.col("l") - 1), pads(F.greatest(F.col("l") - 1 - F.size(t), F.lit(0)))))
    return rows.select(*[c for c in more if c == "k"], "n", ctx.alias("ctx"), F.get(_tokens(F.col("g")), F.col("l") - 1).alias("next"), *[c for c in more if c != "k"])


def _keyed_counts(sentences: DataFrame, orders: range) -> DataFrame:
    """(k, n, ctx, next, cnt) of the grams that begin with a token."""
    return _told(_place_counts(_lines(sentences), orders).withColumn("l", F.col("n")), "k", "cnt")


def _model(sentences: DataFrame, orders: range) -> DataFrame:
    """with_probability(ngram_counts()) of the tokens, which are stored, as they are read several times.

    Grams that begin with a token are counted, and from order 3 on their contexts' totals summed, where their place's window
    was sent; a context of very many continuations goes through Spark's sort and window buffer, which spill. A pair's total
    is how often its first word occurs. Grams that begin with pads are the sentences' beginnings, the same in every order."""
    low, m = orders[0], orders[-1]
    if m <= KEY_WORDS:
        return with_probability(ngram_counts(sentences, orders))
    lines = stored(_lines(sentences), "sentences")
    total = F.sum("cnt").over(W.partitionBy("k", "n", _first("g", F.col("n") - 1)))
    out = _place_counts(lines, range(max(low, KEY_WORDS + 1), m + 1)).withColumn("total", total).withColumn("l", F.col("n"))
    out = _told(out, "cnt", "total")
    if low <= KEY_WORDS:
        pairs = _windows(lines, m).groupBy("k", _first("w", 2).alias("g")).agg(F.count("*").alias("cnt"))
        words = lines.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("total"))
        pairs = pairs.select(F.lit(2).alias("n"), F.lit(2).alias("l"), "g", "cnt").join(words, _first("g", 1) == F.col("word"))
        out = out.unionByName(_told(pairs, "cnt", "total"))
    starts = _start_counts(lines, m - 1)
    whole = _start_counts(lines, m - 2).unionByName(lines.agg(F.lit(0).alias("l"), F.lit("").alias("g"), F.count("*").alias("cnt")))
    whole = whole.select((F.col("l") + 1).alias("m"), F.col("g").alias("c"), F.col("cnt").alias("total"))
    starts = starts.join(whole, F.expr("l = m") & (_first("g", F.col("l") - 1) == F.col("c")))
    orders = F.sequence(F.greatest(F.col("l") + 1, F.lit(low)), F.lit(m))
    out = out.unionByName(_told(starts.select(F.explode(orders).alias("n"), "l", "g", "cnt", "total"), "cnt", "total"))
    return out.select("n", "ctx", "next", "cnt", (F.col("cnt") / F.col("total")).alias("p"))


def ngram_model(sentences: DataFrame, n: int) -> DataFrame:
    return _model(sentences, range(n, n + 1))


def combined_model(sentences: DataFrame, max_n: int = 5) -> DataFrame:
    return _model(sentences, range(2, max_n + 1))


def gram_number(sentences: DataFrame, max_n: int = 5) -> int:
    """How many n-grams of orders 2 to max_n the sentences hold, repeated ones each: no model of them has more rows."""
    each = sum((F.size("tokens") + (n - 1) for n in range(2, max_n + 1)), F.lit(0))
    return sentences.where(F.size("tokens") > 0).agg(F.sum(each.cast("long"))).first()[0] or 0


def context_model(sentences: DataFrame, max_n: int, wanted: DataFrame) -> DataFrame:
    """Those rows of combined_model() whose context is in wanted(ctx), with the same probabilities."""
    return with_probability(context_counts(sentences, range(2, max_n + 1), wanted))


def top_next(model: DataFrame, k: int) -> DataFrame:
    """The k likeliest continuations of each context."""
    order = W.partitionBy("n", "ctx").orderBy(F.col("p").desc(), F.col("next").asc_nulls_last())
    return model.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def model_coverage(model: DataFrame) -> DataFrame:
    """Contexts and rows per order."""
    return _per_order(model.groupBy("n", "ctx").agg(F.count("*").alias("rows")))


def _per_order(contexts: DataFrame, *more: Column) -> DataFrame:
    return contexts.groupBy("n").agg(F.count("*").alias("contexts"), F.sum("rows").alias("rows"), *more)


def coverage(sentences: DataFrame, max_n: int = 5) -> DataFrame:
    """model_coverage() of combined_model(), without counts or totals: a context of order n is a gram of order n - 1, or all
    pads. So what is counted is distinct grams, shuffled once as a row a place and cut shorter order by order in place,
    distinct words, and distinct beginnings of sentences, which are the grams that begin with pads."""
    return _coverage(stored(_lines(sentences), "sentences"), max_n)


#: Places whose windows coverage() has on disk at a time; beyond so many it reads the sentences once for each part of the keys.
PASS_PLACES = 750_000_000


def _distinct_grams(lines: DataFrame, max_n: int, part: tuple[int, int]) -> DataFrame:
    """One row u2, u3, ...: the distinct grams of each order that begin with a token of the part's keys."""
    used, grams = [], _windows(lines, max_n, part).distinct()
    for n in range(max_n - 1, KEY_WORDS - 1, -1):
        grams = grams.groupBy("k", _first("w", n).alias("w")).agg(F.count("*").alias(f"u{n + 1}"), *[F.sum(c).alias(c) for c in used])
        used.append(f"u{n + 1}")
    return grams.agg(F.count("*").alias("u2"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in used])


def _coverage(lines: DataFrame, max_n: int) -> DataFrame:
    parts = -(-(lines.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0) // PASS_PLACES)
    places = _distinct_grams(lines, max_n, (0, 1))
    if parts > 1:
        each = [stored(_distinct_grams(lines, max_n, (i, parts)), "counted") for i in range(parts)]
        places = reduce(DataFrame.unionByName, each).agg(*[F.sum(c).alias(c) for c in places.columns])
    words = lines.select(F.explode("tokens").alias("word")).distinct().agg(F.count("*").alias("u1"))
    starts = _start_counts(lines, max_n - 1).agg(*[F.count_if(F.col("l") == n).alias(f"d{n}") for n in range(1, max_n)])
    rows = {n: sum((F.col(f"d{k}") for k in range(1, n)), F.col(f"u{n}")) for n in range(1, max_n + 1)}
    each = F.array(*[F.struct(F.lit(n).alias("n"), (rows[n - 1] + 1).alias("contexts"), rows[n].alias("rows")) for n in range(2, max_n + 1)])
    return places.crossJoin(words).crossJoin(starts).where("u1 > 0").select(F.inline(each))  # one row each


def _ends(seed: list[str]) -> Column:
    return F.array(*[F.array(*[F.lit(t) for t in seed[-k:]]) for k in range(1, len(seed) + 1)])


def choose_order(model: DataFrame, seed: list[str]) -> DataFrame:
    """One row: the smallest n whose contexts hold the end of the seed, else the order with most contexts."""
    return _chosen(model.groupBy("n", "ctx").agg(F.count("*").alias("rows")), seed)


def order_for(sentences: DataFrame, seed: list[str], max_n: int = 5) -> DataFrame:
    """choose_order() of combined_model(): an end of the seed is a context if it stands in a sentence."""
    lines = stored(_lines(sentences), "sentences")
    text = F.concat(F.lit(BREAK), F.array_join("tokens", BREAK), F.lit(BREAK))
    seed = [t.replace("\\", "\\b").replace(BREAK, "\\n") for t in seed]
    ends = [F.when(text.contains(BREAK + BREAK.join(seed[-k:]) + BREAK), k + 1) for k in range(1, min(len(seed), max_n - 1) + 1)]
    fits = lines.agg(F.min(F.coalesce(*ends, F.lit(None).cast("int"))).alias("n"))
    largest = _coverage(lines, max_n).agg(F.max_by("n", F.struct("contexts", -F.col("n"))).alias("largest"))
    return fits.crossJoin(largest).select(F.coalesce("n", "largest").alias("n"))  # one row each


def _chosen(contexts: DataFrame, seed: list[str]) -> DataFrame:
    each = _per_order(contexts, F.max(F.array_contains(_ends(seed), F.col("ctx"))).alias("fits"))
    best = each.agg(F.min(F.when(F.col("fits"), F.col("n"))).alias("n"), F.max_by("n", F.struct("contexts", -F.col("n"))).alias("largest"))
    return best.select(F.coalesce("n", "largest").alias("n"))


def seed_report(model: DataFrame, sentences: DataFrame, seed: str) -> DataFrame:
    """Sentences that hold the seed and, by falling probability, the words after it, rounded to 5 places."""
    tokens = F.array(*[F.lit(t) for t in seed.split()])
    nexts = model.where(F.col("ctx") == tokens).select(F.lit("next").alias("kind"), F.coalesce("next", F.lit("")).alias("text"), F.round("p", 5).alias("p"))
    return nexts.unionByName(sentences.where(F.col("sentence").contains(seed)).select(F.lit("sentence").alias("kind"), F.col("sentence").alias("text"), F.lit(None).cast("double").alias("p")))
