"""Nested reshaping: parallel lists, wide tables, required keys, quotas, pattern spans."""

from __future__ import annotations

import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.operators.corpus import number_rows
from textloom.operators.shared import BROADCAST_ROWS, broadcast_if_small, stored

DASH = "—"


def zip_lists(df: DataFrame, lists: list[str], keys: list[str]) -> DataFrame:
    """keys, row_no (1-based) and one column per list; shorter lists are padded with a dash, all-empty gives one row of dashes."""
    zipped = F.arrays_zip(*[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists])
    z = df.select(*keys, F.posexplode_outer(zipped).alias("i", "x"))
    return z.select(*keys, (F.coalesce("i", F.lit(0)) + 1).alias("row_no"), *[F.coalesce(F.col("x")[c], F.lit(DASH)).alias(c) for c in lists])


def group_tenses(rows: DataFrame, mapping: DataFrame, headers: list[str]) -> DataFrame:
    """rows(verb, tense, row_no, value) by mapping(tense, grp, header) to one column per header, aligned by row_no."""
    j = rows.join(mapping, "tense")
    return j.groupBy("verb", "grp", "row_no").pivot("header", headers).agg(F.min("value"))


def missing_keys(rows: DataFrame, required: DataFrame, entity: str, key: str) -> DataFrame:
    """entity, key: required keys that an entity lacks; a null entity is one of its own, null keys aren't required.

    Required keys are numbered. An entity's are the bits of as many words as it takes, set before the shuffle, and only
    the bits that are left open become rows, so what is put out is what is missing. An entity of any number of rows costs
    one row a task and word."""
    want = required.select(F.col(key).alias("__key")).where("__key is not null").distinct()
    want = stored(number_rows(want, "__key", name="__no").withColumn("__no", F.col("__no") - 1))
    n = want.count()
    whole = (n + 63) // 64
    known = rows.select(entity, F.col(key).alias("__key")).join(broadcast_if_small(want), "__key", "left")
    word, bit = F.shiftright("__no", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__no").bitwiseAND(63).cast("int"))
    words = known.groupBy(entity, word.alias("__word")).agg(F.bit_or(F.when(F.col("__no").isNotNull(), bit)).alias("__bits"))
    each = words.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.when(F.col("__word").isNotNull(), F.struct("__word", "__bits")))).alias("__has"))
    full = lambda w: F.when(w == whole - 1, F.lit(((1 << (n - 64 * (whole - 1))) - 1) if n % 64 else -1).cast("long")).otherwise(F.lit(-1).cast("long"))
    lacks = lambda w: F.struct(w.alias("w"), full(w).bitwiseAND(F.bitwise_not(F.coalesce(F.col("__has")[w], F.lit(0).cast("long")))).alias("b"))
    open_ = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(whole - 1).cast("long")), lacks), lambda x: x["b"] != 0)
    gaps = each.select(entity, F.explode(open_ if n else F.array().cast("array<struct<w:bigint,b:bigint>>")).alias("x"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("x.b"), i) == 1)
    gaps = gaps.select(entity, F.explode(bits).alias("i"), F.col("x.w").alias("w")).select(entity, (F.col("w") * 64 + F.col("i")).alias("__no"))
    return gaps.join(broadcast_if_small(want), "__no").select(entity, F.col("__key").alias(key))


def take_quota(items: DataFrame, quotas: list[tuple[str, int]], text: str = "name", order: str = "item_id") -> DataFrame:
    """items with quota (its number) and rank: each quota in turn takes its first n items, by a unique order, that start
    with its prefix and that no earlier quota took.

    Items meet the quotas by an equi-join of their beginnings with the prefixes. A quota can lose no more items to earlier
    ones than these may take, so it looks at that many and its own first ones only, which tasks cut off before the
    shuffle. Then all items ask at once for the first quota on their list, each quota keeps its first n, and those put off
    ask for their next one, until none is: what the quotas would take in turn, in rounds that follow how deep prefixes
    nest and not how many quotas there are."""
    spark = items.sparkSession
    sizes = sorted({len(p) for p, _ in quotas})
    reach = _reach(quotas)
    table = spark.createDataFrame([(i, p, n, reach[i]) for i, (p, n) in enumerate(quotas)], "quota int, __prefix string, __n long, __reach long")
    table = F.broadcast(table) if len(quotas) <= BROADCAST_ROWS else table
    begins = F.filter(F.transform(F.array(*[F.lit(k) for k in sizes]), lambda k: F.when(F.length(text) >= k, F.left(text, k))), lambda x: x.isNotNull())
    asks = items.select(F.col(order).alias("__item"), F.explode(begins).alias("__prefix")).join(table, "__prefix")
    asks = asks.withColumn("__place", F.row_number().over(W.partitionBy("quota").orderBy("__item"))).where("__place <= __reach")
    state = stored(asks.groupBy("__item").agg(F.array_sort(F.collect_list(F.struct("quota", "__n"))).alias("__list")).withColumn("__at", F.lit(0)))
    while True:
        asking = state.select("*", F.get("__list", F.col("__at")).alias("q")).where("q is not null").select("*", "q.quota", "q.__n")
        held = asking.withColumn("rank", F.row_number().over(W.partitionBy("quota").orderBy("__item")))
        after = stored(held.select("__item", "__list", (F.col("__at") + F.when(F.col("rank") > F.col("__n"), 1).otherwise(0)).alias("__at"), "quota", "rank", (F.col("rank") > F.col("__n")).alias("__off")))
        if after.where("__off").isEmpty():
            taken = after.select("__item", "quota", "rank")
            return items.join(broadcast_if_small(taken), F.col(order) == F.col("__item")).drop("__item")
        state = after.select("__item", "__list", "__at")


def _reach(quotas: list[tuple[str, int]]) -> list[int]:
    """For each quota its own number and those of the earlier ones whose prefixes begin with its prefix or begin it; by
    sums over the prefixes' own beginnings and over the quotas below them."""
    below, at, out = {}, {}, []
    for p, n in quotas:
        out.append(n + below.get(p, 0) + sum(at.get(p[:k], 0) for k in range(len(p))))
        at[p] = at.get(p, 0) + n
        for k in range(len(p) + 1):
            below[p[:k]] = below.get(p[:k], 0) + n
    return out


SPANS = "array<struct<start:int,end:int,found:string>>"


def claimed_spans(c: Column, patterns: list[str]) -> Column:
    """array<struct<start, end, found>> (code points, 0-based, end exclusive) by claims: the longest pattern first, of equal
    ones that first in code-point order, takes its places from the left, wherever none of them is taken; then the next
    pattern. The spans are in order of their start; null texts give null, empty patterns match nothing.

    All patterns are found in one pass over the text (an automaton of their common beginnings). A span that is no longer
    than those taken before it meets one of them with its first or last character, so a claim is settled by two looks."""
    ordered = sorted({p for p in patterns if p}, key=lambda p: (-len(p), p))

    @F.arrow_udf(SPANS)
    def run(x: pa.Array) -> pa.Array:
        find = ahocorasick.Automaton()
        for i, p in enumerate(ordered):
            find.add_word(p, i)
        find.make_automaton()
        out = []
        for text in x.to_pylist():
            if text is None or not ordered:
                out.append(None if text is None else [])
                continue
            hits = sorted((i, end + 1 - len(ordered[i])) for end, i in find.iter(text))
            taken, spans = bytearray(len(text)), []
            for i, start in hits:
                size = len(ordered[i])
                if not (taken[start] or taken[start + size - 1]):
                    taken[start : start + size] = b"\x01" * size
                    spans.append({"start": start, "end": start + size, "found": ordered[i]})
            out.append(sorted(spans, key=lambda s: s["start"]))
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("found", pa.string())])))

    return run(c)


def with_stripped(patterns: list[str], mark: str = "̀") -> list[str]:
    """The patterns and, of those with the mark, their forms without it, for texts that may have been stripped of it."""
    bare = [unicodedata.normalize("NFC", unicodedata.normalize("NFD", p).replace(mark, "")) for p in patterns]
    return list(dict.fromkeys([*patterns, *bare]))


def marker_spans(c: Column, patterns: list[str]) -> Column:
    """array<struct<start, end, found>> (0-based, end exclusive) of patterns that stand between word boundaries, from the
    left, the longest one first at each place; patterns that overlap others are for claimed_spans()."""
    quoted = "|".join(r"\Q" + p + r"\E" for p in sorted(set(patterns), key=lambda p: (-len(p), p)))
    pattern = rf"(?U)(?<!\w)(?:{quoted})(?!\w)"
    none = F.array().cast(SPANS)

    def spans(x: Column) -> Column:
        """Starts are sums of the lengths before; each element is visited once."""
        step = lambda s, y: F.struct((s["at"] + y["gap"] + y["size"]).alias("at"), F.array_append(s["starts"], s["at"] + y["gap"]).alias("starts"))
        parts = F.zip_with(x["found"], x["gaps"], lambda f, g: F.struct(F.coalesce(F.length(f), F.lit(0)).alias("size"), F.length(g).alias("gap")))
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step, lambda s: s["starts"])
        return F.transform(F.arrays_zip(F.slice(starts, 1, F.size(x["found"])).alias("start"), x["found"].alias("found")), lambda z: F.struct(z["start"].alias("start"), (z["start"] + F.length(z["found"])).alias("end"), z["found"].alias("found")))

    both = F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"), F.split(c, pattern, -1).alias("gaps"))
    return let(both, lambda x: F.when(F.size(x["found"]) > 0, spans(x)).otherwise(none))
