"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points map through the cumulative target shares, which gives every slot of the mix a
source such that each prefix of the schedule is close to the targets. Points are integers modulo 2^48, so
they keep all their bits at any number of slots. Slots are ranked per source and joined to that source's
equal-token blocks of documents in shuffled order; the blocks repeat once all are used. A block's size goes
by its source: about a BLOCKS-th of it, from MIN_BLOCK to MAX_BLOCK words, and the least that keeps the number
of blocks, so small sources aren't charged for words that their last block lacks and large ones don't need
a slot for every few words. A source's slots are its target over its block size. Ranks and block offsets
come from two-level prefix sums (per chunk, then inside a chunk), so no source, however large, is ordered in
one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.work import WORD, stored, table

#: The fractional part of the golden ratio in units of 2^-48, rounded to an odd number.
GOLDEN, UNIT = 173961102589771, 1 << 48
WEIGHTS, MAX_REPEATS, CHUNK = (5, 2, 1), 3, 4096
MIN_BLOCK, MAX_BLOCK, BLOCKS = 32, 4096, 4096
#: Documents that a chunk of a source's shuffled order should have at most, if it held all of them.
CHUNK_ROWS = 1_000_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_no, source_size, target) for sizes(source, size); one row per source, null included.

    Target: the level x weight of the source, at most max_repeats times its size, with the one level at
    which the targets sum to all sizes. The windows run over one row per source, not over documents."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("source_no", F.row_number().over(order)).withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_repeats))
    by = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("all_size", F.sum("source_size").over(W.partitionBy()))
    level = (F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # The first source that its level doesn't fill sets the level of all after it.
    s = s.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return s.select("source", "source_no", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds size, source_size, target and taken to (id, source) of every row.

    Null and blank texts have size 0 and are never taken; a null source is a source of its own, the last.
    Repeated rows count as documents of their own; rows of one id go by size, those of one size are alike. Further
    columns are not read, texts of any length are counted whole. An empty table gives no rows. No document is taken
    more than max_repeats times: a source whose target is
    max_repeats times its size gets it to the word, any other one up to the schedule's discrepancy and
    what its last block lacks, under one block for each repetition."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = stored(d)
    rows = d.count()
    targets = stored(source_targets(d, weights, max_repeats))
    t = targets.withColumn("block", block_words())
    total = t.agg(F.sum(F.col("target") / F.col("block"))).first()[0] or 0.0
    slots = slot_counts(spark, t, int(-(-total // 1)), max_repeats)
    t = t.select(F.col("source").alias("s"), "source_no", "source_size", "target", "block")
    d = d.join(F.broadcast(t) if t.limit(10_001).count() <= 10_000 else t, F.expr("source <=> s")).drop("s")
    laid = stored(_offsets(d, rows))
    # A source whose target is its cap repeats whole, each document max_repeats times, so it needs no slots.
    capped = F.col("target") >= max_repeats * F.col("source_size")
    pieces = laid.where("size > 0").where(~capped).withColumn("block_no", F.explode(F.sequence(F.expr("start div block"), F.expr("(start + size - 1) div block"))))
    part = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block")) - F.greatest("start", F.col("block_no") * F.col("block"))
    taken = pieces.withColumn("part", part).join(slots, ["source_no", "block_no"]).groupBy("source_no", "row_key", "start").agg(F.sum(F.col("part") * F.col("times")).alias("taken"))
    out = laid.where("size > 0").join(taken, ["source_no", "row_key", "start"], "left").unionByName(laid.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(capped, max_repeats * F.col("size")).otherwise(F.coalesce("taken", F.lit(0))).cast("long").alias("taken"))


def block_words() -> Column:
    """Words in a block of a source: source_size over the number of blocks of the wanted size, rounded up."""
    wanted = F.greatest(F.lit(MIN_BLOCK), F.least(F.lit(MAX_BLOCK), F.expr(f"source_size div {BLOCKS}")))
    n = F.greatest(F.ceil(F.col("source_size") / wanted), F.lit(1))
    return F.greatest(F.ceil(F.col("source_size") / n), F.lit(1)).cast("long")


def _offsets(d: DataFrame, rows: int) -> DataFrame:
    """start: tokens of the source before the document, in the order of md5(doc_id), which shuffles each source; its
    first digits make the chunks, more of them where there are more rows."""
    digits = max(3, math.ceil(math.log(max(1, rows / CHUNK_ROWS), 16)))
    d = d.withColumn("row_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    d = d.withColumn("chunk", F.substring("row_key", 1, digits))
    inside = W.partitionBy("source_no", "chunk").orderBy("row_key", "size").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy("source_no", "chunk").agg(F.sum("size").alias("chunk_size"))
    sums = sums.withColumn("base", F.coalesce(F.sum("chunk_size").over(W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(sums.select("source_no", "chunk", "base"), ["source_no", "chunk"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within", "chunk")


def slot_schedule(spark: SparkSession, targets: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source_no): the slot's golden-ratio point falls into the source's part of [0, 1)."""
    by = W.orderBy("source_no")
    total = F.sum("share").over(W.partitionBy())
    parts = targets.where("target > 0").withColumn("share", F.col("target") / F.col("block"))
    parts = parts.withColumn("high", F.sum("share").over(by.rowsBetween(W.unboundedPreceding, 0)) / total)
    parts = parts.withColumn("low", F.coalesce(F.lag("high").over(by), F.lit(0.0))).withColumn("high", F.when(F.lead("high").over(by).isNull(), 1.0).otherwise(F.col("high")))
    # Each source's points lie in one range of [0, 1): both sides are cut into 1024 cells and joined by cell.
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * 1024), F.least(F.floor(F.col("high") * 1024), F.lit(1023)))))
    # slot * GOLDEN modulo UNIT, by 15 bits of the slot at a time, so that no product overflows; exact below 2^45 slots.
    digit = lambda i: F.call_function("shiftright", F.col("slot"), F.lit(15 * i)).bitwiseAND(F.lit((1 << 15) - 1)) * F.lit((GOLDEN << 15 * i) % UNIT) % UNIT
    point = ((digit(0) + digit(1) + digit(2)) % UNIT) / float(UNIT)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * 1024))
    return slots.join(parts.select("cell", "low", "high", "source_no", "source_size", "block"), "cell").where("point >= low and point < high").select("slot", "source_no", "source_size", "block")


def slot_counts(spark: SparkSession, targets: DataFrame, n_slots: int, max_repeats: int) -> DataFrame:
    """(source_no, block_no, times): ranks each source's slots and gives slot rank r the block r modulo blocks."""
    s = slot_schedule(spark, targets, n_slots).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    sums = s.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("slot")) - 1)
    s = s.join(sums.select("source_no", "chunk", "base"), ["source_no", "chunk"]).withColumn("rank", F.col("base") + F.col("rank"))
    s = s.withColumn("blocks", F.expr("(source_size + block - 1) div block")).where(f"rank < {max_repeats} * blocks")
    return s.groupBy("source_no", F.expr("rank % blocks").alias("block_no")).agg(F.count("*").alias("times"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS row_key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS source_no FROM d GROUP BY source),
s1 AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], (source_no - 1) % 3 + 1) AS weight, source_size * 3.0::DOUBLE AS cap,
    sum(source_size) OVER ()::DOUBLE AS all_size FROM s0),
s2 AS (SELECT *, (all_size - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS)
    OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM s2),
t0 AS (SELECT source, source_no, source_size, coalesce(least(cap, lv * weight), cap) AS target, greatest({MIN_BLOCK}, least({MAX_BLOCK}, source_size // {BLOCKS})) AS wanted FROM s3),
t AS MATERIALIZED (SELECT *, greatest(ceil(source_size / greatest(ceil(source_size / wanted), 1)), 1)::BIGINT AS block FROM t0),
p0 AS (SELECT *, sum(target / block) OVER (ORDER BY source_no ROWS UNBOUNDED PRECEDING) / sum(target / block) OVER () AS high FROM t WHERE target > 0),
p AS (SELECT source_no, source_size, block, coalesce(lag(high) OVER (ORDER BY source_no), 0.0) AS low,
    CASE WHEN lead(high) OVER (ORDER BY source_no) IS NULL THEN 1.0 ELSE high END AS high FROM p0),
slots AS (SELECT slot, source_no, source_size, block, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rnk
    FROM (SELECT range AS slot, (range::HUGEINT * {GOLDEN} % {UNIT})::DOUBLE / {UNIT} AS point
          FROM range((SELECT ceil(sum(target / block))::BIGINT FROM t))) JOIN p ON point >= low AND point < high),
blocks AS (SELECT source_no, rnk % ((source_size + block - 1) // block) AS block_no, count(*) AS times FROM slots
    WHERE rnk < {MAX_REPEATS} * ((source_size + block - 1) // block) GROUP BY 1, 2),
laid AS MATERIALIZED (SELECT d.*, t.source_no, t.source_size, t.target, t.block, coalesce(sum(size) OVER (PARTITION BY t.source_no ORDER BY row_key, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER () AS rid FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
pieces AS (SELECT rid, source_no, size, block, start, unnest(range(start // block, (start + size - 1) // block + 1)) AS block_no FROM laid WHERE size > 0),
taken AS (SELECT rid, sum((least(start + size, (block_no + 1) * pieces.block) - greatest(start, block_no * pieces.block)) * times)::BIGINT AS taken
    FROM pieces JOIN blocks USING (source_no, block_no) GROUP BY rid)
SELECT doc_id, size, source_size, target, CASE WHEN target >= {MAX_REPEATS} * source_size THEN {MAX_REPEATS} * size ELSE coalesce(taken, 0) END::BIGINT AS taken FROM laid LEFT JOIN taken USING (rid)
"""
