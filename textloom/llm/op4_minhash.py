"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find grouping.

SuperMinHash gives each element one permutation of the signature's slots and the ranks 0..m-1 plus a
fraction along it; slots keep their minimum. Since every rank lies above all earlier ones, an element
stops as soon as all slots are below its next rank. Steps here run over a text's elements at once.

Equal sets become one class, represented by its smallest doc_id, before anything is paired. In each
bucket of a band every class is first paired with one lead only (a star), the class that shares most
buckets over all bands, which is the text that the others were made from or near it. The pairs are
verified on the full sets and grouped. Where a bucket still holds several groups, its stragglers (those
outside its lead's group) are held against all its members, set against set, in blocks of bounded size
that tasks take one at a time. So a group of near copies costs one pair per member and lead, what a block
emits is a forest rather than its pairs, and no link that the bands find is lost."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import BASE, components, drop_stored, mixed, shingle_set, stored, table

SLOTS = 192
#: The bands are chosen so that a pair at the threshold is missed with at most this probability.
MISS = 1e-6
#: Members and set elements of one side of a block of stragglers.
BLOCK_ROWS, BLOCK_SIZE = 512, 400_000
_LOW32 = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def rows_per_band(threshold: float, slots: int = SLOTS, miss: float = MISS) -> int:
    """The most rows per band (fewest chance candidates) that keep the miss probability."""
    return max([1, *(r for r in range(1, slots + 1) if (1 - threshold**r) ** (slots // r) <= miss)])


def super_minhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a set of 64-bit elements: per slot the smallest rank (upper half) and fraction (lower half)."""
    low = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(elements), 4096):
        e = elements[start : start + 4096]
        at, order = np.arange(len(e)), np.tile(np.arange(slots, dtype=np.uint16), (len(e), 1))
        for j in range(slots):
            if low.max() < np.uint64(j << 32):
                break
            u = mixed(e + np.uint64(BASE * (j + 1) & (1 << 64) - 1))
            k = j + (((u & _LOW32) * np.uint64(slots - j)) >> _32).astype(np.int64)
            here, there = order[:, j].copy(), order[at, k]
            order[at, k], order[:, j] = here, there
            np.minimum.at(low, there, np.uint64(j << 32) | (u >> _32))
    return low


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands don't meet."""
    bands = len(signature) // rows
    h, key = signature[: bands * rows].reshape(bands, rows), np.arange(1, bands + 1, dtype=np.uint64)
    for c in range(rows):
        key = mixed(key * np.uint64(BASE) + h[:, c])
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int, rows: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands): the set's size, 128-bit digest and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, shingle)
                a, b = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s)), d1.append(a), d2.append(b)
                bands.append(band_keys(super_minhash(s), rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) whose full shingle sets meet num/den, with each pair's two texts joined to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]

        def of(text: str) -> np.ndarray:
            if last[0] != text:
                last[:] = text, shingle_set(text, shingle)
            return last[1]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                b, a = shingle_set(y, shingle), of(x)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def stragglers(shared: DataFrame, lead: DataFrame, groups: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between different groups that share a bucket of shared(key, rep, n)."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = lambda df, c: df.join(groups.select(F.col("node").alias(c), "root"), c, "left").withColumn("root", F.coalesce("root", c))
    rows = of(shared.select("key", "rep", "n"), "rep")
    heads = of(lead.select("key", F.col("lead.rep").alias("head")), "head").select("key", F.col("root").alias("head_root"))
    rows = rows.join(heads, "key").withColumn("out", F.col("root") != F.col("head_root"))
    out = F.when(F.col("out"), F.col("n"))
    # Blocks of at most about BLOCK_ROWS members and BLOCK_SIZE set elements of either side.
    blocks = lambda count, size: F.greatest(F.ceil(count / BLOCK_ROWS), F.ceil(size / BLOCK_SIZE)).cast("int")
    sizes = rows.groupBy("key").agg(blocks(F.count(out), F.sum(out)).alias("left"), blocks(F.count("n"), F.sum("n")).alias("right")).where("left > 0")
    rows = stored(rows.join(sizes, "key").select("key", "rep", "root", "out", "left", "right"))
    block = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    count = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.where("out").withColumn("i", block("left")).withColumn("j", count("right")).withColumn("side", F.lit(0))
    right = rows.withColumn("i", count("left")).withColumn("j", block("right")).withColumn("side", F.lit(1))
    dealt = left.unionByName(right).select("key", "i", "j", "side", "rep", "root").join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep").select("key", "i", "j", "side", "rep", "root", "text")
    dealt = dealt.repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "rep")
    return dealt.mapInArrow(_blocks(shingle, num, den), "a long, b long").distinct()


def _blocks(shingle: int, num: int, den: int):
    """Streams over rows sorted by block; of each block, emits a forest of the links between its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, kept = [], None, {}

        def sets(rep: int, text: str) -> np.ndarray:
            """A member stands in many buckets; its set is kept while there is room."""
            if (s := kept.get((rep, text))) is None:
                if len(kept) > 2000:
                    kept.clear()
                s = kept[rep, text] = shingle_set(text, shingle)
            return s

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    if held and now != tuple(key[i]):
                        yield _linked(held, sets, num, den)
                        held = []
                    now = tuple(key[i])
                    held.append(batch.slice(i, j - i))
        if held:
            yield _linked(held, sets, num, den)

    return run


def _linked(parts: list[pa.RecordBatch], set_of, num: int, den: int) -> pa.RecordBatch:
    side, rep, root = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (3, 4, 5))
    sets = [set_of(*x) for p in parts for x in zip(p.column(4).to_pylist(), p.column(6).to_pylist(), strict=True)]
    size = np.array([len(s) for s in sets])
    row, element = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    _, column, times = np.unique(element, return_inverse=True, return_counts=True)
    column = np.where(times[column] > 1, np.cumsum(times > 1)[column] - 1, -1)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n_left, width = int((side == 0).sum()), 2048
    both = np.zeros((n_left, len(sets) - n_left), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        has = np.zeros((len(sets), width), np.float32)
        has[row[lo:hi], column[lo:hi] - c] = 1
        both += has[:n_left] @ has[n_left:].T
    ok = den * both.astype(np.int64) >= num * (size[:n_left, None] + size[None, n_left:] - both.astype(np.int64))
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    links = []
    for i, j in np.argwhere(ok & (root[:n_left, None] != root[None, n_left:])):
        x, y = find(root[i]), find(root[n_left + j])
        if x != y:
            up[max(x, y)] = min(x, y)
            links.append((rep[i], rep[n_left + j]))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Links: den * intersection >= num * union of the sets of distinct shingle-word shingles. Texts with fewer
    words are one shingle. Null, empty and blank texts have an empty set and no links. Rows that repeat a
    doc_id with one text agree; with several texts each row goes by its own text, and the doc_id links its
    texts where it is the smallest of its classes. A row without doc_id has no links, a null component_id
    and is kept. An empty table gives no rows. Other columns are not read."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    some = d.where("doc_id is not null")
    sketch = stored(sketches(d, shingle, rows_per_band(num / den)))
    classes = stored(sketch.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(banded.join(full, "key"))
    # The texts of all that share a bucket are fetched once; what follows joins this smaller table.
    texts = stored(some.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    central = shared.groupBy("rep").agg(F.sum("size").alias("meets"))
    shared = stored(shared.join(central, "rep").select("key", "rep", "n", "meets"))
    lead = shared.groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("meets", -F.col("rep"))).alias("lead"))
    near = f"{den} * least(n, m) >= {num} * greatest(n, m)"
    star = shared.join(lead, "key").select(F.col("rep").alias("b"), "n", F.col("lead.rep").alias("a"), F.col("lead.n").alias("m")).where(f"a <> b and {near}")
    star = stored(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = stored(verified(star, texts, shingle, num, den))
    drop_stored(star)
    groups = stored(components(links))
    drop_stored(links)
    more = stored(stragglers(shared, lead, groups, texts, shingle, num, den))
    drop_stored(shared), drop_stored(texts)
    roots = _grouped(more, groups)
    # Class members take the label of their class; the label of a group is its smallest member.
    rep = classes.select("d1", "d2", "n", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("root", "rep").alias("root"))
    out = sketch.drop("bands").join(rep, ["d1", "d2", "n"], "left")
    root = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def _grouped(more: DataFrame, groups: DataFrame) -> DataFrame:
    """The groups (node, root) with those joined that the further links connect: a graph of groups, not of documents."""
    if more.isEmpty():
        return groups
    of = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    joined = stored(components(between).select(F.col("node").alias("n"), F.col("root").alias("top")))
    moved = groups.join(joined, F.col("root") == F.col("n"), "left").select("node", F.coalesce("top", "root").alias("root"))
    single = joined.join(groups, F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("top").alias("root"))
    return stored(moved.unionByName(single))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e0 AS MATERIALIZED (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
