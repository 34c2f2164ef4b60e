"""Shared pieces of the operators: tables in the shared folder, connected components, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.shared import spread

#: The contracts' whitespace (space, tab to carriage return); a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where it may be unset, a temporary one takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() wrote, when nothing reads it any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for folder in folders:
        if "/stored-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; a small one in few files is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Rows up to which a table that was counted is broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Stores the table, counts it, and marks it for broadcast if it has at most so many rows; a larger one is joined by
    shuffle, where adaptive execution splits hot keys."""
    df = stored(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: crc32 of half a byte, the polynomial reversed.
CRC32_HALVES = [
    0, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes in DuckDB's SQL, which has no function for it: half bytes, lower first."""
    half = f"strpos('0123456789ABCDEF', hex({text})[i + 2 - 2 * (i % 2)]) - 1"
    step = f"xor(c >> 4, {CRC32_HALVES}[(xor(c, x) & 15) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(hex({text}))), lambda i: ({half})::BIGINT), lambda c, x: {step}), 4294967295)"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, even where body's lambdas read it often."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): returns (node, root), root the smallest node reachable.

    Each partition first reduces its edges to a spanning forest by union-find; then large-star and
    small-star rounds hook every node to its smallest neighbour until all trees are stars. Minima are
    aggregated before they are shuffled, so the minimum of a node of any degree costs its task one row per map
    task; where a node's edges meet its minimum, adaptive execution splits the partition of a hub
    (spark.sql.adaptive.skewJoin). A driver loop of at most 60 rounds looks at one boolean for each."""
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    now = stored(links.mapInArrow(_forests, "a long, b long").distinct())
    for _ in range(60):
        if _stars(now):
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
        after = stored(small.mapInArrow(_forests, "a long, b long").distinct())
        drop_stored(now)
        now = after
    raise RuntimeError("components: no fixpoint after 60 rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root and no root hangs on another."""
    up = edges.select("b", F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(edges.select(F.col("a").alias("b"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    n = up.groupBy("b").agg(F.sum("child").alias("c"), F.max("root").alias("r"))
    return n.where("c > 1 or (c = 1 and r = 1)").isEmpty()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the partition's edges, in blocks of bounded size; emits each node with its root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        pairs = [(find(x), x) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 2_000_000:
            yield out()
            parent.clear()
    yield out()


# ---- hashing of bytes and words ------------------------------------------------------------------

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2^64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for i, base in enumerate((BASE, UNBASE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def prefix_hash(x: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers of BASE before each position; spans_hash() takes differences of it."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(BYTES[x] * powers(len(x))[0], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans [start, end)."""
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """A 64-bit fingerprint for each word of the text (A-Z lower-cased), in order."""
    x = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(x):
        return np.zeros(0, np.uint64)
    if lower:
        x = LOWER[x]
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~SPACE[x]
    edge = np.diff(inside)
    return spans_hash(prefix_hash(x), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct fingerprints of the text's k-word shingles; of the whole sequence where it is shorter."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, len(w[:k]), np.uint64)
    for j in range(min(k, len(w))):
        h = mixed(h * np.uint64(BASE) + w[j : j + n])
    return np.unique(h)
