"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Each benchmark item is cut into overlapping pieces. A text that holds a piece of m characters with at most
k edits shares at least m - q + 1 - k q of its q-grams, on diagonals (text position minus piece position)
that spread by at most k. Shared q-grams are counted in diagonal bands 2k wide that overlap by half, so
such a spread lies inside one band; bands that reach the bound are verified by banded alignment.

The benchmark is the query set: it goes to the tasks in blocks of at most BLOCK_CHARS characters, each
against all texts, so what is broadcast is bounded however large the benchmark is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import MIX1, MIX2, stored, table

Q, PIECE, STRIDE, EDIT_SHARE = 12, 80, 40, 0.05
#: Normalised items below this length are matched whole and exactly, between spaces or the text's ends; decontaminate()
#: doesn't drop a document for such a short one.
MIN_ITEM = 32
BLOCK_CHARS = 4_000_000
BITS = 21
_FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x3000)], np.uint32)
_FOLD[[i for i in range(0x3000) if chr(i).isspace()]] = 32


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points, lower-cased and with runs of white space as one space, and their positions in the text."""
    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    low = x < len(_FOLD)
    x = _FOLD[x] if low.all() else np.where(low, _FOLD[np.where(low, x, 0)], x)
    space = x == 32
    keep = np.flatnonzero(~(space & np.r_[False, space[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[keep], keep


def as_text(x: np.ndarray) -> str:
    return x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit fingerprints of the q-grams of a text's characters (of their low byte; verification sees them whole)."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    b = np.ascontiguousarray((x ^ (x >> 8)).astype(np.uint8))
    eight = np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))
    n = len(b) - q + 1
    return eight[:n] * MIX1 + eight[q - 8 : q - 8 + n] * MIX2


class Index:
    """The pieces of a block of benchmark items and where their q-grams occur."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.piece, self.edits = [], [], []
        self.short: dict[str, list[int]] = {}
        for item_id, text in items:
            x, _ = normalised(text)
            x = x[1:] if len(x) and x[0] == 32 else x
            x = x[:-1] if len(x) and x[-1] == 32 else x
            if len(x) >= MIN_ITEM:
                last = max(0, len(x) - PIECE)
                for at in sorted({*range(0, last, STRIDE), last}):
                    p = x[at : at + PIECE]
                    self.item.append(item_id), self.piece.append(p)
                    self.edits.append(max(0, min(int(EDIT_SHARE * len(p)), (len(p) - Q) // Q)))
            elif len(x):
                self.short.setdefault(as_text(x), []).append(item_id)
        self.n_words = sorted({k.count(" ") + 1 for k in self.short})
        g = [grams(p) for p in self.piece]
        self.bound = np.array([len(p) - Q + 1 - k * Q for p, k in zip(self.piece, self.edits, strict=True)], np.int64)
        every = np.concatenate(g) if g else np.zeros(0, np.uint64)
        of, at = np.repeat(np.arange(len(g)), [len(x) for x in g]).astype(np.int64), np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        o = np.argsort(every, kind="stable")
        self.of, self.at = of[o], at[o]
        self.grams, first = np.unique(every[o], return_index=True)
        self.first = np.r_[first, len(every)]
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.slot(self.grams)] = True

    def whole(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of the short items that stand in x between spaces: windows of as many words are looked up."""
        if not self.short or not len(x):
            return []
        edge = np.flatnonzero(np.r_[True, x == 32, True])  # word i is between edges i and i + 1
        text, out = as_text(x), []
        for n in self.n_words:
            for a, b in zip((edge[:-n]).tolist(), (edge[n:] - 1).tolist(), strict=True):
                out += [(item, a, b) for item in self.short.get(text[a:b], ())]
        return out

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return (g * MIX1) >> np.uint64(64 - BITS)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """(piece, lowest diagonal) of the bands that reach the bound of the q-gram lemma."""
        g = grams(x)
        p = np.flatnonzero(self.seen[self.slot(g)]) if len(self.grams) else []
        if not len(p):
            return np.zeros((0, 2), np.int64)
        i = np.minimum(np.searchsorted(self.grams, g[p]), len(self.grams) - 1)
        same = self.grams[i] == g[p]
        p, i = p[same], i[same]
        n = self.first[i + 1] - self.first[i]
        hit = np.repeat(self.first[i] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        piece, diagonal = self.of[hit], np.repeat(p, n) - self.at[hit]
        step = np.maximum(1, np.asarray(self.edits)[piece])
        band = (diagonal + PIECE) // step + 1  # bands of two steps: each hit counts in the band from its own step and from the one before
        key = np.concatenate([piece * (1 << 40) + band, piece * (1 << 40) + band - 1])
        key, counts = np.unique(key, return_counts=True)
        piece = key >> 40
        ok = counts >= self.bound[piece]
        piece, band = piece[ok], key[ok] & ((1 << 40) - 1)
        return np.stack([piece, (band - 1) * np.maximum(1, np.asarray(self.edits)[piece]) - PIECE], 1)

    def align(self, x: np.ndarray, piece: int, diagonal: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the piece's best place in the band from this diagonal on; None beyond the budget."""
        p, k = self.piece[piece], self.edits[piece]
        for d in range(diagonal, diagonal + 2 * k + 1):
            if 0 <= d <= len(x) - len(p) and np.array_equal(x[d : d + len(p)], p):
                return 0, d, d + len(p)
        # Column c of row i stands for text position i + lo + c; starting anywhere in the band is free.
        lo, width = diagonal - k, 4 * k + 1
        cols, far = np.arange(width), 1 << 20
        row, start = np.where((lo + cols >= 0) & (lo + cols <= len(x)), 0, far), lo + cols
        for i, c in enumerate(p):
            at = i + lo + cols
            ok = (at >= 0) & (at < len(x))
            match = np.where(ok, row + (x[np.clip(at, 0, max(0, len(x) - 1))] != c), far)
            skip = np.r_[row[1:] + 1, far]
            new = np.minimum(match, skip)
            from_ = np.where(match <= skip, start, np.r_[start[1:], 0])
            run = np.minimum.accumulate(new - cols)
            best = np.maximum.accumulate(np.where(new - cols == run, cols, 0))
            row, start = run + cols, from_[best]
            row = np.where((at + 1 >= 0) & (at + 1 <= len(x)), row, far)
        c = int(row.argmin())
        return (int(row[c]), max(0, int(start[c])), len(p) + lo + c) if row[c] <= k else None


def _matches(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, at = normalised(text)
                found: dict[int, list[int]] = {}
                for piece, diagonal in index.candidates(x):
                    if (m := index.align(x, piece, diagonal)) is not None:
                        e, s, t = m
                        f = found.setdefault(index.item[piece], [e, s, t])
                        f[:] = min(f[0], e), min(f[1], s), max(f[2], t)
                for item, s, t in index.whole(x):
                    f = found.setdefault(item, [0, s, t])
                    f[:] = 0, min(f[1], s), max(f[2], t)
                out += [(doc_id, key, item, e, int(at[s]), int(at[t - 1]) + 1) for item, (e, s, t) in sorted(found.items())]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "row_key", "item_id", "edits", "start", "end"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, row_key, item_id, edits, start, end): one row per document row and benchmark item of which it holds a piece.

    A piece is PIECE characters of the item (the whole item where it is shorter), lower-cased and with white
    space folded, with at most EDIT_SHARE edits. edits: of the item's best piece; start and end: code points of
    the text from the first matching piece to the last. row_key is a hash of the row's id and text. Items under
    MIN_ITEM characters must stand whole, without edits and between spaces. Null and empty texts and items match
    nothing; repeated items under one id count as one; rows without an item_id are ignored; a repeated document
    gives its rows again; other columns are not read."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    b = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-(b.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    schema = "doc_id long, row_key long, item_id long, edits long, start long, end long"
    out = None
    for i in range(blocks):
        items = b.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) if blocks > 1 else b
        index = Index(sorted((r.item_id, r.text) for r in items.collect()))  # one block, about BLOCK_CHARS
        found = d.mapInArrow(_matches(index), schema)
        found = stored(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_item: int = MIN_ITEM) -> DataFrame:
    """The documents without those that hold a piece of a benchmark item of min_item characters or more; same columns,
    whatever their names. Null and empty texts stay, with or without doc_id; repeated rows go or stay together."""
    long = benchmark.where(F.length(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))) >= min_item)
    bad = matches(docs, long).select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct()
    on = (F.xxhash64(docs["doc_id"], docs["text"]) == bad["bad_key"]) & docs["doc_id"].eqNullSafe(bad["bad_id"])
    return docs.join(bad, on, "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_key")
