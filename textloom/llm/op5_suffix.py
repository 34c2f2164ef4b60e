"""Exact repeated passages across documents, by bucket-pointer refinement of sampled suffixes.

Suffixes are first bucketed by the q-gram that has the smallest fingerprint in their 50-byte string;
neighbouring suffixes with one such gram form a run, so about one suffix in 17 stands for all. Two filters
narrow the buckets: equal regions (all that a run covers) settle copies, and an 8-bit code of what each quarter
of a run's suffixes has in common drops quarters that nothing else in the bucket can equal.

What is left is refined bucket by bucket on the bytes themselves: suffixes are ranked by their q-gram, the
buckets are sorted on the identifiers of the bucket q further on, which gives every position an updated
identifier of its 2q-gram, and these are reused: buckets that several documents still share are sorted on the
updated identifier at offset 50 - 2q. Strings of one last bucket are compared byte by byte with its first.

Tasks resolve what they can before the shuffle: of equal regions seen by one task only those of its
smallest doc_id are sent on, so a passage that a third of all documents share costs each bucket one
entry per map task. A run's suffixes stay together, so what leaves a bucket is one row for each run or
range of suffixes, however many partitions there are. Nothing is capped or sampled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import drop_stored, prefix_hash, spans_hash, stored, table

LENGTH, GRAM = 50, 16
#: Runs that a task gathers before it sends them, and window bytes that are refined at once.
FLUSH, WINDOW_BYTES = 500_000, 1_000_000
#: Buckets for each shuffle partition: a task holds one of them at a time.
SPLIT = 8
#: Suffixes of a run: its length is kept in 8 bits.
LONGEST = 256
#: The 8-bit code of a quarter that may equal any other's.
WILD = 255
_48, _32, _24, _8 = (np.uint64((1 << b) - 1) for b in (48, 32, 24, 8))
#: Widths in bytes of an entry's keys: bucket gram and quarter codes; region, span and place of the gram.
WIDTHS = (7, 8)


def quarters(rest: int = LENGTH - GRAM) -> list[tuple[int, int, int, int]]:
    """Suffixes by the characters before their gram: from, to (exclusive), and how much all of them hold on its left and right."""
    cut = [0, rest // 4, rest // 2, rest - rest // 4, rest + 1]
    return [(cut[i], cut[i + 1], cut[i], rest - cut[i + 1] + 1) for i in range(4)]


def suffix_spans(first: np.ndarray, last: np.ndarray, gram: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix of each run that lies in the quarters of its bits (whole runs where the gram is before their last suffix)."""
    low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), -1, np.int64)
    for i, (begin, end, _, _) in enumerate(quarters()):
        a, b = np.maximum(first, gram - end + 1), np.minimum(last, gram - begin)
        some = ((bits >> i) & 1 > 0) & (a <= b)
        low, high = np.where(some, np.minimum(low, a), low), np.where(some, np.maximum(high, b), high)
    wild = last > gram
    return np.where(wild, first, low), np.where(wild, last, high)


class Runs:
    """Suffix runs of one text: first and last start, the bucket gram's fingerprint and place, the region's fingerprint, and codes of the quarters."""

    def __init__(self, x: np.ndarray, length: int = LENGTH, q: int = GRAM):
        n = len(x) - length + 1
        prefix = prefix_hash(x)
        at = np.arange(len(x) - q + 1)
        grams = low = spans_hash(prefix, at, at + q)
        width, span = length - q + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        # A gram that comes back within every window would make one run of a whole periodic passage: cut to what a key can hold.
        pieces = -(-np.diff(np.r_[first, n]) // LONGEST)
        first = np.repeat(first, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        self.first, self.last = first, np.r_[first[1:], n] - 1
        self.bucket = low[first]
        self.region = spans_hash(prefix, first, self.last + length)
        # Where the gram stands; each suffix of the run holds it there unless it occurs twice (then the codes are WILD).
        self.gram = first + grams[first[:, None] + np.arange(width)].argmin(1)
        wild = self.last > self.gram
        self.sides = np.zeros(len(first), np.uint64)
        for i, (low, high, left, right) in enumerate(quarters(length - q)):
            some = (self.gram - self.last < high) & (self.gram - first >= low)
            at, end = np.where(some, self.gram - left, 0), np.where(some, self.gram + q + right, 0)
            code = np.where(some, spans_hash(prefix, at, end) % np.uint64(WILD - 1) + np.uint64(1), np.uint64(0))
            self.sides |= np.where(wild, np.uint64(WILD), code) << np.uint64(8 * i)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The two keys of an entry; a run's length and its gram's place are relative to its first suffix and below 256."""
        span, gram = (self.last - self.first).astype(np.uint64), (self.gram - self.first).astype(np.uint64)
        return (self.bucket & _24) << np.uint64(32) | self.sides, self.region & _48 | span << np.uint64(48) | gram << np.uint64(56)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def packed(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view("<u8").ravel()


class Entries:
    """Columns of bucket entries: two keys, the run's first suffix, and an index into the documents' ids and row keys."""

    def __init__(self):
        self.parts, self.docs, self.size = [], [], 0

    def add(self, runs: Runs, buckets: int, doc: tuple[int, int]) -> None:
        bucket = (runs.bucket >> np.uint64(24)) % np.uint64(buckets)
        self.parts.append((*runs.keys(), runs.first.astype(np.uint32), np.full(len(runs.first), len(self.docs), np.int32), bucket.astype(np.int32)))
        self.docs.append(doc)
        self.size += len(runs.first)

    def columns(self) -> tuple[np.ndarray, ...]:
        k1, k2, number, d, *bucket = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.bucket = bucket[0] if bucket else None
        return k1, k2, number, d, np.array(self.docs, np.int64).reshape(-1, 2)

    def add_packed(self, data: bytes) -> None:
        n, m, wide = np.frombuffer(data, np.int64, 3).tolist()
        view, at = memoryview(data), 24
        take = lambda size: (view[at : at + size], at + size)
        part, at = take(8 * m)
        ids = np.frombuffer(part, np.int64)
        part, at = take(4 * m)
        docs = np.stack([ids, np.frombuffer(part, np.int32)], 1)
        part, at = take(4 * m)
        counts = np.frombuffer(part, np.uint32)
        part, at = take(wide * n)
        number = np.cumsum(np.frombuffer(part, f"<u{wide}").astype(np.int64))
        first = np.cumsum(counts, dtype=np.int64) - counts
        number = (number - np.repeat(np.r_[0, number[first[1:] - 1]], counts)).astype(np.uint32)
        part, at = take(WIDTHS[0] * n)
        k1 = unpacked(part, n, WIDTHS[0])
        part, at = take(WIDTHS[1] * n)
        self.parts.append((k1, unpacked(part, n, WIDTHS[1]), number, np.repeat(np.arange(len(self.docs), len(self.docs) + m, dtype=np.int32), counts)))
        self.docs.extend(map(tuple, docs.tolist()))
        self.size += n

    def bucketed(self, rows: np.ndarray, cols: tuple) -> Iterator[tuple[int, bytes]]:
        k1, k2, number, d, docs = cols
        rows = rows[np.lexsort((number[rows], d[rows], self.bucket[rows]))]
        b = self.bucket[rows]
        edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            r = rows[i:j]
            first = np.flatnonzero(np.r_[True, d[r][1:] != d[r][:-1]])
            counts = np.diff(np.r_[first, len(r)]).astype(np.uint32)
            delta = np.diff(number[r].astype(np.int64), prepend=0)
            delta[first] = number[r][first]
            wide = 4 if len(r) and delta.max() > 65535 else 2
            head = np.array([len(r), len(first), wide], np.int64).tobytes() + docs[d[r][first], 0].tobytes() + docs[d[r][first], 1].astype(np.int32).tobytes() + counts.tobytes()
            yield int(b[i]), head + delta.astype(f"<u{wide}").tobytes() + packed(k1[r], WIDTHS[0]) + packed(k2[r], WIDTHS[1])


def lowest(k1: np.ndarray, k2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts by (k1, k2, id); returns the order, and in that order where a class (k1, k2) begins and its smallest id."""
    o = np.lexsort((ids, k2, k1))
    new = np.r_[True, (k1[o][1:] != k1[o][:-1]) | (k2[o][1:] != k2[o][:-1])]
    return o, new, ids[o][np.flatnonzero(new)][np.cumsum(new) - 1]


def span_of(k2: np.ndarray) -> np.ndarray:
    return ((k2 >> np.uint64(48)) & _8).astype(np.int64)


SPANS = "doc_id long, row_key long, first int, last int, gram long"
KIND = f"bucket int, payload binary, {SPANS}"
NAMES = ["bucket", "payload", "doc_id", "row_key", "first", "last", "gram"]


def spans_batch(d: np.ndarray, first: np.ndarray, last: np.ndarray, docs: np.ndarray, gram: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of SPANS, ordered by document; gram is the bucket that refines the suffixes, null if they are settled hits."""
    o = np.lexsort((first, d))
    ids = docs[d[o]]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(first[o].astype(np.int32)), pa.array(last[o].astype(np.int32)), pa.nulls(len(o), pa.int64()) if gram is None else pa.array(gram[o])], NAMES[2:]
    )


def kept_back(spans: pa.RecordBatch) -> pa.RecordBatch:
    """Settled spans among the entries, dealt by document."""
    n = spans.num_rows
    return pa.RecordBatch.from_arrays([pa.array((spans.column(1).to_numpy() & 0x3FFFFFFF).astype(np.int32)), pa.nulls(n, pa.binary()), *spans.columns], NAMES)


def asked(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(found)
    empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary()), *empty], NAMES)


def _sent(e: Entries) -> Iterator[pa.RecordBatch]:
    """What a task has gathered: entries of classes' smallest documents go to their buckets, all others are hits."""
    if e.size:
        cols = e.columns()
        k1, k2, number, d, docs = cols
        o, _, low = lowest(k1, k2, docs[d, 0])
        hit = docs[d[o], 0] > low
        h = o[hit]
        yield kept_back(spans_batch(d[h], number[h].astype(np.int64), number[h] + span_of(k2[h]), docs))
        yield asked(list(e.bucketed(o[~hit], cols)))


def _initial(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Entries()
        for batch in batches:
            for i, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = as_bytes(text)
                if len(x) >= LENGTH:
                    e.add(Runs(x), buckets, (i, key))
                if e.size >= FLUSH:
                    yield from _sent(e)
                    e = Entries()
        yield from _sent(e)

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | tuple[int, Entries]]:
    """Passes settled spans on and gives each bucket's entries together; rows come sorted by bucket."""
    now, e = None, Entries()
    for batch in batches:
        ready = batch.filter(pc.is_null(batch.column(1)))
        if ready.num_rows:
            yield ready
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if x is not None:
                if b != now and e.size:
                    yield now, e
                    e = Entries()
                now = b
                e.add_packed(x)
    if e.size:
        yield now, e


def _refine_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans out: a run whose region occurs in an earlier document is a hit, another one's suffixes that a mate
    in the bucket may equal are to be refined."""
    for each in by_bucket(batches):
        if isinstance(each, pa.RecordBatch):
            yield each.select(NAMES[2:])
            continue
        bucket, e = each
        k1, k2, number, d, docs = e.columns()
        gram = k1 >> np.uint64(32)
        o = np.argsort(gram, kind="stable")
        new = np.r_[True, gram[o][1:] != gram[o][:-1]]
        shared = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        o = o[shared]
        if not len(o):
            continue
        p, new, low = lowest(k1[o], k2[o], docs[d[o], 0])
        o = o[p]
        ids, of = docs[d[o], 0], np.cumsum(new) - 1  # the class of each entry
        start = np.r_[True, gram[o][1:] != gram[o][:-1]]
        first = np.flatnonzero(start)
        several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        group = (np.cumsum(start) - 1)[new]  # the gram of each class
        sides = k1[o][new] & _32
        wild = (np.bincount(group, (sides & _8) == WILD) > 0)[group] & (np.bincount(group)[group] > 1)
        mate = np.zeros(len(group), np.int64)
        for i in range(4):
            side = (sides >> np.uint64(8 * i)) & _8
            _, at, n = np.unique(group.astype(np.uint64) << np.uint64(8) | side, return_inverse=True, return_counts=True)
            mate += (((((n[at] > 1) & (side > 0)) | wild) & several[group]).astype(np.int64)) << i
        hit = ids > low
        begin = number[o].astype(np.int64)
        end = begin + span_of(k2[o])
        yield spans_batch(d[o[hit]], begin[hit], end[hit], docs)
        r = ~hit & (mate[of] > 0)
        low, high = suffix_spans(begin[r], end[r], begin[r] + (k2[o[r]] >> np.uint64(56)).astype(np.int64), mate[of][r])
        some = high >= low
        yield spans_batch(d[o[r]][some], low[some], high[some], docs, (bucket << 24 | gram[o[r]].astype(np.int64))[some])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc_id, row_key, first, bytes): what the suffixes to be refined cover, of doc_id, row_key, text and lists of first, last and gram."""
    for batch in batches:
        rows = []
        for i, key, text, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = (text or "").encode("utf-8", "surrogatepass")
            rows += [(g, i, key, a, x[a : b + LENGTH]) for a, b, g in zip(*lists, strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["gram", "doc_id", "row_key", "first", "window"])


def refined(x: np.ndarray, at: np.ndarray, ids: np.ndarray, q: int = GRAM, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of the length-byte strings of x at these places, those that documents share, and for each of them its last bucket."""
    places = np.arange(len(x) - q + 1)
    bucket = np.unique(spans_hash(prefix_hash(x), places, places + q), return_inverse=True)[1].astype(np.uint64)
    # Sorted on the bucket q further on: identifiers of 2q-grams, which the next refinement looks up at a later offset.
    bucket = np.unique(bucket[:-q] << np.uint64(32) | bucket[q:], return_inverse=True)[1].astype(np.uint64)
    left = np.flatnonzero(_shared(bucket[at], ids))
    bucket = np.unique(bucket[at[left]] << np.uint64(32) | bucket[at[left] + length - 2 * q], return_inverse=True)[1]
    some = _shared(bucket, ids[left])
    left, bucket = left[some], bucket[some]
    head = np.zeros(len(at) + 1, np.int64)
    head[bucket[::-1]] = at[left][::-1]
    words = np.ndarray((len(x) - 7,), "<u8", np.ascontiguousarray(x), strides=(1,))
    same = np.ones(len(left), bool)
    for off in [*range(0, length - 8, 8), length - 8]:
        same &= words[at[left] + off] == words[head[bucket] + off]
    if not same.all():  # grams with equal fingerprints: the bytes decide
        bucket = np.unique(np.lib.stride_tricks.sliding_window_view(x, length)[at[left]], axis=0, return_inverse=True)[1].ravel()
    return left, bucket


def _shared(bucket: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether several documents have suffixes in the bucket of each."""
    if not len(bucket):
        return np.zeros(0, bool)
    o = np.argsort(bucket, kind="stable")
    new = np.r_[True, bucket[o][1:] != bucket[o][:-1]]
    first = np.flatnonzero(new)
    out = np.empty(len(o), bool)
    out[o] = (np.minimum.reduceat(ids[o], first) < np.maximum.reduceat(ids[o], first))[np.cumsum(new) - 1]
    return out


def _hits(t: pa.Table) -> pa.RecordBatch:
    """Spans of the suffixes in these windows that an earlier document holds too."""
    ids, keys, first = (t.column(i).to_numpy() for i in (1, 2, 3))
    text = t.column(4).combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    size = pc.binary_length(text).to_numpy().astype(np.int64)
    x = np.frombuffer(b"".join(text.to_pylist()), np.uint8)
    n = size - LENGTH + 1
    window = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left, bucket = refined(x, (np.cumsum(size) - size)[window] + inside, ids[window])
    low = np.full(int(bucket.max()) + 1 if len(bucket) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, bucket, ids[window[left]])
    left = np.sort(left[ids[window[left]] > low[bucket]])
    w, at = window[left], inside[left]
    begin = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (at[1:] > at[:-1] + 1)]) if len(w) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(w)][: len(begin)] - 1
    return spans_batch(w[begin], first[w[begin]] + at[begin], first[w[begin]] + at[end], np.stack([ids, keys], 1))


def _refine_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Refines whole buckets, as many at a time as make up WINDOW_BYTES; rows come sorted by gram."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(4).nbytes
        if size >= WINDOW_BYTES:
            t = pa.Table.from_batches(held)
            gram = t.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last bucket may go on
            if cut:
                yield _hits(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            size = sum(b.column(4).nbytes for b in held) if cut else 0
    if held:
        yield _hits(pa.Table.from_batches(held))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, removed, spans, sha = [], [], [], []
        for text, first, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            x = as_bytes(text)
            if first:
                step = np.zeros(len(x) + 1, np.int32)
                np.add.at(step, np.asarray(first, np.int64), 1)
                np.add.at(step, np.asarray(last, np.int64) + LENGTH, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                sha.append(hashlib.sha256(x[~gone].tobytes()).hexdigest())
            else:
                removed.append(0), spans.append(0), sha.append(hashlib.sha256(x.tobytes()).hexdigest())
            n_bytes.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def region_spans(d: DataFrame, buckets: int, n: int) -> DataFrame:
    """SPANS of d(doc_id, row_key, text): settled hits (gram null) and suffixes that are still to be refined."""
    entries = d.mapInArrow(_initial(buckets), KIND).withColumn("part", F.pmod("bucket", F.lit(n)))
    return entries.repartitionById(n, "part").drop("part").sortWithinPartitions("bucket").mapInArrow(_refine_regions, SPANS)


def suffix_hits(d: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """SPANS of the hits among the suffixes that region_spans() left to be refined."""
    todo = spans.where("gram is not null").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "last", "gram")).alias("s"))
    todo = d.join(todo, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "s.first", "s.last", "s.gram")
    windows = todo.mapInArrow(_windows, "gram long, doc_id long, row_key long, first int, window binary")
    return windows.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_refine_suffixes, SPANS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, text, first, last): for each row the suffixes, as lists of first and last ones, that start a string
    of LENGTH bytes which also starts in a document with a smaller doc_id. The lists are null where there are none.

    Null texts are empty. Rows that share a doc_id don't count as earlier for each other and are judged each
    on its own. Rows without doc_id neither lose anything nor count as earlier. Other columns are not read."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    d = d.withColumn("row_key", F.xxhash64("doc_id", "text").bitwiseAND(0x7FFFFFFF)).select("doc_id", "row_key", "text")
    spans = stored(region_spans(d, SPLIT * n, n))
    hits = spans.where("gram is null").unionByName(suffix_hits(d, spans, n))
    hits = hits.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "last")).alias("h"))
    return d.join(hits, ["doc_id", "row_key"], "left").select("doc_id", "row_key", "text", "h.first", "h.last")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; see repeated_spans() for null ids and repeated rows."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    d = repeated_spans(docs, id_col, text_col).select("doc_id", "text", "first", "last")
    none = F.lit(None).cast("array<int>")
    rest = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), none.alias("first"), none.alias("last"))
    return d.mapInArrow(_digests, schema).unionByName(rest.mapInArrow(_digests, schema))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
