"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched and encoded; ids are decoded to raw bytes.

A text of more than STEP characters is cut into chunks that start every STEP characters and overlap by OVERLAP. All chunks
are dealt to all tasks and pre-tokenised, each from its own start, so the first boundaries of a chunk may be none of the
whole text. But where a pre-token begins, only what follows decides where it ends: once two neighbours share a boundary in
their overlap, they agree from there on, and the seam is put at the first one they share. Only boundaries after a visible
character count, since the pattern looks past the end of white space, and those near the end of a chunk don't, since more
text might move them. Between two seams a chunk's ids hold. Neighbours that share no boundary (a run of letters longer than
the overlap) are decoded, joined and encoded as one. A text of one chunk has no seams and is encoded where it is, without
a shuffle; of longer ones the chunks are shuffled once as text and once, to meet again, as ids."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.work import table

#: Characters between the starts of a text's chunks, and how far a chunk reaches into the next one.
STEP, OVERLAP = 16_384, 512
#: Characters after a pre-token that may decide where it ends.
AHEAD = 3
#: Pre-tokens of up to so many characters whose ids a task remembers, and how many of them.
SHORT, REMEMBERED = 48, 200_000


class Coder:
    """Ranks and pattern of a vocabulary; the ids of common pre-tokens are remembered."""

    def __init__(self, ranks: bytes, pattern: str):
        rank_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.merges = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rank_of, special_tokens={})
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in rank_of.items()}
        self.narrow = max(self.bytes_of) < 1 << 16
        self.known: dict[str, bytes] = {}

    def pieces(self, words: list[str]) -> list[bytes]:
        """For each pre-token its ids as little-endian 32-bit integers."""
        out, known = [], self.known
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = b"".join(i.to_bytes(4, "little") for i in self.merges.encode_ordinary(w))
                if len(w) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return out

    def encoded(self, text: str | None) -> bytes:
        return b"".join(self.pieces(self.find(text))) if text else b""

    def packed(self, ids: bytes) -> bytes:
        """Half as many bytes, where ids of two are enough."""
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.narrow else ids

    def unpacked(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if self.narrow else ids

    def decoded(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""

    def seams(self, text: str, at: int, last: bool, step: int, overlap: int) -> tuple[bytes, list[dict], list[dict]]:
        """The ids of the whole chunk and, as place in the whole text and offset in the ids, its boundaries in the overlap
        with the chunk before and in that with the one after. at: where the chunk starts."""
        words = self.find(text)
        ids = self.pieces(words)
        places = zip(accumulate(map(len, words), initial=0), accumulate(map(len, ids), initial=0), strict=True)
        known = [(p, o) for p, o in places if (p <= overlap or p >= step) and (last or p <= len(text) - AHEAD) and (not p or not text[p - 1].isspace())]
        of = lambda ps: [{"at": at + p, "off": o} for p, o in ps]
        return b"".join(ids), of(x for x in known if x[0] <= overlap), of(x for x in known if x[0] >= step)

    def stitched(self, parts: list[dict]) -> bytes:
        """The ids of a whole text from all of its chunks, in order."""
        out, run, begin = [], [], {"at": 0, "off": 0}
        for x, y in zip(parts, [*parts[1:], None], strict=True):
            head = {} if y is None else {p["at"]: p for p in y["head"]}
            end = next((p for p in x["tail"] if p["at"] in head), None)
            run.append(x)
            if end or y is None:
                if len(run) == 1:
                    out.append(x["ids"][begin["off"] : end["off"] if end else None])
                else:
                    # Up to the next chunk's start each chunk's text counts, of the last one all.
                    text = "".join(self.text(p["ids"])[: q["at"] - p["at"]] for p, q in zip(run, run[1:], strict=False)) + self.text(x["ids"])
                    out.append(self.encoded(text[begin["at"] - run[0]["at"] : end["at"] - run[0]["at"] if end else None]))
                run, begin = [], head[end["at"]] if end else None
        return b"".join(out)

    def text(self, ids: bytes) -> str:
        return self.decoded(ids).decode()


class Vocabulary:
    """A file of ranks, read once on the driver and sent to the tasks."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks: Broadcast = spark.sparkContext.broadcast((f.read(), pattern))

    def coder(self) -> Coder:
        return _coder(*self.ranks.value)


@lru_cache(2)
def _coder(ranks: bytes, pattern: str) -> Coder:
    return Coder(ranks, pattern)


def encoded(text: Column, vocabulary: Vocabulary) -> Column:
    """The ids of whole texts, packed as little-endian 32-bit integers; null and empty texts have none."""

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        coder = vocabulary.coder()
        return pa.array([coder.encoded(t) for t in x.to_pylist()], pa.binary())

    return run(text)


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The raw bytes of packed ids; null gives none. An id that the vocabulary lacks is an error."""

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        coder = vocabulary.coder()
        return pa.array([coder.decoded(i) for i in x.to_pylist()], pa.binary())

    return run(ids)


def chunks(texts: DataFrame, step: int, overlap: int) -> DataFrame:
    """row, i, id, at, last, chunk of texts(row, id, text), a chunk a row; the id stands in a text's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for lot in range(0, len(text), 64 * step):
                    at = list(range(lot, min(lot + 64 * step, len(text)), step))
                    ids = pa.concat_arrays([batch.column(1).slice(k, 0 if lot else 1), pa.nulls(len(at) - (not lot), batch.column(1).type)])
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([row] * len(at), pa.int64()), "i": pa.array([a // step for a in at], pa.int64()), "id": ids, "at": pa.array(at, pa.int64()),
                        "last": pa.array([a + step >= len(text) for a in at]), "chunk": pa.array([text[a : a + step + overlap] for a in at], pa.string()),
                    })

    return texts.mapInArrow(run, f"row long, i long, id {texts.schema['id'].dataType.simpleString()}, at long, last boolean, chunk string")


PLACES = "array<struct<at:long,off:long>>"


def pretokenised(cut: DataFrame, vocabulary: Vocabulary, step: int, overlap: int) -> DataFrame:
    """chunks() with ids (of as few bytes each as the vocabulary needs) in place of the text, and the boundaries in either overlap."""
    place = pa.list_(pa.struct([("at", pa.int64()), ("off", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            got = [coder.seams(c, a, e, step, overlap) for c, a, e in zip(*(batch.column(x).to_pylist() for x in ("chunk", "at", "last")), strict=True)]
            cols = [pa.array([coder.packed(g[0]) for g in got], pa.binary()), *(pa.array([g[k] for g in got], place) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], ["row", "i", "id", "at", "ids", "head", "tail"])

    return cut.mapInArrow(run, f"row long, i long, id {cut.schema['id'].dataType.simpleString()}, at long, ids binary, head {PLACES}, tail {PLACES}")


def stitched(parts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """id, ids of each text whose chunks are parts; a text's chunks meet in one row, as the text did."""

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        coder = vocabulary.coder()
        return pa.array([coder.stitched([p | {"ids": coder.unpacked(p["ids"])} for p in parts]) for parts in x.to_pylist()], pa.binary())

    g = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "at", "id", "ids", "head", "tail"))).alias("x"))
    bare = F.transform("x", lambda p: F.struct(p["at"].alias("at"), p["ids"].alias("ids"), p["head"].alias("head"), p["tail"].alias("tail")))
    return g.select(F.col("x")[0]["id"].alias("id"), run(bare).alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """id_col and ids, the packed ids of each row's text; a row for each row.

    Null, empty and, as each row stands for itself, repeated rows and rows without an id are encoded like any others; an
    empty table gives no rows. Very long texts are cut and dealt to all tasks, whatever they consist of. Other columns,
    whatever their names, are not read. Nothing is ordered by a key, so there are no ties."""
    if not AHEAD < overlap <= step:
        raise ValueError("an overlap is longer than what decides a boundary and no longer than the step")
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    is_long = F.coalesce(F.length("text") > step, F.lit(False))
    short = d.where(~is_long).select("id", encoded(F.col("text"), vocabulary).alias("ids"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = d.where(is_long).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    cut = chunks(long, step, overlap).repartition(n, F.xxhash64("row", "i"))
    done = stitched(pretokenised(cut, vocabulary, step, overlap), vocabulary)
    return short.unionByName(done).withColumnRenamed("id", id_col)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    d = encode(table(spark, sf_dir, "documents"), vocabulary)
    out = d.withColumn("decoded", decoded(F.col("ids"), vocabulary))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
