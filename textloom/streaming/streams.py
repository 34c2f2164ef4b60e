"""Streams: language filter, incremental n-gram counts, debounce, suggestions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from textloom.functions import text as T
from textloom.operators import ngram, predict, segment
from textloom.operators.shared import children, delete, exists, modified, stored
from textloom.sources import readers, writers


def _batches(source: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_keep_language(spark: SparkSession, src: str, dst: str, checkpoint: str, lexicon: DataFrame, settings: segment.Settings = segment.Settings(), files_per_batch: int = 1000) -> StreamingQuery:
    """Lines of text files to their target-language text, equal lines each on its own; each batch overwrites its own folder,
    so a retried batch isn't written twice."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(src)

    def each(df: DataFrame, batch: int) -> None:
        # Stored, so that a row's number is the same wherever the filter reads it.
        rows = stored(df.select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("text")))
        segment.keep_language(rows, lexicon, settings).select("text").write.mode("overwrite").text(f"{dst}/batch={batch}")

    return _batches(lines, checkpoint, each)


#: Runs of a level that are merged into one of the next.
FANOUT = 4
COUNTS = "n int, ctx array<string>, next string, cnt long"
_RUN = re.compile(r"run-(\d+)-(\d+)-(\d+)")


@dataclass
class CountStore:
    """Counts that grow by batches, in levels of merged runs. A run is a folder run-<level>-<first>-<last> of counts of the
    batches first to last, complete once it has _SUCCESS. FANOUT runs of a level are merged into one of the next, so after
    n batches about FANOUT * log(n) folders are read, and a count was rewritten about log(n) times.

    Nothing is renamed: of runs of which one covers the other, the longer one counts, so a merge that was cut off, a batch
    that is tried again after it was merged, or the runs that a merge has made superfluous change nothing. These are deleted
    when the next batch comes, so that who reads meanwhile finds them."""

    spark: SparkSession
    path: str

    def runs(self) -> tuple[list[str], list[str]]:
        """The runs that count, in order of their batches, and the superfluous ones."""
        complete = []
        for name in children(self.spark, self.path):
            if (m := _RUN.fullmatch(name)) and "_SUCCESS" in children(self.spark, f"{self.path}/{name}"):
                complete.append((int(m[2]), -int(m[3]), -int(m[1]), name))
        used, spare, end = [], [], -1
        for first, last, _, name in sorted(complete):
            (used if first > end else spare).append(name)
            end = max(end, -last)
        return used, spare

    def add(self, counts: DataFrame, batch: int) -> None:
        """Counts of a batch as a run of its own, then merges where a level is full. Batches are added in order."""
        for name in self.runs()[1]:
            delete(self.spark, f"{self.path}/{name}")
        counts.select("n", "ctx", "next", "cnt").write.mode("overwrite").parquet(f"{self.path}/run-0-{batch}-{batch}")
        while full := self._full():
            merged = self._read(full).groupBy("n", "ctx", "next").agg(F.sum("cnt").alias("cnt"))
            level, first, last = int(_RUN.fullmatch(full[0])[1]) + 1, _RUN.fullmatch(full[0])[2], _RUN.fullmatch(full[-1])[3]
            merged.write.mode("overwrite").parquet(f"{self.path}/run-{level}-{first}-{last}")

    def _full(self) -> list[str]:
        """The last FANOUT runs if they are of one level."""
        tail = self.runs()[0][-FANOUT:]
        return tail if len(tail) == FANOUT and len({_RUN.fullmatch(x)[1] for x in tail}) == 1 else []

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(*[f"{self.path}/{n}" for n in names])

    def read(self) -> DataFrame:
        """(n, ctx, next, cnt) of all batches."""
        names = self.runs()[0]
        rows = self._read(names) if names else self.spark.createDataFrame([], COUNTS)
        return rows.groupBy("n", "ctx", "next").agg(F.sum("cnt").alias("cnt"))


def stream_ngram_counts(spark: SparkSession, src: str, dst: str, checkpoint: str, max_n: int = 3, files_per_batch: int = 1000) -> StreamingQuery:
    """Counts of new files, batch by batch, into the CountStore at dst, and the files with their times, so that stale_counts()
    can tell whether one has changed since; read_counts() derives probabilities."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(src).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("time"))

    def each(df: DataFrame, batch: int) -> None:
        s = df.select(T.split_words(T.clean_text(F.col("value"))).alias("tokens"))
        df.select("file", "time").distinct().write.mode("overwrite").parquet(f"{dst}/files/batch={batch}")
        CountStore(spark, f"{dst}/counts").add(ngram.ngram_counts(s, range(2, max_n + 1)), batch)

    return _batches(lines, checkpoint, each)


def read_counts(spark: SparkSession, dst: str) -> DataFrame:
    return ngram.with_probability(CountStore(spark, f"{dst}/counts").read())


def _source_files(spark: SparkSession, src: str) -> DataFrame:
    """file, time below src, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(src)
    return f.select(F.col("path").alias("file"), F.col("modificationTime").alias("time"))


def stale_counts(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """file, why of counted files that have since 'changed' or are 'gone': new files are a stream's work, but what was counted
    of these can't be taken back, so a rebuild from the start is due."""
    if "files" not in children(spark, dst):
        return spark.createDataFrame([], "file string, why string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    counted = spark.read.schema("file string, time timestamp").parquet(f"{dst}/files").groupBy(plain(F.col("file")).alias("file")).agg(F.max("time").alias("counted"))
    now = _source_files(spark, src).select(plain(F.col("file")).alias("f"), F.col("time").alias("now"))
    j = counted.join(now, F.col("file") == F.col("f"), "left")
    return j.select("file", F.when(F.col("now").isNull(), "gone").when(F.col("now") > F.col("counted"), "changed").alias("why")).where("why is not null")


def update_counts(spark: SparkSession, src: str, dst: str, max_n: int = 3, files_per_batch: int = 1000) -> str:
    """Brings the counts of the files in src up to date and returns the folder that holds them, a generation below dst: new
    files are added to the latest generation, but once a counted file has changed or gone a new one is begun."""
    spans = sorted(int(x.removeprefix("gen-")) for x in children(spark, dst) if x.startswith("gen-"))
    gen = spans[-1] if spans else 0
    if not stale_counts(spark, src, f"{dst}/gen-{gen}").isEmpty():
        gen += 1
    path = f"{dst}/gen-{gen}"
    stream_ngram_counts(spark, src, path, f"{path}/checkpoint", max_n, files_per_batch).awaitTermination()
    return path


def stale_model(spark: SparkSession, path: str, sources: list[str]) -> str | None:
    """Why a saved model must be built again, or None: it is missing or was never finished, a source is newer, a file of it
    can't be read, or it holds no contexts of one word, which the back-off ends with."""
    if "_SUCCESS" not in children(spark, path):
        return "missing"
    built = modified(spark, f"{path}/_SUCCESS")
    for s in sources:
        if exists(spark, s) and (newest := _source_files(spark, s).agg(F.max(F.unix_millis("time"))).first()[0]) is not None and newest > built:
            return f"older than {s}"
    try:
        shortest = spark.read.parquet(path).agg(F.min(F.size("ctx")).alias("least"), F.count("p").alias("rows")).first()
    except (Py4JJavaError, PySparkException):
        return "broken"
    return None if shortest.rows and shortest.least <= 1 else "no short contexts"


def current_model(spark: SparkSession, path: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The saved model, built and saved first if it is stale."""
    if stale_model(spark, path, sources):
        writers.save_model(build(), path)
    return readers.load_model(spark, path)


def debounce(events: DataFrame, key: str, ts: str, gap: str = "10 minutes") -> DataFrame:
    """Batch: each event that no other of its key follows within the gap."""
    follows = F.lead(ts).over(W.partitionBy(key).orderBy(ts, "event_id"))
    return events.withColumn("next_ts", follows).where(F.col("next_ts").isNull() | (F.col("next_ts") >= F.col(ts) + F.expr(f"interval {gap}"))).drop("next_ts")


class _LastOfGap(StatefulProcessor):
    """Holds a key's events, by time, until no event that could follow within the gap can come any more: a timer for each one
    at its time and the gap, which fires once the watermark is past it."""

    def __init__(self, gap_us: int, schema: StructType):
        self.gap, self.schema = gap_us, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", StructType([StructField("at", LongType())]), StructType([self.schema["value"]]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for r in rows:
            at = (r.at,)
            # Of events at one time the one with the largest value is the last.
            if not self.held.containsKey(at) or self.held.getValue(at)[0] < r.value:
                self.held.updateValue(at, (r.value,))
            self.handle.registerTimer(-(-(r.at + self.gap) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 - self.gap
        held = sorted((k[0], v[0]) for k, v in self.held.iterator())
        for i, (at, value) in enumerate(held):
            if at > passed:
                break
            if i + 1 == len(held) or held[i + 1][0] >= at + self.gap:
                yield Row(key=key[0], at=at, value=value)
            self.held.removeKey((at,))

    def close(self) -> None:
        pass


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def debounce_stream(events: DataFrame, key: str, ts: str, value: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Stream: (key, value, ts) of each event that no other of its key follows within the gap, as debounce() finds them, once
    the watermark says that none can; of events at one time the one with the largest value. Events up to late behind the
    newest one may come in any order; later ones are left out. A key's state is its events of the last gap and that time.

    State is kept by the RocksDB provider, which is set for the session, as keyed timers need it."""
    spark = events.sparkSession
    spark.conf.set(*STATE_STORE)
    gap_us = spark.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + interval {gap})")).first()[0]
    e = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("t"), F.col(value).alias("value")).where("t is not null and value is not null")
    e = e.withWatermark("t", late).withColumn("at", F.unix_micros("t"))
    kinds = {f.name: f for f in e.schema.fields}
    out = StructType([kinds["key"], StructField("at", LongType()), kinds["value"]])
    done = e.groupBy("key").transformWithState(_LastOfGap(gap_us, e.schema), out, "Append", "EventTime")
    return done.select(F.col("key").alias(key), F.col("value").alias(value), F.timestamp_micros("at").alias(ts))


def stream_suggest(requests: DataFrame, model: DataFrame, dst: str, checkpoint: str, limit: int = 6) -> StreamingQuery:
    """requests(request_id, text) joined to a static model, batch by batch."""

    def each(df: DataFrame, batch: int) -> None:
        r = df.select("request_id", T.split_words(T.clean_text(F.col("text"))).alias("tokens"))
        predict.suggest(r, model, limit).write.mode("overwrite").parquet(f"{dst}/batch={batch}")

    return _batches(requests, checkpoint, each)
