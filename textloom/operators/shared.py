"""Tables in the shared folder, and broadcasts of a checked size."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a stored table is broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where it may be unset, a temporary one takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str = "stored") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, kind: str = "stored") -> DataFrame:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage and survives lost executors; what was
    shuffled for them is deleted."""
    path = new_path(df.sparkSession, kind)
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _located(spark, path)
    return store.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of few entries; none if there is no such folder."""
    p, store = _located(spark, path)
    return [f.getPath().getName() for f in store.listStatus(p)] if store.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, store = _located(spark, path)
    store.delete(p, True)


def modified(spark: SparkSession, path: str) -> int:
    """When a file was written, in milliseconds."""
    p, store = _located(spark, path)
    return store.getFileStatus(p).getModificationTime()


#: Bytes up to which a table of few files is dealt out to all cores: a small file is often one row group, which one task reads.
SMALL_TABLE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table as it was read, or dealt out evenly if it is small and has fewer files than there are cores. The files' number
    and size are those that the session knows from planning; no name passes through the driver's Python."""
    spark = df.sparkSession
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    if int(plan.stats().sizeInBytes()) > SMALL_TABLE:
        return df
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, otherwise: str | None = None) -> DataFrame:
    """The table, marked for broadcast if it has at most so many rows. It is counted, so pass one that is stored. A larger
    one is joined by shuffle, where adaptive execution splits hot keys (spark.sql.adaptive.skewJoin), by the given hint."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df
