"""WARC archives of pages: written with revisit records for repeated payloads, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm import warc
from textloom.llm.work import broadcast_if_small, shared_dir, table


def _use(spark: SparkSession) -> None:
    spark.dataSource.register(warc.WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One record for each row: of equal payloads the smallest page_id is the response, others revisit it.

    A null body is an empty payload; empty payloads are equal as any others. A null page_id comes after all
    numbers. Of repeated rows of the smallest page_id one is the response (the first by URL). An empty table gives
    no records. Other columns are not read. Which page a payload belongs to is settled by an aggregate per digest
    that is combined before it is shuffled; bodies are shuffled once, by digest and id, which spreads the pages
    of a hot payload."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    p = p.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    p = p.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    first = p.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), "key")).alias("first"), F.count("*").alias("rows"))
    nth = F.row_number().over(W.partitionBy("digest", "key").orderBy("url")) - 1
    own = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), "key")
    # Only digests of several rows need the smallest page: a small table, where payloads seldom repeat.
    several = broadcast_if_small(first.where("rows > 1").select("digest", "first"))
    r = p.withColumn("nth", nth).join(several, "digest", "left").withColumn("first", F.coalesce("first", own))
    response = (F.col("key") == F.col("first.key")) & (F.col("nth") == 0)
    return r.select(
        "page_id", "nth", "url", F.when(response, "response").otherwise("revisit").alias("record_type"), "payload_bytes", "digest",
        F.when(~response, F.col("first.id")).alias("refers_to"), F.when(response, F.col("payload")).alias("payload"),
    )


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without is in Spark's default file system, for the driver and all tasks."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def write_warc(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes an archive folder; each task writes files of its own."""
    _use(pages.sparkSession)
    records(pages, **columns).write.format("warc").mode("append").save(qualified(pages.sparkSession, path))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below path; without payload, blocks are skipped unread."""
    _use(spark)
    schema = warc.SCHEMA if payload else warc.SCHEMA.rpartition(",")[0]
    return spark.read.format("warc").schema(schema).load(qualified(spark, path))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    responses = read_warc(spark, path).where("record_type = 'response'").drop("payload")
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id) AS nth, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_id END AS refers_to
FROM r
"""
