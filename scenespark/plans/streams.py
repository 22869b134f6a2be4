"""Streams over the events table; each query drains the stream into a table of the shared folder and reads
that back, so it equals the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.operators.ordered import checkpoints
from scenespark.plans.adapters import r6
from scenespark.streaming import ingest


def _folder(spark: SparkSession) -> str:
    """A new folder where driver and executors both reach it."""
    return f"{checkpoints(spark)}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as one file among others, or as a folder of part files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return ingest.read_landing(spark, path, schema, "ts", names="*.parquet")
    return ingest.read_landing(spark, sf_dir, schema, "ts", names="events.parquet")


def _drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Everything that the watermark lets go; what is still open at the end is not emitted."""
    at = _folder(spark)
    ingest.to_table(stream, f"{at}/table", f"{at}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind, for days that have closed."""
    s = ingest.windowed(_source(spark, sf_dir), "ts", "1 day", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")], ["event_type"], "1 day")
    return r6(_drained(s, spark).select(F.to_date("window_start").alias("day"), "event_type", "n", "total"))


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, kind) once while its state lives."""
    s = ingest.once(_source(spark, sf_dir), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type")
    return _drained(s, spark)


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind in windows of two days, one beginning every day, that have closed."""
    s = ingest.windowed(_source(spark, sf_dir), "ts", "2 days", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")], ["event_type"], "1 day", "1 day")
    return r6(_drained(s, spark).select(F.to_date("window_start").alias("day"), "event_type", "n", "total"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events without a pause of six hours, for sessions that have closed."""
    s = ingest.sessions(_source(spark, sf_dir), "ts", "6 hours", ["user_id"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")], "1 day")
    return r6(_drained(s, spark).select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n", "total"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_once, stream_sliding, stream_sessions)}
ORACLE_SQL = {
    "stream_tumbling": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
    "stream_once": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_sliding": """WITH w AS (SELECT CAST(ts AS DATE) - CAST(back AS INT) AS day, event_type, value FROM events, range(0, 2) b(back))
SELECT day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
    "stream_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, value, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 AS INT) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY user_id ORDER BY t), 0) AS k FROM g)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
HAVING max(t) + 21600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 86400000000""",
}
