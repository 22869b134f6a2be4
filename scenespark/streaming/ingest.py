"""Incremental ingest of scene summaries: each scene once, daily windows with late data, idempotent writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_landing(spark: SparkSession, path: str, schema: T.StructType, time: str, files_a_batch: int = 100, names: str = "*") -> DataFrame:
    """Parquet files of a folder (those whose names fit) as they land, with the event time as a TIMESTAMP
    (watermarks need one)."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", names).parquet(path)
    return raw.withColumn(time, F.col(time).cast("timestamp"))


def once(stream: DataFrame, key: Sequence[str], time: str, delay: str = "10 days") -> DataFrame:
    """Each key once; state is dropped when the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def windowed(stream: DataFrame, time: str, width: str, aggs: Sequence[Column], by: Sequence[str] = (), delay: str | None = None, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows of event time: window_start, by, aggregates. Rows later than `delay` are
    not counted; leave it out if a watermark is set already."""
    df = stream.withWatermark(time, delay) if delay else stream
    got = df.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by).agg(*aggs)
    return got.select(F.col("window.start").alias("window_start"), *by, *(c for c in got.columns if c not in ("window", *by)))


def sessions(stream: DataFrame, time: str, gap: str, by: Sequence[str], aggs: Sequence[Column], delay: str) -> DataFrame:
    """Sessions that end after a gap without events."""
    got = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(*aggs)
    return got.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, *(c for c in got.columns if c not in ("session_window", *by)))


def append_once(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str]) -> StreamingQuery:
    """Every batch anti-joined with what is there, so a batch that is replayed appends nothing twice."""
    from scenespark.sources.tables import append_new

    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows as Parquet; exactly once by the sink's log."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
