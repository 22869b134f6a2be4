"""Scene catalogues: JSON items with an explicit schema, and a Python data source that reads a folder of
yearly item files one partition a year, with the area and dates as options."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("datetime", T.TimestampType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("assets", T.MapType(T.StringType(), T.StructType([T.StructField("href", T.StringType())]))),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])


def read_items(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Items of JSON files (one an object a line, or feature collections), sorted by nothing: order with
    (datetime, id) where it matters. Dates are half-open."""
    schema = T.StructType([*ITEM.fields, T.StructField("features", T.ArrayType(ITEM))])
    raw = spark.read.schema(schema).json(path, multiLine=False)
    flat = raw.where("features is null").select(*ITEM.names).unionByName(raw.where("features is not null").select(F.inline("features")))
    if start:
        flat = flat.where(F.col("datetime") >= F.lit(start).cast("timestamp"))
    return flat.where(F.col("datetime") < F.lit(end).cast("timestamp")) if end else flat


class _Year(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[_Year]:
        first, last = self.o.get("from", "0000")[:4], self.o.get("to", "9999")[:4]
        names = sorted(n for n in os.listdir(self.o["path"]) if n.endswith(".json"))
        return [_Year(os.path.join(self.o["path"], n)) for n in names if first <= n[:4] <= last] or [_Year("")]

    def read(self, part: _Year) -> Iterator[tuple]:
        if not part.path:
            return
        tries = int(self.o.get("retries", 4))
        for k in range(tries):
            try:
                with open(part.path, encoding="utf-8") as f:
                    items = json.load(f)["features"]
                break
            except (OSError, ValueError):
                if k + 1 == tries:
                    raise
                time.sleep(float(self.o.get("wait", 0.5)) * (k + 1))
        lo, hi = self.o.get("from", ""), self.o.get("to", "9999")
        box = [float(x) for x in self.o["bbox"].split(",")] if "bbox" in self.o else None
        for i in items:
            at, b = i.get("properties", {}).get("datetime") or i.get("datetime") or "", i.get("bbox")
            if not lo <= at[: len(lo) or None] or at[: len(hi)] > hi:
                continue
            if box and (not b or b[0] > box[2] or b[2] < box[0] or b[1] > box[3] or b[3] < box[1]):
                continue
            yield i["id"], at, b, json.dumps(i.get("assets", {})), json.dumps(i.get("properties", {}))


class CatalogueSource(DataSource):
    """format("scene_catalogue").option("path", folder).option("from"/"to"/"bbox", …). Files are named by
    year (2021.json); a file that can't be read is tried again `retries` times."""

    @classmethod
    def name(cls) -> str:
        return "scene_catalogue"

    def schema(self) -> str:
        return "id string, datetime string, bbox array<double>, assets string, properties string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogueSource)


def inventory(items: DataFrame) -> DataFrame:
    """tile, year, baseline, scenes: what a run would read (the counts that a later gate expects)."""
    from scenespark.operators.scenes import tile_of_id

    rows = items.select(tile_of_id(F.col("id")).alias("tile"), F.year("datetime").alias("year"), F.col("properties")["processing_baseline"].alias("baseline"))
    return rows.groupBy("tile", "year", "baseline").agg(F.count("*").alias("scenes"))
