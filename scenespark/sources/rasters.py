"""Rasters as cells: band arrays of a scene exploded, NumPy files decoded in Arrow batches, windows, masks and
caches. Image codecs are not part of this library; anything that yields arrays can feed it."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cells_of(scenes: DataFrame, key: Sequence[str], bands: Sequence[str], width: str = "width") -> DataFrame:
    """key, y, x and a column a band, from rows with one flat array a band (row by row) of equal length."""
    zipped = F.arrays_zip(*(F.col(b).alias(b) for b in bands))
    long = scenes.select(*key, F.col(width).alias("w__"), F.posexplode(zipped).alias("i__", "c__"))
    return long.select(*key, F.floor(F.col("i__") / F.col("w__")).cast("int").alias("y"), (F.col("i__") % F.col("w__")).cast("int").alias("x"), *(F.col(f"c__.{b}").alias(b) for b in bands))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, values (flat, DOUBLE) of two-dimensional .npy files; one file at a time is held.
    Pickled arrays are refused."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if a.ndim != 2:
                    raise ValueError(f"{name} has {a.ndim} dimensions")
                yield pa.RecordBatch.from_pydict({"path": [name], "height": pa.array([a.shape[0]], pa.int32()), "width": pa.array([a.shape[1]], pa.int32()), "values": pa.array([a.astype(float).ravel()], pa.list_(pa.float64()))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, height int, width int, values array<double>")


def window(cells: DataFrame, key: Sequence[str], y0: int, x0: int, height: int, width: int, bands: Sequence[str]) -> DataFrame:
    """The window of every scene with y and x from its own corner; cells beyond the raster are NULL."""
    inside = cells.where(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)).select(*key, (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), *bands)
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.struct(y.alias("y"), x.alias("x"))))))
    frame = cells.select(*key).distinct().select(*key, grid.alias("g")).select(*key, "g.y", "g.x")
    return frame.join(inside, [*key, "y", "x"], "left")


def with_mask(cells: DataFrame, mask: DataFrame, name: str = "land", above: float = 0.0) -> DataFrame:
    """cells with a flag from a mask raster (y, x, value); cells that the mask lacks are not masked."""
    m = mask.select("y", "x", (F.col("value") > above).alias(name))
    return cells.join(m, ["y", "x"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cached(df: DataFrame, path: str, key: str) -> DataFrame:
    """Scenes already in the Parquet cache are read from there, the others computed, added and read."""
    from scenespark.sources.tables import _exists

    spark = df.sparkSession
    todo = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti").select(*df.columns) if _exists(spark, path) else df
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(df.select(key).distinct(), key, "left_semi")
