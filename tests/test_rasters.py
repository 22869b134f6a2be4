import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.operators import candidates as cd
from scenespark.sources import rasters


def test_npy_round_trip_and_window(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    buf = io.BytesIO()
    np.save(buf, a)
    (tmp_path / "a.npy").write_bytes(buf.getvalue())
    read = rasters.read_npy(spark, str(tmp_path))
    cells = rasters.cells_of(read.select("path", F.col("values").alias("v"), "width"), ["path"], ["v"])
    got = {(r.y, r.x): r.v for r in cells.collect()}
    assert got == {(y, x): float(a[y, x]) for y in range(3) for x in range(4)}
    win = {(r.y, r.x): r.v for r in rasters.window(cells, ["path"], 2, 3, 2, 2, ["v"]).collect()}
    assert win == {(0, 0): 11.0, (0, 1): None, (1, 0): None, (1, 1): None}
    mask = spark.createDataFrame([(0, 0, 200.0), (0, 1, 0.0)], "y int, x int, value double")
    assert {(r.y, r.x) for r in rasters.with_mask(cells, mask, above=127).where("land").collect()} == {(0, 0)}


def test_cache_computes_a_scene_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "scene string, v int")
    path = str(tmp_path / "cache")
    assert rasters.cached(df.where("scene = 'a'"), path, "scene").count() == 1
    both = rasters.cached(df.withColumn("v", F.col("v") + 10), path, "scene")
    assert sorted(map(tuple, both.collect())) == [("a", 1), ("b", 12)]


def test_unknown_sensor_is_an_error(spark):
    df = spark.createDataFrame([("XX08_1",)], "id string")
    with pytest.raises(Exception, match="no band map"):
        df.select(cd.band_of(F.col("id"), {"LC": {"nir": 5}}, "nir")).collect()


def test_targets_take_each_row_once(spark):
    df = spark.createDataFrame([(1, d, i) for i, d in enumerate([60, 61, 62, 170, 171])], "season int, doy int, id int")
    got = {r.id for r in cd.nearest_targets(df, ["season"], "doy", "id", 3, (53, 180)).collect()}
    assert got == {0, 3, 4}
    assert cd.nearest_targets(df, ["season"], "doy", "id", 9, (53, 180)).count() == 5


def test_small_pools_stay_whole(spark):
    df = spark.createDataFrame([("a", 2017 + i % 3, i) for i in range(30)], "role string, season int, id int")
    kept = cd.cap_per_season(df, ["role"], "season", [F.col("id")], 9)
    assert kept.groupBy("season").count().where("count <> 3").count() == 0 and kept.count() == 9
    assert cd.cap_per_season(df, ["role"], "season", [F.col("id")], 30).count() == 30
