import json

import pytest
from pyspark.sql import functions as F

from scenespark.operators import gates as gt
from scenespark.sources import catalogue, config, tables
from scenespark.streaming import ingest


def test_config_extends_and_overrides(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text("output: a\nthresholds: {ndsi_light: 0.3, ndwi: 0.1}\n")
    (tmp_path / "run.yaml").write_text("extends: base.yaml\nthresholds: {ndwi: 0.25}\nmax_tiles: 4\n")
    data = config.load_yaml(tmp_path / "run.yaml")
    assert data == {"output": "a", "thresholds": {"ndsi_light": 0.3, "ndwi": 0.25}, "max_tiles": 4}
    c = config.build(data, ndsi_light=0.5, output=None)
    assert (c.output, c.thresholds.ndsi_light, c.thresholds.ndwi, c.thresholds.ndsi_solid, c.max_tiles) == ("a", 0.5, 0.25, 0.70, 4)
    (tmp_path / "loop.yaml").write_text("extends: loop.yaml\n")
    for bad in (lambda: config.load_yaml(tmp_path / "loop.yaml"), lambda: config.build({"nonsense": 1})):
        with pytest.raises(ValueError):
            bad()


def test_geojson():
    poly = {"type": "Polygon", "coordinates": [[[0, 1], [2, 1], [2, 5], [0, 1]]]}
    for g in (poly, {"type": "Feature", "geometry": poly}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": poly}]}):
        assert config.bounds(config.geometry(json.dumps(g))) == (0, 1, 2, 5)
    with pytest.raises(ValueError):
        config.geometry('{"type": "Point", "coordinates": [0, 0]}')


def item(i, day, box=(0, 0, 1, 1)):
    return {"id": f"S2A_22WDD_{day.replace('-', '')}_{i}", "bbox": list(map(float, box)), "properties": {"datetime": f"{day}T10:00:00Z", "processing_baseline": "04.00"}, "assets": {"green": {"href": "g.tif"}}}


def test_catalogue_source(spark, tmp_path):
    for y in (2020, 2021):
        (tmp_path / f"{y}.json").write_text(json.dumps({"features": [item(0, f"{y}-03-01"), item(1, f"{y}-05-01", (9, 9, 10, 10))]}))
    catalogue.register(spark)
    read = lambda **o: sorted(r.id for r in spark.read.format("scene_catalogue").option("path", str(tmp_path)).options(**o).load().collect())
    assert len(read()) == 4
    assert read(**{"from": "2021-01-01", "to": "2021-12-31"}) == ["S2A_22WDD_20210301_0", "S2A_22WDD_20210501_1"]
    assert read(bbox="8,8,11,11", to="2020-12-31") == ["S2A_22WDD_20200501_1"]


def test_items_and_inventory(spark, tmp_path):
    lines = [dict(item(0, "2020-03-01"), datetime="2020-03-01T10:00:00Z"), {"features": [dict(item(1, "2021-03-01"), datetime="2021-03-01T10:00:00Z")]}]
    (tmp_path / "i.json").write_text("\n".join(map(json.dumps, lines)))
    items = catalogue.read_items(spark, str(tmp_path))
    assert items.count() == 2 and catalogue.read_items(spark, str(tmp_path), "2020-06-01", "2022-01-01").count() == 1
    assert {tuple(r) for r in catalogue.inventory(items).collect()} == {("22WDD", 2020, "04.00", 1), ("22WDD", 2021, "04.00", 1)}


def test_summary_versions(spark, tmp_path):
    new, old = tables.SUMMARY.names, tables.LEGACY.names
    assert len(new) == 29 and len(old) == 22
    row = {c: "0.5" for c in new} | {"tile_id": "S2A_22WDD_20170219_0", "timestamp": "20170219T150000", "solid_px": "7", "usable": "1", "mean_ndsi_solid": "", "mean_ndwi_water": "nan", "light_px": "oops"}
    for name, cols in (("new", new), ("old", old)):
        (tmp_path / f"{name}.csv").write_text(",".join(cols) + "\n" + ",".join(row[c] for c in cols) + "\n")
        r = tables.read_summary(spark, str(tmp_path / f"{name}.csv")).first()
        assert (r.season, r.doy, r.tile, r.solid_px, r.light_px, r.mean_ndsi_solid, r.mean_ndwi_water, r.ice) == (2017, 50, "22WDD", 7, None, None, None, 1.0)
        assert r.usable == (1 if name == "new" else None)
    assert gt.header(new, new, old)[0] == "PASS" and gt.header(old, new, old)[0] == "WARN" and gt.header(new[1:], new, old)[0] == "FAIL"


def test_rows_intact(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,2,3\n4,5,6\n")
    (tmp_path / "b.txt").write_text("1,2,3,4\n5")
    status = lambda f: gt.rows_intact(tables.text_lines(spark, str(tmp_path / f)), 3).first().status
    assert status("a.txt") == "PASS" and status("b.txt") == "FAIL"
    assert {r.path[-5:]: r.intact for r in tables.ends_with_newline(spark, str(tmp_path)).collect()} == {"a.txt": True, "b.txt": False}


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.6), ("b", 2, 0.1)], "k string, t int, v double")
    path = str(tmp_path / "out")
    assert tables.append_new(df, path, ["k", "t"]) == 2
    assert tables.append_new(df, path, ["k", "t"]) == 0
    assert tables.append_new(spark.createDataFrame([("c", 3, 0.0), ("a", 1, 9.0)], df.schema), path, ["k", "t"]) == 1
    with pytest.raises(ValueError):
        tables.append_new(df.withColumn("more", F.lit(1)), path, ["k", "t"])
    tables.upsert(spark.createDataFrame([("b", 2, 7.0)], df.schema), path, ["k", "t"], str(tmp_path / "next"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "next")).collect()} == {("a", 1, 0.5), ("b", 2, 7.0), ("c", 3, 0.0)}


def test_merge_files_logs(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "t int, id string")
    assert [tuple(r) for r in tables.merge_seasons([a, a.limit(1)], ["id"], ["t", "id"]).collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        tables.merge_seasons([a, a.withColumnRenamed("t", "u")], ["id"], ["id"])
    (tmp_path / "S2_20210314_x.png").write_bytes(b"x")
    assert str(tables.image_files(spark, str(tmp_path / "*.png")).first().day) == "2021-03-14"
    (tmp_path / "run.log").write_text("1/10\nscene rejected\n7/10\nRejecting\n")
    r = tables.log_progress(spark, str(tmp_path / "run.log")).first()
    assert (r.done, r.total, r.rejected) == (7, 10, 2)
    assert json.loads(tables.manifest({"a": 1}, {"n": 2}))["stats"] == {"n": 2}


def test_reconcile(spark):
    got = spark.createDataFrame([("a", 5, "p"), ("b", 5, "p")], "k string, n int, pal string")
    want = spark.createDataFrame([("a", 5), ("b", 6), ("c", 1)], "k string, n int")
    rows = tables.reconcile(got, want, "k", "n", "pal").collect()
    assert {r.k: r.status for r in rows} == {"a": "ok", "b": "count differs", "c": "missing"} and rows[0].palettes == 1


def test_gates_find_bad_rows(spark):
    good = {"tile_id": "S2A_22WDD_1", "solid_px": 50, "light_px": 10, "water_px": 20, "cloud_px": 10, "land_px": 10, "nodata_px": 0, "unknown_px": 0}
    pct = {c.replace("_px", "_pct"): v / 100 for c, v in good.items() if c.endswith("_px") and c != "unknown_px"}
    base = {**good, **pct, "classified_px": 80, "usable": 1, "water_pct_clear": 0.25, "mean_ndwi_water": 0.6, "mean_ndsi_solid": 0.8, "mean_ndsi_light": 0.5}
    frame = lambda *rows: spark.createDataFrame([{**base, **r} for r in rows])
    one = lambda g, *rows: {r.gate: r.status for r in g(frame(*rows)).collect()}
    assert one(gt.derived(), {}) == {"derived_classified": "PASS", "derived_usable": "PASS"}
    assert one(gt.derived(), {"classified_px": 81, "usable": 0}) == {"derived_classified": "FAIL", "derived_usable": "FAIL"}
    assert one(gt.ranges(), {"solid_pct": 1.2})["ranges"] == "FAIL" and one(gt.indices(), {"mean_ndwi_water": 2.1})["indices"] == "WARN"
    assert one(gt.zeroed_band(), {"mean_ndwi_water": 1.0, "water_pct_clear": 1.0})["zeroed_band"] == "FAIL" and one(gt.zeroed_band(), {})["zeroed_band"] == "PASS"
    assert one(gt.grid(), {}) == {"grid": "PASS", "grid_accounting": "PASS"}
    assert one(gt.grid(), {"water_pct": 0.4})["grid"] == "FAIL"
    assert one(lambda d: gt.tiles(d.withColumn("t", F.lit("99XYZ")), "t", ["22WDD"]), {})["tiles"] == "FAIL"
    assert one(lambda d: gt.no_duplicates(d, ["tile_id"], "dup"), {}, {})["dup"] == "FAIL"
    bad = frame({"classified_px": 81})
    fixed = gt.repair_derived(bad)
    gt.assert_measured_unchanged(bad, fixed, ["solid_px", "light_px"])
    assert gt.verdict(gt.derived()(fixed)).first().verdict == "ACCEPT" and gt.verdict(gt.derived()(bad)).first().verdict == "REJECT"
    with pytest.raises(ValueError):
        gt.assert_measured_unchanged(bad, fixed.withColumn("solid_px", F.lit(1).cast("long")), ["solid_px"])


def test_claims(spark):
    c = spark.createDataFrame([('{"a": 1.5, "b": {"c": "x", "d": {"e": 2}}, "f": null}',)], "json string")
    flat = {r.path: r.value for r in gt.flatten_claims(c).collect()}
    assert flat == {"a": "1.5", "b.c": "x", "b.d.e": "2", "f": None}
    other = spark.createDataFrame([("a", "1.5004"), ("b.c", "y"), ("g", "1")], "path string, value string")
    got = {r.path: r.status for r in gt.drift(gt.flatten_claims(c), other).collect()}
    assert got == {"a": "PASS", "b.c": "FAIL", "b.d.e": "FAIL", "f": "PASS", "g": "FAIL"}


def test_stream_equals_batch_and_replays_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, f"2024-01-{1 + i % 20:02d} 10:00:00", float(i)) for i in range(60)], "k int, s string, v double").selectExpr("k", "cast(s as timestamp) t", "v")
    land = str(tmp_path / "land")
    df.limit(30).write.parquet(land)
    df.write.mode("append").parquet(land)
    s = ingest.read_landing(spark, land, df.schema, "t")
    out = str(tmp_path / "out")
    for _ in range(2):
        ingest.append_once(s, out, str(tmp_path / "state"), ["k", "t", "v"]).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, df.distinct().collect()))
    win = ingest.windowed(ingest.read_landing(spark, land, df.schema, "t"), "t", "2 days", [F.count("*").alias("n")], delay="1 day", slide="1 day")
    ses = ingest.sessions(ingest.read_landing(spark, land, df.schema, "t"), "t", "1 hour", ["k"], [F.count("*").alias("n")], "1 day")
    for name, q in (("w", win), ("s", ses)):
        ingest.to_table(q, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / name)).count() > 0
