import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark import presets as P
from scenespark.functions import spectral as sp
from scenespark.operators import morphology as mo
from scenespark.operators import scenes as sc

# reflectances of surfaces (fixed values): green, near infrared, short-wave infrared
FAST_ICE, OPEN_WATER, NEAR_ZERO = (0.60, 0.62, 0.06), (0.0745, 0.024, 0.012), (0.004, 0.004, 0.004)


def classified(spark, cells):
    df = spark.createDataFrame(cells, "green double, nir double, swir double")
    f = sp.class_flags(F.col("green"), F.col("nir"), F.col("swir"), F.lit(True))
    return [tuple(r) for r in df.select(*(f[k] for k in ("ice_solid", "ice_light", "water", "unclassified"))).collect()]


def test_known_surfaces(spark):
    dim = tuple(v * 0.18 for v in FAST_ICE)
    shadow = tuple(v * k for v, k in zip(FAST_ICE, (0.30, 0.10, 0.10)))
    got = classified(spark, [FAST_ICE, OPEN_WATER, shadow, dim, NEAR_ZERO])
    assert got[0] == (True, False, False, False)
    assert got[1] == got[2] == (False, False, True, False)  # shadowed ice reads as water
    assert got[3] == got[4] == (False, False, False, True)


def test_the_cut_itself_is_neither_kind_of_ice(spark):
    # an index of exactly 0.5: (0.75 - 0.25) / 1.0, without the epsilon
    df = spark.createDataFrame([(0.75, 0.9, 0.25)], "g double, n double, s double")
    f = sp.class_flags(F.col("g"), F.col("n"), F.col("s"), F.lit(True), solid=0.5, light=0.2)
    ndsi = df.select(f["ndsi"]).first()[0]
    g = sp.class_flags(F.col("g"), F.col("n"), F.col("s"), F.lit(True), solid=ndsi, light=0.2)
    assert df.select(g["ice_solid"], g["ice_light"]).first() == (False, False)


def test_mixtures(spark):
    for share in (0.25, 0.5, 0.75):
        n = int(64 * share)
        cells = [("s", *FAST_ICE, False)] * n + [("s", *OPEN_WATER, False)] * (64 - n)
        df = spark.createDataFrame(cells, "scene string, green double, nir double, swir double, m boolean")
        f = sp.class_flags(F.col("green"), F.col("nir"), F.col("swir"), F.lit(True))
        full = df.select("scene", *(c.alias(k) for k, c in f.items()), *(F.col("m").alias(k) for k in ("cloud", "land", "nodata")))
        r = sc.summarise(full, ["scene"]).first()
        assert r.solid_pct_clear == share and r.classified_px == 64 and r.usable == 1 and r.edge_gap == 0


def test_summary_counts_and_overlap(spark):
    cells = []
    for y in range(4):
        for x in range(4):
            q = (y // 2) * 2 + x // 2
            cells.append(("s", q == 0, q == 1, q == 2, q == 3, (y, x) == (0, 0), (y, x) == (1, 1), 0.9, 0.5))
    df = spark.createDataFrame(cells, "scene string, ice_solid boolean, ice_light boolean, water boolean, cloud boolean, land boolean, nodata boolean, ndsi double, ndwi double")
    r = sc.summarise(df, ["scene"]).first()
    assert [r[f"{k}_px"] for k in ("solid", "light", "water", "cloud", "land", "nodata")] == [4, 4, 4, 4, 1, 1]
    assert r.unknown_px == 2 and r.solid_pct == 0.25 and r.unclassified_px == 0
    none = sc.summarise(df.withColumns({c: F.lit(False) for c in ("ice_solid", "ice_light", "water")}), ["scene"]).first()
    assert none.solid_pct_clear is None and none.mean_ndsi_solid is None and none.usable == 0
    assert sc.summarise(df.limit(0), ["scene"]).count() == 0


def test_reflectance_of_both_baselines(spark):
    df = spark.createDataFrame([(5000, "02.09"), (6000, "04.00"), (0, "03.01"), (0, "05.10"), (6000, None), (6000, "n/a")], "dn int, b string")
    got = [r[0] for r in df.select(sp.reflectance(F.col("dn"), sp.baseline_major(F.col("b")))).collect()]
    assert got == pytest.approx([0.5, 0.5, 0.0, -0.1, 0.6, 0.6])


def test_catalogue_guards(spark):
    area = (-53.0, 70.0, -51.0, 71.0)
    rows = [([-53.0, 70.0, -51.0, 71.0], True, 1.0), ([-52.0, 70.0, -51.0, 71.0], True, 0.5), ([10.0, 70.0, 12.0, 71.0], True, 0.0), ([-180.0, -90.0, 180.0, 90.0], False, 1.0), (None, False, 0.0)]
    df = spark.createDataFrame([(b,) for b, *_ in rows], "bbox array<double>")
    got = df.select(sc.plausible(F.col("bbox")), sc.coverage(F.col("bbox"), area)).collect()
    assert [(r[0], r[1]) for r in got] == [(p, c) for _, p, c in rows]
    ids = spark.createDataFrame([("S2A_22WDD_20170219_0_L1C",), ("x",)], "id string")
    assert [tuple(r) for r in ids.select(sc.zone_of_id(F.col("id")), sc.tile_of_id(F.col("id"))).collect()] == [(22, "22WDD"), (None, None)]


def test_partial_reads(spark):
    even = [("edge", b, 0.056 + 0.001 * b) for b in range(13)]
    blank = [("blank", b, 1.0 if b == 2 else 0.0) for b in range(13)]
    empty = [("empty", b, 1.0) for b in range(13)]
    few = [("few", 0, 1.0), ("few", 1, 0.0)]
    spread = [("spread", b, 0.5 if b == 3 else 0.1) for b in range(13)]
    df = spark.createDataFrame(even + blank + empty + few + spread, "scene string, band int, zero_share double")
    assert dict(map(tuple, sc.reject_partial(df, ["scene"]).collect())) == {"edge": False, "blank": True, "empty": False, "few": False, "spread": True}


def test_morphology_border_and_holes():
    full = np.ones((64, 64), bool)
    assert mo.close(full).sum() == 64 * 64 - 252  # outside is False, so the border erodes
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert mo.fill_holes(ring)[3, 3] and not mo.fill_holes(ring)[0, 0]
    two = np.zeros((5, 9), bool)
    two[0, :3] = two[3, 4:9] = True
    assert mo.largest(two).sum() == 5 and not mo.largest(two)[0].any()
    assert mo.label(two).max() == 2 and not mo.open_(ring & False).any()


def test_raster_of_an_odd_shape(spark):
    df = spark.createDataFrame([(1, [[True, True], [True, False]]), (2, None), (3, [])], "id int, m array<array<boolean>>")
    got = {r.id: r.f for r in df.select("id", mo.on_raster(mo.largest, "m").alias("f")).collect()}
    assert got == {1: [[True, True], [True, False]], 2: None, 3: []}


def test_last_class_wins(spark):
    df = spark.createDataFrame([(True, True)], "cloud boolean, water boolean")
    assert df.select(sp.raster_class({"cloud": F.col("cloud"), "water": F.col("water")})).first()[0] == 6
    assert P.CLASSES[6] == "water"
