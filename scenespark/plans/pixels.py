"""Cells, rasters and thresholds over embeddings; radar and thermal units over line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark import presets as P
from scenespark.functions import spectral as sp
from scenespark.operators import clusters as cl
from scenespark.operators import inference as st
from scenespark.operators import morphology as mo
from scenespark.operators import scenes as sc
from scenespark.operators import thresholds as th
from scenespark.plans.adapters import BANDS, GRID, bands, grid, r6, scenes, table

LAND, CLOUD, GAP = "vec_id % 11 = 0", "vec_id % 7 = 0", "vec_id % 13 = 0"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of scenes (labels) with all flags; masks overlap here and there."""
    b = bands(spark, sf_dir)
    masks = {"land": F.expr(LAND), "cloud": F.expr(CLOUD), "nodata": F.expr(GAP)}
    usable = ~masks["land"] & ~masks["cloud"] & ~masks["nodata"]
    return b.select("*", *(c.alias(n) for n, c in {**sp.class_flags(F.col("green"), F.col("nir"), F.col("swir"), usable), **masks}.items()))


FLAGS = f"""{BANDS}, ix AS (SELECT *, (green - swir) / (green + swir + 1e-6) AS ndsi, (green - nir) / (green + nir + 1e-6) AS ndwi, {LAND} AS land, {CLOUD} AS cloud, {GAP} AS nodata,
  green > 0.1 AND nir > 0.17 AS bright, NOT ({LAND}) AND NOT ({CLOUD}) AND NOT ({GAP}) AS ok FROM cell),
ice AS (SELECT *, ndsi > 0.7 AND green + swir > 0.02 AND bright AND ok AS ice_solid, ndsi > 0.4 AND ndsi < 0.7 AND green + swir > 0.02 AND bright AND ok AS ice_light FROM ix),
flags AS (SELECT *, ndwi > 0.2 AND green + nir > 0.02 AND NOT ice_solid AND NOT ice_light AND ok AS water FROM ice)"""


def class_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flagged(spark, sf_dir)
    flags = {n: F.col(n) for n in P.CLASSES.values() if n != "unclassified"}
    return r6(f.select("vec_id", "ndsi", "ndwi", "ice_solid", "ice_light", "water", sp.raster_class(flags).cast("int").alias("class_id")))


def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.summarise(_flagged(spark, sf_dir), ["label"], digits=6)


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sc.class_counts(_flagged(spark, sf_dir), ["label"])
    return got.select("label", *(F.coalesce(F.col("classes")[n], F.lit(0)).alias(n) for n in ("ice_light", "water", "cloud")))


def other_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain classifier, and the one with a single class of ice, by scene."""
    b = bands(spark, sf_dir)
    plain = sp.class_flags(F.col("green"), F.col("nir"), F.col("swir"), F.lit(True), clamp=False, guard=False)
    single = sp.class_flags(F.col("green"), F.col("nir"), F.col("swir"), F.lit(True), solid=None)
    return b.groupBy("label").agg(F.count_if(plain["ice_solid"]).alias("solid"), F.count_if(plain["ice_light"]).alias("light"), F.count_if(plain["unclassified"]).alias("unclassified"), F.count_if(single["ice_light"]).alias("ice"), F.count_if(single["water"]).alias("water"))


def band_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of which every band is within 0.35 of zero, and the largest band."""
    b = bands(spark, sf_dir)
    return b.select("vec_id", sp.is_void(F.col("bands"), F.lit(0.0), 0.35).alias("void"), sp.argmax(F.col("bands")).alias("largest"))


def reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as digital numbers of an older and a newer baseline; shares as radiance."""
    s = table(spark, sf_dir, "lineitem")
    major = sp.baseline_major(F.when(F.col("l_linenumber") > 2, F.lit("04.00")).when(F.col("l_linenumber") == 2, F.lit("02.09")).otherwise(F.lit("n/a")))
    dn = F.col("l_quantity") * 100
    return r6(s.select(
        "l_orderkey", "l_linenumber", sp.reflectance(dn, major).alias("reflectance"), sp.floor0(sp.reflectance(dn, major)).alias("clamped"), sp.level2_reflectance(dn).alias("level2"),
        sp.toa_reflectance(dn, F.lit(0.00002), F.lit(-0.1), F.col("l_quantity") + 5).alias("toa"), sp.brightness_temperature(F.col("l_quantity") / 5, F.lit(774.8853), F.lit(1321.0789)).alias("kelvin"),
        sp.bit_any(F.col("l_linenumber") * 5).alias("masked"), sp.offset_by_date(F.to_date("l_shipdate"), since="1998-01-01").alias("offset"),
    ))


def relative_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar scenes: labels, over cells whose first band is backscatter."""
    c = bands(spark, sf_dir).select("label", (F.get("bands", 0) * F.get("bands", 0)).alias("linear"), F.expr("vec_id % 4 = 0").alias("land"))
    stats = sc.radar_gates(sc.radar_scene_stats(c, ["label"]), 0.5)
    from scenespark.operators.contrasts import relative_position

    pos, verdict = relative_position(F.col("water_median_db"), F.col("water_p5_db"), F.col("water_p95_db"))
    return r6(stats.withColumn("position", pos).withColumn("verdict", verdict))


def block_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 rasters in blocks of three, the last rows and columns cut off."""
    g = grid(spark, sf_dir)
    mean = sc.pool(g, ["vec_id"], ["v"], 3, 8, 8)
    major = sc.pool(g.withColumn("b", F.col("v") > 0), ["vec_id"], ["b"], 3, 8, 8, "majority")
    return r6(mean.join(major, ["vec_id", "y", "x"]), 9)


def grid_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of positive cells and of mixed blocks by block size."""
    g, out = grid(spark, sf_dir).withColumn("b", F.col("v") > 0), None
    for k in (2, 4):
        one = th.mixed_share(g, ["vec_id"], "b", k).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return r6(out.groupBy("k").agg(F.avg("mixed_share").alias("mixed"), F.count("*").alias("n")))


def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raster on a grid of cells 1.6 times as large, shifted by half a cell."""
    one = grid(spark, sf_dir).where("vec_id = 3").select("y", "x", "v")
    return r6(sc.nearest_cells(one, (1, 0, 0, 0, 1, 0), (1.6, 0, 0.5, 0, 1.6, 0.5), 6, 6))


def partial_read_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes (labels) whose bands disagree about values below 0.02."""
    b = bands(spark, sf_dir).select("label", F.posexplode(F.slice("bands", 1, 5)).alias("band", "v"))
    low = b.groupBy("label", "band").agg(F.avg((F.col("v") < F.when(F.col("label") % 3 == 0, F.col("band") * 0.06).otherwise(0.02)).cast("int")).alias("zero_share"))
    return sc.reject_partial(low, ["label"], spread=0.1)


def consensus_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return sc.consensus_mask(g, ["y", "x"], "v", 0.0, 0.4).withColumnRenamed("mask", "consensus").join(sc.any_mask(g, ["y", "x"], "v", 0.38), ["y", "x"])


def covered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flagged(spark, sf_dir)
    shares = sc.shares_if_covered(f, ["label"], ~F.col("cloud") & (F.col("green") > 0.05), {"wet": F.col("water"), "iced": F.col("ice_solid")}, 0.6)
    dark = sc.dark_scenes(f, ["label"], [F.col("green"), F.col("nir")], 0.2, 0.1)
    return r6(shares.join(dark, "label"))


def index_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bands(spark, sf_dir)
    return r6(b.select("vec_id", sp.index_spread(F.col("green"), F.col("swir"), F.lit(0.01), F.lit(0.02)).alias("spread"), sp.stretch(F.col("green"), 0.05, 0.6, 2.0).alias("stretched"), sp.diverging(F.col("nir"), 0.0, 0.2, 0.5).alias("ramp")).where("vec_id > 0"))


def web_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 360 - 180.0).alias("lon"), (F.col("s_suppkey") % 160 - 80.0).alias("lat"))
    t = s.withColumn("t", sp.tile_of(F.col("lon"), F.col("lat"), 6)).withColumn("b", sp.tile_bounds(F.col("t.x"), F.col("t.y"), 6)).withColumn("h", sp.height_rgb(F.col("lat") * 7.3))
    return r6(t.select("s_suppkey", "t.x", "t.y", "b.west", "b.north", F.col("h.r").alias("r"), F.col("h.g").alias("g"), F.col("h.b").alias("b")))


def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bands(spark, sf_dir).select("label", F.get("bands", 1).alias("v"))
    return r6(th.otsu(e, "v", 64, -0.5, 0.5, ["label"]))


def valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bands(spark, sf_dir).select("label", F.explode("bands").alias("v"))
    return r6(th.valley(e, "v", 32, -0.5, 0.5, 5, 0.05, ["label"]))


VIS, NIR = [0.05 * i for i in range(8)], [0.04 * i for i in range(10)]


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return th.sweep2d(bands(spark, sf_dir), "green", "nir", F.col("label") < 5, VIS, NIR)


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_sweep(spark, sf_dir))


def plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _sweep(spark, sf_dir).where("abs(y_floor) < 1e-9")
    got = th.recommend(th.plateau(one, "x_floor", "balanced", 0.01), F.lit(0.10))
    return r6(got)


def score_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bands(spark, sf_dir).withColumn("truth", F.when(F.col("label") != 9, F.col("label") < 5))
    return r6(th.score_sets(b, {"green": F.col("green") > 0.2, "both": (F.col("green") > 0.1) & (F.col("nir") > 0.17)}, F.col("truth"), F.col("vec_id") % 3 + 1.0))


def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("doy"))
    return r6(th.rank_chunks(o, ["o_totalprice", "o_orderkey"], ["o_totalprice", "doy"], 7))


def percentile_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(th.percentiles(scenes(spark, sf_dir), "solid", [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99], ["flag"]))


def encoding_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bands(spark, sf_dir)
    coarse = b.select("vec_id", *(F.round(c, 1).alias(c) for c in ("green", "nir", "swir")))
    return r6(th.band_differences(b, coarse, ["vec_id"], ["green", "nir", "swir"]))


def knn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the nearest of all cells for every cell whose id is divisible by 50."""
    b = bands(spark, sf_dir)
    return cl.knn_labels(b.where("vec_id % 50 = 0").select("vec_id", "green", "nir", "swir"), b, ["green", "nir", "swir"], "vec_id", "vec_id", "label")


def kmeans_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.kmeans_by_brightness(bands(spark, sf_dir), ["green", "nir", "swir"]).select("vec_id", "cluster")


def shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.shuffle_split(bands(spark, sf_dir).select("vec_id"), ["vec_id"], {"train": 0.8, "valid": 0.1, "test": 0.1})


def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells left of each raster (positive cells) by closing, opening, filling and the largest component."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.slice("embedding", y * 8 + 1, F.lit(8)), lambda v: v > 0))
    e = table(spark, sf_dir, "embeddings").select("vec_id", rows.alias("mask"))
    size = lambda c: F.aggregate(F.flatten(c), F.lit(0), lambda a, v: a + v.cast("int"))
    ops = {"closed": mo.close, "opened": mo.open_, "filled": mo.fill_holes, "largest": mo.largest}
    return e.select("vec_id", *(size(mo.on_raster(f, "mask")).alias(n) for n, f in ops.items()))


def unmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = {"ice": [0.9, 0.8, 0.7, 0.2, 0.1], "water": [0.1, 0.05, 0.03, 0.02, 0.01], "rock": [0.2, 0.25, 0.3, 0.35, 0.4]}
    b = bands(spark, sf_dir).select("vec_id", F.transform(F.slice("bands", 1, 5), lambda x: F.abs(x)).alias("spectrum"))
    return r6(st.unmix(b, "spectrum", members).select("vec_id", *(F.col("shares")[k].alias(k) for k in members), "rms"))


QUERIES = {f.__name__: f for f in (class_cascade, scene_summary, class_histogram, other_classifiers, band_void, reflectance, relative_db, block_pool, grid_resolution, resample, partial_read_guard, consensus_masks, covered_shares, index_uncertainty, web_tiles, otsu, valley, sweep, plateau, score_sets, deciles, percentile_battery, encoding_differences, knn_labels, kmeans_brightness, shuffle_split, morphology, unmix)}
_HIST = """h AS (SELECT label, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT label, unnest(range(0, {bins})) AS bin FROM src) b LEFT JOIN
  (SELECT label, CAST(least(floor((v + 0.5) / (1.0 / {bins})), {bins} - 1) AS INT) AS bin, count(*) AS n FROM src WHERE v BETWEEN -0.5 AND 0.5 GROUP BY ALL) c USING (label, bin))"""
_VALS = lambda xs: ", ".join(f"({float(x)!r}::DOUBLE)" for x in xs)
_SWEEP = f"""{BANDS}, g AS (SELECT x_floor, y_floor, avg(CAST(green > x_floor AND nir > y_floor AS INT)) FILTER (WHERE label < 5) AS recall, avg(CAST(green > x_floor AND nir > y_floor AS INT)) FILTER (WHERE label >= 5) AS false_rate
  FROM cell, (VALUES {_VALS(VIS)}) a(x_floor), (VALUES {_VALS(NIR)}) b(y_floor) GROUP BY ALL), s AS (SELECT *, 0.5 * (recall + 1 - false_rate) AS balanced FROM g)"""
ORACLE_SQL = {
    "class_cascade": f"""WITH {FLAGS} SELECT vec_id, round(ndsi, 6) AS ndsi, round(ndwi, 6) AS ndwi, ice_solid, ice_light, water,
  CASE WHEN water THEN 6 WHEN ice_light THEN 5 WHEN ice_solid THEN 4 WHEN cloud THEN 3 WHEN land THEN 2 WHEN nodata THEN 1 ELSE 0 END AS class_id FROM flags""",
    "scene_summary": f"""WITH {FLAGS}, c AS (SELECT label, count(*) AS total, count(*) FILTER (WHERE ice_solid) AS solid_px, count(*) FILTER (WHERE ice_light) AS light_px, count(*) FILTER (WHERE water) AS water_px, count(*) FILTER (WHERE cloud) AS cloud_px,
  count(*) FILTER (WHERE land) AS land_px, count(*) FILTER (WHERE nodata) AS nodata_px, count(*) FILTER (WHERE ice_solid OR ice_light OR water OR cloud OR land OR nodata) AS occ, count(*) FILTER (WHERE ok) AS clear_px, count(*) FILTER (WHERE ice_solid OR ice_light OR water) AS classified_px,
  avg(ndsi) FILTER (WHERE ice_solid) AS a, avg(ndsi) FILTER (WHERE ice_light) AS b, avg(ndwi) FILTER (WHERE water) AS w FROM flags GROUP BY label)
SELECT label, solid_px, light_px, water_px, cloud_px, land_px, nodata_px, solid_px + light_px + water_px + cloud_px + land_px + nodata_px - occ AS unknown_px, total - occ AS unclassified_px,
  round(solid_px / total, 6) AS solid_pct, round(light_px / total, 6) AS light_pct, round(water_px / total, 6) AS water_pct, round(cloud_px / total, 6) AS cloud_pct, round(land_px / total, 6) AS land_pct, round(nodata_px / total, 6) AS nodata_pct,
  clear_px, round(clear_px / total, 6) AS clear_pct, classified_px, CAST(classified_px / total >= 0.3 AS INT) AS usable, round(solid_px / nullif(classified_px, 0), 6) AS solid_pct_clear, round(light_px / nullif(classified_px, 0), 6) AS light_pct_clear, round(water_px / nullif(classified_px, 0), 6) AS water_pct_clear,
  round(a, 6) AS mean_ndsi_solid, round(b, 6) AS mean_ndsi_light, round(w, 6) AS mean_ndwi_water, CAST(nodata_px / total >= 0.2 AS INT) AS edge_gap FROM c""",
    "class_histogram": f"""WITH {FLAGS}, k AS (SELECT label, CASE WHEN water THEN 6 WHEN ice_light THEN 5 WHEN ice_solid THEN 4 WHEN cloud THEN 3 WHEN land THEN 2 WHEN nodata THEN 1 ELSE 0 END AS c FROM flags)
SELECT label, count(*) FILTER (WHERE c = 5) AS ice_light, count(*) FILTER (WHERE c = 6) AS water, count(*) FILTER (WHERE c = 3) AS cloud FROM k GROUP BY label""",
    "other_classifiers": f"""WITH {BANDS}, ix AS (SELECT *, (green - swir) / (green + swir + 1e-6) AS ndsi, (green - nir) / (green + nir + 1e-6) AS ndwi, green > 0.1 AND nir > 0.17 AS bright FROM cell),
f AS (SELECT label, ndsi > 0.7 AND bright AS so, ndsi > 0.4 AND ndsi < 0.7 AND bright AS li, ndsi > 0.4 AND bright AND green + swir > 0.02 AS ic, ndwi > 0.2 AND green + nir > 0.02 AS wa, ndwi > 0.2 AS wp FROM ix)
SELECT label, count(*) FILTER (WHERE so) AS solid, count(*) FILTER (WHERE li) AS light, count(*) FILTER (WHERE NOT so AND NOT li AND NOT wp) AS unclassified, count(*) FILTER (WHERE ic) AS ice, count(*) FILTER (WHERE wa AND NOT ic) AS water FROM f GROUP BY label""",
    "band_void": f"WITH {BANDS} SELECT vec_id, list_max(list_transform(bands, lambda x: abs(x))) < 0.35 AS void, CAST(list_position(bands, list_max(bands)) - 1 AS INT) AS largest FROM cell",
    "reflectance": """WITH s AS (SELECT *, l_quantity * 100 AS dn, CASE WHEN l_linenumber > 2 THEN -0.1 ELSE 0 END AS off FROM lineitem)
SELECT l_orderkey, l_linenumber, round(dn / 10000 + off, 6) AS reflectance, round(greatest(dn / 10000 + off, 0), 6) AS clamped, round(CASE WHEN dn <> 0 THEN dn * 0.0000275 - 0.2 END, 6) AS level2, round((dn * 0.00002 - 0.1) / sin(radians(l_quantity + 5)), 6) AS toa,
  round(1321.0789 / ln(774.8853 / (l_quantity / 5) + 1), 6) AS kelvin, ((l_linenumber * 5) & 27) > 0 AS masked, CASE WHEN CAST(l_shipdate AS DATE) >= DATE '1998-01-01' THEN -0.1::DOUBLE ELSE 0.0::DOUBLE END AS "offset" FROM s""",
    "relative_db": f"""WITH {BANDS}, d AS (SELECT label, vec_id % 4 = 0 AS land, CASE WHEN bands[1] * bands[1] > 1e-8 THEN 10 * log10(bands[1] * bands[1]) END AS db FROM cell),
s AS (SELECT label, avg(CAST(db IS NOT NULL AS INT)) AS valid_share, count(db) FILTER (WHERE NOT land) AS water_cells, count(db) FILTER (WHERE land) AS land_cells, quantile_cont(db, 0.5) FILTER (WHERE NOT land) AS m, quantile_cont(db, 0.05) FILTER (WHERE NOT land) AS p5, quantile_cont(db, 0.95) FILTER (WHERE NOT land) AS p95, median(db) FILTER (WHERE land) AS l FROM d GROUP BY label),
r AS (SELECT *, CASE WHEN valid_share < 0.5 THEN 'valid share' WHEN m IS NULL THEN 'no water median' WHEN coalesce(l - m <= 0, TRUE) THEN 'land contrast' END AS reject_reason, (m - p5) / nullif(p95 - p5, 0) AS pos FROM s)
SELECT label, round(valid_share, 6) AS valid_share, water_cells, land_cells, round(m, 6) AS water_median_db, round(p5, 6) AS water_p5_db, round(p95, 6) AS water_p95_db, round(l, 6) AS land_median_db, round(l - m, 6) AS land_contrast_db, reject_reason, reject_reason IS NULL AS passes_gates,
  round(pos, 6) AS position, CASE WHEN pos >= 0.75 THEN 'ice' WHEN pos <= 0.25 THEN 'water' WHEN pos IS NOT NULL THEN 'between' END AS verdict FROM r""",
    "block_pool": f"WITH {GRID} SELECT vec_id, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, round(avg(v), 9) AS v, avg(CAST(v > 0 AS INT)) >= 0.5 AS b FROM grid WHERE y < 6 AND x < 6 GROUP BY vec_id, y // 3, x // 3",
    "grid_resolution": f"""WITH {GRID}, b AS (SELECT k, vec_id, y // k AS by_, x // k AS bx, avg(CAST(v > 0 AS INT)) AS m FROM grid, (VALUES (2), (4)) t(k) GROUP BY ALL), s AS (SELECT k, vec_id, avg(CAST(m > 0 AND m < 1 AS INT)) AS mixed FROM b GROUP BY ALL)
SELECT k, round(avg(mixed), 6) AS mixed, count(*) AS n FROM s GROUP BY k""",
    "resample": f"""WITH {GRID}, t AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(floor((y + 0.5) * 1.6 + 0.5) AS INT) AS sy, CAST(floor((x + 0.5) * 1.6 + 0.5) AS INT) AS sx FROM range(0, 6) a(y), range(0, 6) b(x))
SELECT t.y, t.x, round(g.v, 6) AS v FROM t JOIN grid g ON g.vec_id = 3 AND g.y = t.sy AND g.x = t.sx""",
    "partial_read_guard": f"""WITH {BANDS}, l AS (SELECT label, i - 1 AS band, bands[i] AS v FROM (SELECT label, bands, unnest(range(1, 6)) AS i FROM cell)), z AS (SELECT label, band, avg(CAST(v < CASE WHEN label % 3 = 0 THEN band * 0.06 ELSE 0.02 END AS INT)) AS z FROM l GROUP BY ALL),
m AS (SELECT *, median(z) OVER (PARTITION BY label) AS m FROM z) SELECT label, bool_or((z >= 0.95 AND m <= 0.5) OR z - m > 0.1) AS rejected FROM m GROUP BY label""",
    "consensus_masks": f"WITH {GRID} SELECT y, x, quantile_cont(v, 0.4) > 0 AS consensus, bool_or(v > 0.38) AS mask FROM grid GROUP BY y, x",
    "covered_shares": f"""WITH {FLAGS}, g AS (SELECT label, avg(CAST(NOT cloud AND green > 0.05 AS INT)) AS coverage, avg(CAST(water AS INT)) FILTER (WHERE NOT cloud AND green > 0.05) AS wet, avg(CAST(ice_solid AS INT)) FILTER (WHERE NOT cloud AND green > 0.05) AS iced, avg(CAST(green + nir < 0.2 AS INT)) AS d FROM flags GROUP BY label)
SELECT label, round(coverage, 6) AS coverage, round(CASE WHEN coverage >= 0.6 THEN wet END, 6) AS wet, round(CASE WHEN coverage >= 0.6 THEN iced END, 6) AS iced, round(d, 6) AS dark_share, d >= 0.1 AS skip FROM g""",
    "index_uncertainty": f"""WITH {BANDS} SELECT vec_id, round(sqrt(pow(2 * swir / ((green + swir) * (green + swir)) * 0.01, 2) + pow(2 * green / ((green + swir) * (green + swir)) * 0.02, 2)), 6) AS spread, round(sqrt(least(greatest((green - 0.05) / 0.55, 0), 1)), 6) AS stretched,
  round(CASE WHEN nir < 0.2 THEN greatest((nir - 0.2) / 0.2, -1) ELSE least((nir - 0.2) / 0.3, 1) END, 6) AS ramp FROM cell WHERE vec_id > 0""",
    "web_tiles": """WITH s AS (SELECT s_suppkey, s_suppkey % 360 - 180.0::DOUBLE AS lon, s_suppkey % 160 - 80.0::DOUBLE AS lat FROM supplier),
t AS (SELECT *, CAST(least(greatest(floor((lon + 180) / 360 * 64), 0), 63) AS INT) AS x, CAST(least(greatest(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 64), 0), 63) AS INT) AS y, CAST(least(greatest(round_even((lat * 7.3 + 10000) / 0.1, 0), 0), 16777215) AS INT) AS v FROM s)
SELECT s_suppkey, x, y, round(x / 64 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 64)))), 6) AS north, (v >> 16) & 255 AS r, (v >> 8) & 255 AS g, v & 255 AS b FROM t""",
    "otsu": f"""WITH {BANDS}, src AS (SELECT label, bands[2] AS v FROM cell), {_HIST.format(bins=64)}, p AS (SELECT label, bin, -0.5 + (bin + 0.5) / 64 AS c, n / sum(n) OVER (PARTITION BY label) AS p FROM h),
o AS (SELECT *, sum(p) OVER r AS om, sum(p * c) OVER r AS mu, sum(p * c) OVER (PARTITION BY label) AS mt FROM p WINDOW r AS (PARTITION BY label ORDER BY bin ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN om > 0 AND om < 1 THEN pow(mt * om - mu, 2) / (om * (1 - om)) END AS b, sum(p * pow(c - mt, 2)) OVER (PARTITION BY label) AS var FROM o), m AS (SELECT *, max(b) OVER (PARTITION BY label) AS best FROM b),
t AS (SELECT label, list(c ORDER BY c) FILTER (WHERE b >= best - 1e-12) AS t, max(best) / max(var) AS eta FROM m GROUP BY label) SELECT label, round(t[len(t) // 2 + 1], 6) AS threshold, round(eta, 6) AS eta FROM t""",
    "valley": f"""WITH {BANDS}, src AS (SELECT label, unnest(bands) AS v FROM cell), {_HIST.format(bins=32)}, s AS (SELECT label, bin, sum(n) OVER (PARTITION BY label ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS s FROM h),
k AS (SELECT *, coalesce(s > lag(s) OVER w AND s >= lead(s) OVER w AND s >= 0.05 * max(s) OVER (PARTITION BY label), FALSE) AS peak FROM s WINDOW w AS (PARTITION BY label ORDER BY bin)),
p AS (SELECT label, list(bin ORDER BY s DESC, bin DESC) FILTER (WHERE peak) AS p, count(*) FILTER (WHERE peak) AS modes FROM k GROUP BY label),
z AS (SELECT k.label, k.bin, k.s, min(k.s) OVER (PARTITION BY k.label) AS low FROM k JOIN p ON k.label = p.label AND p.modes >= 2 AND k.bin BETWEEN least(p.p[1], p.p[2]) AND greatest(p.p[1], p.p[2])),
t AS (SELECT label, list(bin ORDER BY bin) FILTER (WHERE s <= low + 1e-12) AS t FROM z GROUP BY label) SELECT p.label, round(-0.5 + (t[len(t) // 2 + 1] + 0.5) / 32, 6) AS valley, CAST(modes AS INT) AS modes FROM p LEFT JOIN t ON p.label = t.label""",
    "sweep": f"WITH {_SWEEP} SELECT round(x_floor, 6) AS x_floor, round(y_floor, 6) AS y_floor, round(recall, 6) AS recall, round(false_rate, 6) AS false_rate, round(balanced, 6) AS balanced FROM s",
    "plateau": f"""WITH {_SWEEP}, o AS (SELECT *, max(balanced) OVER () AS best FROM s WHERE y_floor = 0), p AS (SELECT min(x_floor) AS lo, max(x_floor) AS hi, max(best) AS best FROM o WHERE balanced >= best - 0.01)
SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round(best, 6) AS best, CASE WHEN 0.1 BETWEEN lo AND hi THEN 'keep' ELSE 'move' END AS action, round(CASE WHEN 0.1 BETWEEN lo AND hi THEN 0.1 ELSE (lo + hi) / 2 END, 6) AS value FROM p""",
    "score_sets": f"""WITH {BANDS}, t AS (SELECT label < 5 AS truth, vec_id % 3 + 1.0::DOUBLE AS w, green > 0.2 AS a, green > 0.1 AND nir > 0.17 AS b FROM cell WHERE label <> 9), u AS (SELECT 'green' AS candidate, truth, w, a AS hit FROM t UNION ALL SELECT 'both', truth, w, b FROM t)
SELECT candidate, round(sum(w) FILTER (WHERE truth AND hit) / sum(w) FILTER (WHERE truth), 6) AS recall, round(coalesce(sum(w) FILTER (WHERE NOT truth AND hit), 0) / sum(w) FILTER (WHERE NOT truth), 6) AS false_rate, round(sum(w) FILTER (WHERE truth = hit) / sum(w), 6) AS accuracy FROM u GROUP BY candidate""",
    "deciles": """WITH a AS (SELECT o_totalprice, CAST(dayofyear(o_orderdate) AS DOUBLE) AS doy, ntile(7) OVER (ORDER BY o_totalprice, o_orderkey) AS c FROM orders)
SELECT CAST(c AS INT) AS chunk, count(*) AS n, round(median(o_totalprice), 6) AS o_totalprice, round(median(doy), 6) AS doy FROM a GROUP BY c""",
    "percentile_battery": "SELECT l_returnflag AS flag, p, round(v, 6) AS value FROM (SELECT l_returnflag, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS p, unnest(quantile_cont(l_quantity, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS v FROM lineitem GROUP BY l_returnflag)",
    "encoding_differences": f"""WITH {BANDS}, d AS (SELECT 'green' AS band, abs(green - round(green, 1)) AS d FROM cell UNION ALL SELECT 'nir', abs(nir - round(nir, 1)) FROM cell UNION ALL SELECT 'swir', abs(swir - round(swir, 1)) FROM cell)
SELECT band, round(median(d), 6) AS median, round(quantile_cont(d, 0.99), 6) AS p99, round(max(d), 6) AS worst FROM d GROUP BY band""",
    "knn_labels": f"""WITH {BANDS}, n AS (SELECT q.vec_id, l.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY (q.green - l.green) * (q.green - l.green) + (q.nir - l.nir) * (q.nir - l.nir) + (q.swir - l.swir) * (q.swir - l.swir), l.vec_id) AS r FROM cell q, cell l WHERE q.vec_id % 50 = 0),
v AS (SELECT vec_id, label, count(*) AS c FROM n WHERE r <= 5 GROUP BY ALL), w AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS k FROM v) SELECT vec_id, label FROM w WHERE k = 1""",
}
