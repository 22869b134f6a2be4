"""Candidates, controls, brightness and monthly figures over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark import presets as P
from scenespark.functions.spectral import brightness_temperature
from scenespark.operators import candidates as cd
from scenespark.plans.adapters import BANDS, GRID, SCENES, bands, r6, shares, table
from scenespark.sources import rasters


def role_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of spring with little ice, of spring with much, of summer with little; at most 60 a role and
    return flag."""
    s = shares(spark, sf_dir)
    spring, summer = F.col("doy").between(53, 105), F.col("doy").between(182, 243)
    roles = cd.by_role(s, {"suspect": spring & (F.col("ice_classified") < 0.65), "ice": spring & (F.col("ice_classified") > 0.97), "water": summer & (F.col("ice_classified") < 0.7)})
    return cd.cap_per_season(roles, ["role", "flag"], "season", [F.col("scene_day"), F.col("scene_id")], 60).select("role", "flag", "scene_id")


def control_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shares(spark, sf_dir).withColumn("g", cd.control_group(F.col("doy"), F.col("ice_classified"), (91, 120), (182, 212), (45, 90)))
    return r6(s.groupBy("g").agg(F.count("*").alias("n"), F.avg("ice_classified").alias("ice")))


def scrubbed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_acctbal", F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal")).alias("some"))
    return r6(cd.null_shares(cd.scrub_counts(c, ["c_acctbal", "some"]), ["c_acctbal", "some"]))


def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cd.brightness_ratio(bands(spark, sf_dir), ["green", "nir", "swir"])
    return r6(b.groupBy("label").agg(F.avg("ratio").alias("ratio"), F.count_if("is_near").alias("near"), F.count("*").alias("n")))


def tracking_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as seasons: share of wet cells at five gates, read where the gate follows the brightness."""
    gates, b = [0.1, 0.2, 0.3, 0.4, 0.5], bands(spark, sf_dir)
    curve = b.select("label", "nir", F.explode(F.array(*map(F.lit, gates))).alias("gate")).groupBy("label", "gate").agg(F.avg((F.col("nir") > F.col("gate")).cast("int")).alias("value"))
    ratio = cd.brightness_ratio(b, ["green", "nir", "swir"]).groupBy("label").agg(F.avg("ratio").alias("ratio"))
    return r6(cd.tracking_gate(curve, ratio, "label", gates, 0.3), 9)


def thermal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    kelvin = brightness_temperature(F.col("l_quantity") / 5, F.lit(774.8853), F.lit(1321.0789))
    got = cd.thermal_stats(l, ["l_returnflag", "l_linenumber"], kelvin, P.FREEZING_K)
    return r6(cd.contradicted(got.withColumn("share", F.lit(0.9)).withColumn("ice", F.col("l_linenumber") / 10), "share", "ice", "frozen_share", 0.3, 0.35, 0.53).drop("share", "ice"))


def monthly_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(cd.monthly(shares(spark, sf_dir), "scene_day", "ice_classified", (1995, 1997)))


def annual_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(cd.annual(shares(spark, sf_dir), "scene_day", "ice_classified"))


def nearest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"), "o_orderkey")
    return cd.nearest_targets(o, ["year"], "doy", "o_orderkey", 8, (53, 180))


def sensor_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = {"LC": {"nir": 5}, "LE": {"nir": 4}, "LT": {"nir": 4}}
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.get(F.array(F.lit("LC"), F.lit("LE"), F.lit("LT")), (F.col("p_partkey") % 3).cast("int")), F.lit("08_"), "p_partkey").alias("id"))
    return p.select("p_partkey", cd.band_of(F.col("id"), maps, "nir").alias("nir"))


def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4 x 4 that reach over the raster's edge, with a mask."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit(8).alias("width"))
    cells = rasters.cells_of(e, ["vec_id"], ["v"])
    win = rasters.window(cells, ["vec_id"], 5, 6, 4, 4, ["v"])
    mask = cells.where("vec_id = 0").select("y", "x", F.col("v").alias("value"))
    return r6(rasters.with_mask(win, mask))


SQL_TEXT = """WITH daily AS (SELECT season, doy, avg(ice_classified) AS frac FROM share_of WHERE share >= 0.3 AND doy BETWEEN 53 AND 180 GROUP BY season, doy),
s AS (SELECT season, avg(frac) AS value, count(frac) AS n_days FROM daily GROUP BY season) SELECT season, round(value, 6) AS value, n_days FROM s"""


def season_table_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text that the other engine runs, over the registered views."""
    from scenespark.sql import query

    return query(spark, sf_dir, SQL_TEXT)


QUERIES = {f.__name__: f for f in (role_candidates, control_groups, scrubbed_counts, brightness, tracking_gate, thermal_stats, monthly_anomaly, annual_median, nearest_targets, sensor_bands, raster_window, season_table_sql)}
_RATIO = "r AS (SELECT label, nir, (green + nir + swir) / 3 / (SELECT median((green + nir + swir) / 3) FROM cell) AS ratio FROM cell)"
ORACLE_SQL = {
    "season_table_sql": f"WITH {SCENES}, r AS ({SQL_TEXT}) SELECT * FROM r",
    "role_candidates": f"""WITH {SCENES}, c AS (SELECT 'suspect' AS role, * FROM share_of WHERE doy BETWEEN 53 AND 105 AND ice_classified < 0.65 UNION ALL SELECT 'ice', * FROM share_of WHERE doy BETWEEN 53 AND 105 AND ice_classified > 0.97
  UNION ALL SELECT 'water', * FROM share_of WHERE doy BETWEEN 182 AND 243 AND ice_classified < 0.7),
g AS (SELECT role, flag, count(*) AS n, greatest(60 // count(DISTINCT season), 1) AS k FROM c GROUP BY role, flag),
p AS (SELECT c.role, c.flag, c.scene_id, n, k, count(*) OVER (PARTITION BY c.role, c.flag, season) AS m, row_number() OVER (PARTITION BY c.role, c.flag, season ORDER BY scene_day, scene_id) - 1 AS place FROM c JOIN g ON c.role = g.role AND c.flag = g.flag)
SELECT role, flag, scene_id FROM p WHERE n <= 60 OR m <= k OR list_contains(list_transform(range(0, k), lambda i: CAST(round_even(i * (m - 1) / greatest(k - 1, 1)::DOUBLE, 0) AS BIGINT)), place)""",
    "control_groups": f"""WITH {SCENES}, g AS (SELECT ice_classified AS ice, CASE WHEN doy BETWEEN 91 AND 120 AND ice_classified < 0.9 THEN 'april anchor, outlier' WHEN doy BETWEEN 91 AND 120 THEN 'april anchor, control' WHEN doy BETWEEN 182 AND 212 THEN 'july anchor, control'
  WHEN doy BETWEEN 45 AND 90 AND ice_classified < 0.15 THEN 'winter, anomaly' WHEN doy BETWEEN 45 AND 90 THEN 'winter, ordinary' ELSE 'season, ordinary' END AS g FROM share_of) SELECT g, count(*) AS n, round(avg(ice), 6) AS ice FROM g GROUP BY g""",
    "scrubbed_counts": """SELECT 'c_acctbal' AS "column", round(avg(CAST(c_acctbal < 0 AS INT)), 6) AS share FROM customer UNION ALL SELECT 'some', round(avg(CAST(c_acctbal < 0 OR c_custkey % 9 = 0 AS INT)), 6) FROM customer""",
    "brightness": f"WITH {BANDS}, {_RATIO} SELECT label, round(avg(ratio), 6) AS ratio, count(*) FILTER (WHERE abs(ratio - 1) <= 0.05) AS near, count(*) AS n FROM r GROUP BY label",
    "tracking_gate": f"""WITH {BANDS}, {_RATIO}, b AS (SELECT label, avg(ratio) * 0.3 AS gate, [avg(CAST(nir > 0.1 AS INT)), avg(CAST(nir > 0.2 AS INT)), avg(CAST(nir > 0.3 AS INT)), avg(CAST(nir > 0.4 AS INT)), avg(CAST(nir > 0.5 AS INT))] AS y FROM r GROUP BY label),
t AS (SELECT label, gate, y[3] AS f, CASE WHEN gate <= 0.1 THEN y[1] WHEN gate >= 0.5 THEN y[5] ELSE y[CAST(floor(gate * 10) AS INT)] + (y[CAST(floor(gate * 10) AS INT) + 1] - y[CAST(floor(gate * 10) AS INT)]) * (gate * 10 - floor(gate * 10)) END AS g FROM b)
SELECT label, round(gate, 9) AS gate, round(f, 9) AS at_fixed, round(g, 9) AS at_gate, round(g - f, 9) AS shift FROM t""",
    "thermal_stats": """WITH k AS (SELECT l_returnflag, l_linenumber, 1321.0789 / ln(774.8853 / (l_quantity / 5) + 1) AS k FROM lineitem WHERE l_quantity > 0), s AS (SELECT l_returnflag, l_linenumber, median(k) AS m, count(*) AS n, avg(CAST(k < 271.35 AS INT)) AS f FROM k GROUP BY ALL)
SELECT l_returnflag, l_linenumber, round(m, 6) AS kelvin, n AS thermal_cells, round(f, 6) AS frozen_share, round(m - 273.15, 6) AS celsius, l_linenumber / 10 < 0.35 AND f > 0.53 AS contradicted FROM s""",
    "monthly_anomaly": f"""WITH {SCENES}, m AS (SELECT CAST(year(scene_day) AS INT) AS year, CAST(month(scene_day) AS INT) AS month, avg(ice_classified) AS m FROM share_of GROUP BY ALL), b AS (SELECT month, avg(m) AS b FROM m WHERE year BETWEEN 1995 AND 1997 GROUP BY month)
SELECT year, m.month, round(m, 6) AS mean, round(m - b, 6) AS anomaly FROM m LEFT JOIN b ON m.month = b.month""",
    "annual_median": f"""WITH {SCENES} SELECT CAST(year(scene_day) AS INT) AS year, count(*) AS n, round(avg(ice_classified), 6) AS mean, round(median(ice_classified), 6) AS median,
  round(stddev_samp(ice_classified) / avg(ice_classified), 6) AS cv FROM share_of WHERE ice_classified IS NOT NULL GROUP BY 1""",
    "sensor_bands": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 4 END AS nir FROM part",
    "raster_window": f"""WITH {GRID}, w AS (SELECT v.vec_id, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x FROM (SELECT vec_id FROM embeddings) v, range(0, 4) a(y), range(0, 4) b(x))
SELECT w.vec_id, w.y, w.x, round(g.v, 6) AS v, coalesce(m.v > 0, FALSE) AS land FROM w LEFT JOIN grid g ON g.vec_id = w.vec_id AND g.y = w.y + 5 AND g.x = w.x + 6 LEFT JOIN grid m ON m.vec_id = 0 AND m.y = w.y AND m.x = w.x""",
}
