"""Quality gates over scene summaries made of line items, and drift of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark import presets as P
from scenespark.operators import gates as gt
from scenespark.plans.adapters import r6, table

WINTER, SUMMER = (45, 105), (160, 220)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a summary row of a grid of 200 cells; a few rows are broken on purpose."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    px = {"solid_px": F.col("l_quantity").cast("long"), "light_px": F.round(F.col("l_discount") * 100).cast("long"), "water_px": F.round(F.col("l_tax") * 100).cast("long"), "cloud_px": F.col("l_linenumber").cast("long"), "land_px": F.lit(40).cast("long")}
    s = l.select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("season"), F.dayofyear("l_shipdate").alias("doy"), *(c.alias(n) for n, c in px.items()), "l_returnflag")
    used = sum((F.col(c) for c in list(px)[1:]), F.col("solid_px"))
    s = s.withColumn("nodata_px", 200 - used).withColumn("unknown_px", F.lit(0).cast("long"))
    classified = F.col("solid_px") + F.col("light_px") + F.col("water_px")
    s = s.withColumns({c.replace("_px", "_pct"): F.round(F.col(c) / 200.0, 4) for c in P.COUNTS})
    s = s.withColumn("classified_px", F.when(F.col("l_orderkey") % 997 == 0, classified + 1).otherwise(classified)).withColumn("usable", (classified / 200.0 >= 0.3).cast("int"))
    s = s.withColumn("water_pct_clear", F.try_divide(F.col("water_px"), F.nullif(classified, F.lit(0)))).withColumn("mean_ndwi_water", F.when(F.col("l_orderkey") % 1501 == 0, 2.1).otherwise(0.5)).withColumn("mean_ndsi_solid", F.lit(0.8)).withColumn("mean_ndsi_light", F.lit(0.5))
    return s.withColumn("tile", F.concat(F.lit("2"), F.when(F.col("l_returnflag") == "R", "1").otherwise("2"), F.lit("WDD"))).withColumn("ice", F.col("solid_pct") + F.col("light_pct"))


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary(spark, sf_dir)
    inventory = s.where("season in (1996, 1997)").groupBy("season").agg(F.count("*").alias("expected")).withColumn("expected", F.col("expected") + F.when(F.col("season") == 1997, 1).otherwise(0))
    return gt.run_gates(s, [
        gt.derived(), lambda d: gt.no_duplicates(d, ["l_orderkey", "l_linenumber"], "no_duplicate_scenes"), lambda d: gt.no_duplicates(d, ["season", "doy"], "no_duplicate_dates"), lambda d: gt.tiles(d, "tile", ["22WDD"]),
        gt.ranges(), gt.indices(), gt.zeroed_band(), gt.grid(), lambda d: gt.season_shape(d, "season", "doy", "ice", WINTER, SUMMER), lambda d: gt.scene_counts(d, "season", inventory),
    ])


def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.verdict(quality_gates(spark, sf_dir))


def repair_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to repair, before and after."""
    s = summary(spark, sf_dir)
    fixed = gt.repair_derived(s)
    wrong = lambda d, name: gt.derived()(d).where("gate = 'derived_classified'").select(F.lit(name).alias("state"), "status")
    return wrong(s, "before").unionByName(wrong(fixed, "after"))


def baseline_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily ice of all scenes against that of scenes with few clouds."""
    s = summary(spark, sf_dir)
    day = lambda d: d.groupBy("season", "doy").agg(F.avg("ice").alias("ice"))
    return r6(gt.baseline_shift(day(s), day(s.where("cloud_px <= 2")), ["season", "doy"], "ice"))


def baseline_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary(spark, sf_dir)
    day = lambda d: d.groupBy("season", "doy").agg(F.round(F.avg("ice"), 9).alias("ice"))
    return gt.movers(day(s), day(s.where("cloud_px <= 2")), ["season", "doy"], "ice", 8).select("season", "doy")


def claims_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season means as nested JSON claims against the means of scenes with an even key."""
    s = summary(spark, sf_dir)
    claim = s.groupBy("season").agg(F.round(F.avg("ice"), 4).alias("mean"), F.count("*").alias("n"))
    nested = claim.select(F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("s"), F.col("season"))), F.array(F.struct(F.col("mean"), F.struct(F.col("n")).alias("counts"))))).alias("json"))
    got = s.where("l_orderkey % 2 = 0").groupBy("season").agg(F.round(F.avg("ice"), 4).alias("mean"), F.count("*").alias("n"))
    flat = got.select(F.inline(F.array(F.struct(F.concat(F.lit("s"), F.col("season"), F.lit(".mean")).alias("path"), F.col("mean").cast("string").alias("value")), F.struct(F.concat(F.lit("s"), F.col("season"), F.lit(".counts.n")).alias("path"), F.col("n").cast("string").alias("value")))))
    return gt.drift(gt.flatten_claims(nested), flat.where("path <> 's1999.mean'"), 0.002).select("path", "status")


def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return r6(gt.snapshot_drift(o, o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice"))), ["o_orderkey"], ["o_totalprice"]))


QUERIES = {f.__name__: f for f in (quality_gates, quality_verdict, repair_derived, baseline_shift, baseline_movers, claims_drift, snapshot_drift)}
_S = """l AS (SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INT) AS season, CAST(dayofyear(l_shipdate) AS INT) AS doy, CAST(l_quantity AS BIGINT) AS solid, CAST(round(l_discount * 100) AS BIGINT) AS light, CAST(round(l_tax * 100) AS BIGINT) AS water, l_linenumber AS cloud, l_returnflag FROM lineitem),
s AS (SELECT *, solid + light + water AS classified, round(solid / 200.0, 4) + round(light / 200.0, 4) AS ice, CASE WHEN l_orderkey % 1501 = 0 THEN 2.1 ELSE 0.5 END AS ndwi FROM l),
per AS (SELECT season, avg(ice) FILTER (WHERE doy BETWEEN 45 AND 105) AS w, avg(ice) FILTER (WHERE doy BETWEEN 160 AND 220) AS u, least(count(*) FILTER (WHERE doy BETWEEN 45 AND 105), count(*) FILTER (WHERE doy BETWEEN 160 AND 220)) AS n FROM s GROUP BY season),
g AS (SELECT 'derived_classified' AS gate, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, concat(n, ' rows differ') AS detail FROM (SELECT count(*) AS n FROM s WHERE l_orderkey % 997 = 0)
UNION ALL SELECT 'derived_usable', 'PASS', '0 rows differ'
UNION ALL SELECT 'no_duplicate_scenes', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, concat(n, ' keys repeat') FROM (SELECT count(*) AS n FROM (SELECT 1 FROM s GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'no_duplicate_dates', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, concat(n, ' keys repeat') FROM (SELECT count(*) AS n FROM (SELECT 1 FROM s GROUP BY season, doy HAVING count(*) > 1))
UNION ALL SELECT 'tiles', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, concat(n, ' foreign rows') FROM (SELECT count(*) AS n FROM s WHERE l_returnflag = 'R')
UNION ALL SELECT 'tiles_mixed', CASE WHEN n > 1 THEN 'WARN' ELSE 'PASS' END, concat(n, ' tiles, at most ', most, ' % of rows in one') FROM (SELECT count(*) AS n, CAST(round(100 * (max(k) / sum(k))) AS INT) AS most FROM (SELECT count(*) AS k FROM s GROUP BY l_returnflag = 'R'))
UNION ALL SELECT 'ranges', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, concat(n, ' values out of range') FROM (SELECT count(*) FILTER (WHERE ice > 1) + count(*) FILTER (WHERE 160 - classified - cloud < 0) * 2 AS n FROM s)
UNION ALL SELECT 'indices', CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END, concat(n, ' index means beyond -1 to 1') FROM (SELECT count(*) AS n FROM s WHERE ndwi > 1)
UNION ALL SELECT 'zeroed_band', 'PASS', '0 scenes' UNION ALL SELECT 'grid', 'PASS', '0 rows with two grids' UNION ALL SELECT 'grid_accounting', 'PASS', '0 rows over the grid'
UNION ALL SELECT 'season_shape', CASE WHEN count(*) FILTER (WHERE n >= 5 AND NOT w > u) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE n >= 5) > 0 THEN 'PASS' ELSE 'WARN' END, concat(count(*) FILTER (WHERE n >= 5 AND NOT w > u), ' of ', count(*) FILTER (WHERE n >= 5), ' seasons upside down') FROM per
UNION ALL SELECT 'season_shape_thin', CASE WHEN count(*) FILTER (WHERE n < 5) > 0 THEN 'WARN' ELSE 'PASS' END, concat(count(*) FILTER (WHERE n < 5), ' seasons thin') FROM per
UNION ALL SELECT 'scene_counts', 'FAIL', '1 seasons incomplete')"""
_D = "a AS (SELECT season, doy, avg(ice) AS n FROM s GROUP BY ALL), b AS (SELECT season, doy, avg(ice) AS o FROM s WHERE cloud <= 2 GROUP BY ALL)"
ORACLE_SQL = {
    "quality_gates": f"WITH {_S} SELECT * FROM g",
    "quality_verdict": f"WITH {_S} SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'REJECT' WHEN bool_or(status = 'WARN') THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict FROM g",
    "repair_derived": f"WITH {_S} SELECT 'before' AS state, status FROM g WHERE gate = 'derived_classified' UNION ALL SELECT 'after', 'PASS'",
    "baseline_shift": f"""WITH {_S}, {_D} SELECT count(*) FILTER (WHERE n IS NOT NULL AND o IS NOT NULL) AS shared, count(*) FILTER (WHERE o IS NULL) AS only_new, count(*) FILTER (WHERE n IS NULL) AS only_old,
  round(avg(n - o), 6) AS mean_shift, round(avg(abs(n - o)), 6) AS mean_abs_shift FROM a FULL JOIN b ON a.season = b.season AND a.doy = b.doy""",
    "baseline_movers": f"WITH {_S}, {_D} SELECT a.season, a.doy FROM a JOIN b ON a.season = b.season AND a.doy = b.doy ORDER BY abs(round(n, 9) - round(o, 9)) DESC, a.season, a.doy LIMIT 8",
    "claims_drift": f"""WITH {_S}, c AS (SELECT season, round(avg(ice), 4) AS m, count(*) AS n FROM s GROUP BY season), k AS (SELECT season, round(avg(ice), 4) AS m, count(*) AS n FROM s WHERE l_orderkey % 2 = 0 GROUP BY season)
SELECT concat('s', c.season, '.mean') AS path, CASE WHEN c.season <> 1999 AND abs(c.m - k.m) <= 0.002 THEN 'PASS' ELSE 'FAIL' END AS status FROM c LEFT JOIN k ON c.season = k.season
UNION ALL SELECT concat('s', c.season, '.counts.n'), CASE WHEN abs(c.n - k.n) <= 0.002 THEN 'PASS' ELSE 'FAIL' END FROM c LEFT JOIN k ON c.season = k.season""",
    "snapshot_drift": "SELECT count(*) AS rows_a, count(*) AS rows_b, round(max(CASE WHEN o_orderkey % 1000 = 7 THEN (o_totalprice + 0.5) - o_totalprice ELSE 0 END), 6) AS worst, count(*) FILTER (WHERE o_orderkey % 1000 = 7) = 0 AS same FROM orders",
}
