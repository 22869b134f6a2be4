"""Daily series, their gaps and their events, over purchases by user as the measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.operators import calendar as cal
from scenespark.operators import events as ev
from scenespark.plans.adapters import daily, daily_sql, r6

def r9(df: DataFrame) -> DataFrame:
    """Means of few short decimals often end in a 5 at the seventh digit."""
    return r6(df, 9)


DENSE = f"""{daily_sql()},
span AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM series GROUP BY user_id),
days AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
dense AS (SELECT d.user_id, d.day, s.value, row_number() OVER (PARTITION BY d.user_id ORDER BY d.day) AS i FROM days d LEFT JOIN series s ON d.user_id = s.user_id AND d.day = s.day),
near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS qi,
  last_value(value IGNORE NULLS) OVER b AS p, first_value(value IGNORE NULLS) OVER a AS q FROM dense
  WINDOW b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
line AS (SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN p IS NOT NULL AND q IS NOT NULL THEN p + (q - p) * (i - pi) / (qi - pi) END AS inner_v, least(i - pi, qi - i) AS far FROM near)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.densify(daily(spark, sf_dir).select("user_id", "day", "value"), ["user_id"], "day")


def calendar_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(_dense(spark, sf_dir))


def gap_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways to fill a gap, with a limit of two rows."""
    df = _dense(spark, sf_dir)
    for mode in ("each_side", "whole_gap", "inside_only"):
        df = cal.interpolate(df, ["user_id"], "day", "value", mode, 2, mode)
    return r9(df)


def climatology_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled by interpolation, then by the mean of the weekday; days 1 to 3 of the month keep what was
    measured."""
    df = cal.interpolate(_dense(spark, sf_dir), ["user_id"], "day", "value", "filled", 1).withColumn("weekday", F.weekday("day"))
    return r9(cal.climatology_fill(df, ["weekday"], "value", "filled", "final", F.dayofmonth("day") > 3).select("user_id", "day", "value", "filled", "final"))


def rolling_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cal.rolling(_dense(spark, sf_dir), ["user_id"], "day", "value", "smooth", 7, passes=2)
    return r9(cal.rolling(df, ["user_id"], "day", "value", "trail", 10, centred=False, min_periods=3))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir, "click")


def breakup_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day from which three days' values stay below 60, of at least two, after one that wasn't;
    under a fixed and an adaptive threshold."""
    df = _observed(spark, sf_dir)
    fixed = ev.breakup(df, ["user_id"], "day_no", "value", 60.0, 3, 2)
    own = ev.adaptive_threshold(df, ["user_id"], "day_no", "value", (1, 15), 40.0)
    other = ev.breakup(df.join(own, "user_id"), ["user_id"], "day_no", "value", "threshold", 3, 1).withColumnRenamed("breakup", "adaptive")
    return r9(fixed.join(other, "user_id").join(own, "user_id"))


def breakup_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as seasons: mean dates below and from user 75 for four definitions."""
    df, out = _observed(spark, sf_dir), None
    for threshold, n in ((50.0, 2), (50.0, 3), (60.0, 2), (60.0, 3)):
        one = ev.breakup(df, ["user_id"], "day_no", "value", threshold, n, 2).select("user_id", "breakup", F.lit(threshold).alias("threshold"), F.lit(n).alias("persistence"))
        out = one if out is None else out.unionByName(one)
    return r9(ev.date_shift(out, "user_id", "breakup", ["threshold", "persistence"], 75))


def persistence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.persistence_rows(_observed(spark, sf_dir), ["user_id"], "day_no", "value", 60.0, 3)


def lead_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(ev.lead_drop(_observed(spark, sf_dir), ["user_id"], "day_no", "value", 7).select("user_id", "day_no", "drop"))


def cum_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(ev.accumulated(_observed(spark, sf_dir), ["user_id"], "day_no", "value").select("user_id", "day_no", "running", "share"))


def season_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r9(ev.season_metrics(_observed(spark, sf_dir), ["user_id"], "day_no", "value", 60.0, 60.0, 3))


def binned_season_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of three days; inner gaps interpolated."""
    bins = cal.season_bins(daily(spark, sf_dir), "user_id", "day_no", "value", 1, 3, 10)
    return r9(cal.binned_means(bins, "user_id", 10, 5, 2))


def common_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (cal.season_bins(daily(spark, sf_dir, k), "user_id", "day_no", "value", 1, 3, 10) for k in ("purchase", "click"))
    return r9(cal.common_bins(a, b, "user_id"))


def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and quartiles of each day over all users."""
    got = _observed(spark, sf_dir).groupBy("day_no").agg(F.avg("value").alias("mean"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.stddev_samp("value").alias("sd"))
    return r9(got.select("day_no", "mean", F.get("q", 0).alias("q25"), F.get("q", 1).alias("q75"), (F.col("sd") / F.col("mean")).alias("cv"), F.to_date(cal.day_of(F.lit(2024), F.col("day_no"))).alias("day")))


def piecewise_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    return r9(_observed(spark, sf_dir).select("user_id", "day_no", cal.piecewise(x, [20.0, 50.0, 90.0], [0.0, 0.3, 1.0]).alias("y"), cal.cut(x, [0.0, 25.0, 50.0, 75.0]).alias("bin"), cal.bin_of(F.col("day_no"), 5, 7, 3).alias("week")))


QUERIES = {f.__name__: f for f in (calendar_densify, gap_interp, climatology_fill, rolling_twice, breakup_calendar, breakup_shift, persistence_rows, lead_drop, cum_share, season_metrics, binned_season_means, common_bins, climatology, piecewise_lookup)}


def _breakup_sql(threshold: str, n: int, least: int, source: str = "series") -> str:
    return f"""(SELECT user_id, min(CASE WHEN value < {threshold} AND frozen = 1 AND most < {threshold} AND cnt >= {least} THEN day_no END) AS breakup FROM (
  SELECT *, max(CAST(value >= {threshold} AS INT)) OVER (PARTITION BY user_id ORDER BY day_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS frozen,
  max(value) OVER w AS most, count(*) OVER w AS cnt FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY day_no RANGE BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) GROUP BY user_id)"""


CLICKS = daily_sql("click")


def _bins_sql(kind: str, name: str) -> str:
    return f"""{daily_sql(kind, name + "_s")}, {name}_m AS (SELECT user_id, CAST(least(greatest((day_no - 1) // 3, 0), 9) AS INT) AS bin, avg(value) AS value FROM {name}_s GROUP BY ALL),
{name} AS (SELECT u.user_id, u.bin, m.value, row_number() OVER (PARTITION BY u.user_id ORDER BY u.bin) AS i FROM (SELECT DISTINCT user_id, unnest(range(0, 10)) AS bin FROM {name}_s) u LEFT JOIN {name}_m m ON u.user_id = m.user_id AND u.bin = m.bin)"""


ORACLE_SQL = {
    "calendar_densify": f"WITH {DENSE} SELECT user_id, day, round(value, 9) AS value FROM dense",
    "gap_interp": f"""WITH {DENSE} SELECT user_id, day, round(value, 9) AS value, round(CASE WHEN coalesce(far, i - pi, qi - i) <= 2 THEN coalesce(inner_v, p, q) END, 9) AS each_side,
  round(CASE WHEN value IS NOT NULL OR qi - pi - 1 <= 2 THEN inner_v END, 9) AS whole_gap, round(inner_v, 9) AS inside_only FROM line""",
    "climatology_fill": f"""WITH {DENSE}, f AS (SELECT *, CASE WHEN coalesce(far, i - pi, qi - i) <= 1 THEN coalesce(inner_v, p, q) END AS filled, isodow(day) AS w FROM line), m AS (SELECT w, avg(value) AS c FROM f GROUP BY w)
SELECT user_id, day, round(value, 9) AS value, round(filled, 9) AS filled, round(CASE WHEN day(day) > 3 THEN coalesce(filled, c) ELSE value END, 9) AS final FROM f JOIN m ON f.w = m.w""",
    "rolling_twice": f"""WITH {DENSE}, a AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s1,
  CASE WHEN count(value) OVER t >= 3 THEN avg(value) OVER t END AS trail FROM dense WINDOW t AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT user_id, day, round(value, 9) AS value, round(avg(s1) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) AS smooth, round(trail, 9) AS trail FROM a""",
    "breakup_calendar": f"""WITH {CLICKS}, t AS (SELECT user_id, CASE WHEN count(value) FILTER (WHERE day_no <= 15) < 3 THEN 40.0 ELSE greatest(avg(value) FILTER (WHERE day_no <= 15) - 2 * stddev_samp(value) FILTER (WHERE day_no <= 15), 40.0) END AS threshold FROM series GROUP BY user_id),
st AS (SELECT s.*, t.threshold FROM series s JOIN t ON s.user_id = t.user_id)
SELECT a.user_id, a.breakup, b.breakup AS adaptive, round(t.threshold, 9) AS threshold FROM {_breakup_sql("60", 3, 2)} a JOIN {_breakup_sql("threshold", 3, 1, "st")} b ON a.user_id = b.user_id JOIN t ON a.user_id = t.user_id""",
    "breakup_shift": "WITH "
    + CLICKS
    + ", d AS ("
    + " UNION ALL ".join(f"SELECT user_id, breakup, CAST({t} AS DOUBLE) AS threshold, {n} AS persistence FROM {_breakup_sql(str(t), n, 2)}" for t in (50, 60) for n in (2, 3))
    + """), g AS (SELECT threshold, persistence, avg(breakup) FILTER (WHERE user_id < 75) AS e, avg(breakup) FILTER (WHERE user_id >= 75) AS l, count(*) FILTER (WHERE breakup IS NULL) AS censored FROM d GROUP BY ALL)
SELECT threshold, persistence, round(e, 9) AS early, round(l, 9) AS late, round(l - e, 9) AS shift, censored FROM g""",
    "persistence_rows": f"""WITH {CLICKS}, a AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY day_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS most, row_number() OVER (PARTITION BY user_id ORDER BY day_no) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM series)
SELECT user_id, min(CASE WHEN most < 60 AND i <= n - 3 THEN day_no END) AS start FROM a GROUP BY user_id""",
    "lead_drop": f"WITH {CLICKS} SELECT user_id, day_no, round(value - lead(value, 7) OVER (PARTITION BY user_id ORDER BY day_no), 9) AS drop FROM series",
    "cum_share": f"""WITH {CLICKS}, a AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY day_no ROWS UNBOUNDED PRECEDING) AS r, sum(value) OVER (PARTITION BY user_id) AS t FROM series)
SELECT user_id, day_no, round(r, 9) AS running, round(r / nullif(t, 0), 9) AS share FROM a""",
    "season_metrics": f"""WITH {CLICKS}, a AS (SELECT *, value - lead(value, 3) OVER w AS dr, max(value) OVER (PARTITION BY user_id ORDER BY day_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS most, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM series WINDOW w AS (PARTITION BY user_id ORDER BY day_no)),
g AS (SELECT user_id, avg(value) AS m, count(*) FILTER (WHERE value >= 60) AS ice_days, min(day_no) FILTER (WHERE value >= 60) AS first_high, count(value) AS days, max(dr) AS steep, min(CASE WHEN most < 60 AND i <= n - 3 THEN day_no END) AS low_start FROM a GROUP BY user_id)
SELECT user_id, round(m, 9) AS mean, ice_days, first_high, days, round(steep, 9) AS steepest_drop, low_start, low_start - first_high AS length FROM g""",
    "binned_season_means": f"""WITH {_bins_sql("purchase", "b")}, n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER x AS pi, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER y AS qi, last_value(value IGNORE NULLS) OVER x AS p, first_value(value IGNORE NULLS) OVER y AS q FROM b
  WINDOW x AS (PARTITION BY user_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), y AS (PARTITION BY user_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN p IS NOT NULL AND q IS NOT NULL THEN p + (q - p) * (i - pi) / (qi - pi) END AS fv FROM n)
SELECT user_id, round(avg(fv), 9) AS value, count(value) AS observed FROM f GROUP BY user_id HAVING count(fv) >= 5 AND count(value) FILTER (WHERE bin >= 8) > 0""",
    "common_bins": f"""WITH {_bins_sql("purchase", "a")}, {_bins_sql("click", "b")}
SELECT a.user_id, count(*) AS shared, round(avg(a.value), 9) AS left_value, round(avg(b.value), 9) AS right_value FROM a JOIN b ON a.user_id = b.user_id AND a.bin = b.bin WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.user_id HAVING count(*) >= 5""",
    "climatology": f"""WITH {CLICKS} SELECT day_no, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.75), 9) AS q75, round(stddev_samp(value) / avg(value), 9) AS cv,
  CAST(DATE '2024-01-01' + (day_no - 1) AS DATE) AS day FROM series GROUP BY day_no""",
    "piecewise_lookup": f"""WITH {CLICKS} SELECT user_id, day_no, round(CASE WHEN value <= 20 THEN 0 WHEN value < 50 THEN (value - 20) * 0.3 / 30 WHEN value < 90 THEN 0.3 + (value - 50) * 0.7 / 40 ELSE 1 END, 9) AS y,
  CASE WHEN value >= 0 AND value < 25 THEN 0 WHEN value >= 25 AND value < 50 THEN 1 WHEN value >= 50 AND value < 75 THEN 2 END AS bin, CASE WHEN day_no < 12 THEN 0 WHEN day_no < 19 THEN 1 ELSE 2 END AS week FROM series""",
}
