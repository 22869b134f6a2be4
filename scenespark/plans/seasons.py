"""Season contrasts over line items as scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenespark import presets as P
from scenespark.operators import contrasts as ct
from scenespark.operators import inference as st
from scenespark.plans.adapters import SCENES, r6, shares

SPLIT = 1998
GATE = f"share >= {P.USABLE_SHARE}"


def _daily(spark: SparkSession, sf_dir: str, value: str = "ice_classified") -> DataFrame:
    return ct.daily_means(shares(spark, sf_dir), "season", "doy", value, P.SEASON, F.expr(GATE))


def _seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.season_table(_daily(spark, sf_dir), "season", "doy", "ice_classified", P.SEASON)


SEASONS = f"""{SCENES},
daily AS (SELECT season, doy, avg(ice_classified) AS frac FROM share_of WHERE {GATE} AND doy BETWEEN 53 AND 180 GROUP BY season, doy),
seasons AS (SELECT season, avg(frac) AS value, count(frac) AS n_days FROM daily GROUP BY season)"""


def season_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ct.period_decline(_seasons(spark, sf_dir), "season", SPLIT, digits=6)
    return got.select("early_mean", "late_mean", "decline_pct")


def season_decline_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.period_decline(_seasons(spark, sf_dir), "season", SPLIT, "by_days", digits=6).select("early_mean", "late_mean", "decline_pct", "n_early", "n_late")


def season_decline_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons as means weighted by the classified share."""
    rows = shares(spark, sf_dir).where(F.col("doy").between(*P.SEASON))
    return r6(ct.period_decline(ct.weighted_seasons(rows, "season", "ice_classified", "share"), "season", SPLIT)).select("early_mean", "late_mean", "decline_pct")


def masked_share_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(shares(spark, sf_dir).where(GATE).groupBy("scene_day").agg(F.avg("ice_classified").alias("frac"), F.count("*").alias("n_scenes")))


def denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decline under each denominator, days pooled within a period."""
    rows = shares(spark, sf_dir).where(F.col("doy").between(*P.SEASON))
    long = rows.select("season", "doy", "share", F.inline(F.array(*(F.struct(F.lit(n).alias("denominator"), F.col(f"ice_{n}").alias("ice")) for n in ("grid", "clear", "classified")))))
    gated = long.select("season", "doy", "denominator", "ice").unionByName(long.where(GATE).where("denominator = 'classified'").select("season", "doy", F.lit("gated").alias("denominator"), "ice"))
    days = gated.groupBy("denominator", "season", "doy").agg(F.avg("ice").alias("value"))
    early, late = F.avg(F.when(F.col("season") < SPLIT, F.col("value"))), F.avg(F.when(F.col("season") >= SPLIT, F.col("value")))
    return r6(days.groupBy("denominator").agg((100 * (1 - late / early)).alias("decline_pct"), F.count("*").alias("n_days")))


def season_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days count as seen if their mean classified share is above 0.88."""
    days = shares(spark, sf_dir).where(F.col("doy").between(*P.SEASON)).groupBy("season", "doy").agg(F.avg("share").alias("s"), F.avg("ice_classified").alias("v"))
    return r6(ct.coverage(days.withColumn("frac", F.when(F.col("s") > 0.88, F.col("v"))), "season", "frac"))


CURVE = (("ice_classified", "ice_grid"), (P.SEASON, P.LIGHT_SEASON), (1998, 1999))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, windows, splits = CURVE
    days = shares(spark, sf_dir).groupBy("season", "doy").agg(*(F.avg(s).alias(s) for s in series))
    return ct.spec_curve(days, "season", "doy", series, windows, splits)


def spec_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_curve(spark, sf_dir))


def curve_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = (F.col("series") == "ice_classified") & (F.col("window") == "53-180") & (F.col("split") == 1998) & (F.col("aggregate") == "mean") & (F.col("weighting") == "equal")
    return r6(ct.rank_in_curve(_curve(spark, sf_dir).withColumn("decline_pct", F.round("decline_pct", 6)), "decline_pct", one))


_CASES = ", ".join(f"('{s}', '{a}-{b}', {a}, {b})" for s in CURVE[0] for a, b in CURVE[1])
_P = """(SELECT avg(CAST(abs(s / k - (tot - s) / (n - k)) >= abs(first / k - (tot - first) / (n - k)) - 1e-12 AS INT)) FROM
  (SELECT list_sum(list_transform(range(0, n), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN v[i + 1] ELSE 0 END)) AS s,
    list_sum(v) AS tot, list_sum(v[1:k]) AS first FROM (SELECT unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS m) WHERE bit_count(m) = k))"""
SPEC = f"""{SCENES},
days AS (SELECT season, doy, avg(ice_classified) AS ice_classified, avg(ice_grid) AS ice_grid FROM share_of GROUP BY season, doy),
cases(series, win, lo, hi) AS (VALUES {_CASES}),
long AS (SELECT c.series, c.win, d.season, CASE c.series WHEN 'ice_grid' THEN ice_grid ELSE ice_classified END AS v FROM days d JOIN cases c ON d.doy BETWEEN c.lo AND c.hi),
tab AS (SELECT series, win, season, avg(v) AS mean, median(v) AS median, count(*) AS n_days FROM long WHERE v IS NOT NULL GROUP BY ALL),
vals AS (SELECT series, win, season, n_days, 'mean' AS aggregate, mean AS value FROM tab UNION ALL SELECT series, win, season, n_days, 'median', median FROM tab),
cut AS (SELECT *, s.split FROM vals, (VALUES (1998), (1999)) s(split)),
arr AS (SELECT series, win, aggregate, split, list(value ORDER BY season) AS v, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (WHERE season < split) AS INT) AS k,
  avg(value) FILTER (WHERE season < split) AS e1, avg(value) FILTER (WHERE season >= split) AS l1,
  sum(value * n_days) FILTER (WHERE season < split) / sum(n_days) FILTER (WHERE season < split) AS e2, sum(value * n_days) FILTER (WHERE season >= split) / sum(n_days) FILTER (WHERE season >= split) AS l2
  FROM cut GROUP BY ALL),
curve AS (SELECT series, win AS "window", split, aggregate, w.weighting, CAST(k AS BIGINT) AS n_early, CAST(n - k AS BIGINT) AS n_late,
  round(100 * (1 - CASE w.weighting WHEN 'equal' THEN l1 / e1 ELSE l2 / e2 END), 6) AS decline_pct, round({_P}, 6) AS permutation_p FROM arr, (VALUES ('equal'), ('by_days')) w(weighting))"""


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(ct.leave_one_out(_seasons(spark, sf_dir), "season", SPLIT))


def exact_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _seasons(spark, sf_dir).withColumn("k", F.count_if(F.col("season") < SPLIT).over(Window.partitionBy()))
    return r6(ct.split_sums(t, [], "season", "value", "k"))


def mann_kendall_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.mann_kendall(_seasons(spark, sf_dir), "season", "value", p_value=False))


def mann_kendall_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.mann_kendall(_seasons(spark, sf_dir), "season", "value"))


def scenario_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decline if doubtful scenes were frozen, or half frozen."""
    from scenespark.plans.adapters import scenes

    doubtful = F.col("doy").between(100, 120) & (F.col("solid") < 10)
    rows = ct.denominators(ct.scenarios(scenes(spark, sf_dir), {"frozen": (doubtful, 1.0), "half": (doubtful, 0.5)}))
    table = ct.season_table(rows, "season", "doy", "ice_classified", P.SEASON, by=["scenario"])
    return r6(ct.period_decline(table, "season", SPLIT, by=["scenario"])).select("scenario", "early_mean", "late_mean", "decline_pct")


def gate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decline at several positions of the visibility gate."""
    rows = shares(spark, sf_dir).withColumn("gate", F.explode(F.array(*map(F.lit, (0.3, 0.8, 0.9, 0.95))))).where("share >= gate")
    table = ct.season_table(rows, "season", "doy", "ice_classified", P.SEASON, by=["gate"])
    return r6(ct.implied_by_gate(table, "season", "gate", SPLIT)).select("gate", "n_early", "n_late", "decline_pct")


QUERIES = {f.__name__: f for f in (season_decline, season_decline_by_days, season_decline_weighted, masked_share_by_day, denominators, season_coverage, spec_curve, curve_rank, leave_one_out, exact_permutation, mann_kendall_s, mann_kendall_p, scenario_decline, gate_positions)}
_FROZEN = "CASE WHEN doy BETWEEN 100 AND 120 AND solid < 10 THEN {} ELSE (solid + light) / nullif(solid + light + water, 0) END"
ORACLE_SQL = {
    "season_decline": f"""WITH {SEASONS}, p AS (SELECT avg(CASE WHEN season < {SPLIT} THEN value END) AS early, avg(CASE WHEN season >= {SPLIT} THEN value END) AS late FROM seasons)
SELECT round(early, 6) AS early_mean, round(late, 6) AS late_mean, round(100 * (1 - late / nullif(early, 0)), 6) AS decline_pct FROM p""",
    "season_decline_by_days": f"""WITH {SEASONS}, p AS (SELECT sum(value * n_days) FILTER (WHERE season < {SPLIT}) / sum(n_days) FILTER (WHERE season < {SPLIT}) AS e,
  sum(value * n_days) FILTER (WHERE season >= {SPLIT}) / sum(n_days) FILTER (WHERE season >= {SPLIT}) AS l, count(*) FILTER (WHERE season < {SPLIT}) AS n_early, count(*) FILTER (WHERE season >= {SPLIT}) AS n_late FROM seasons)
SELECT round(e, 6) AS early_mean, round(l, 6) AS late_mean, round(100 * (1 - l / e), 6) AS decline_pct, n_early, n_late FROM p""",
    "season_decline_weighted": f"""WITH {SCENES}, s AS (SELECT season, sum(ice_classified * share) / sum(share) AS value FROM share_of WHERE doy BETWEEN 53 AND 180 GROUP BY season),
p AS (SELECT avg(value) FILTER (WHERE season < {SPLIT}) AS e, avg(value) FILTER (WHERE season >= {SPLIT}) AS l FROM s)
SELECT round(e, 6) AS early_mean, round(l, 6) AS late_mean, round(100 * (1 - l / e), 6) AS decline_pct FROM p""",
    "masked_share_by_day": f"WITH {SCENES} SELECT scene_day, round(avg(ice_classified), 6) AS frac, count(*) AS n_scenes FROM share_of WHERE {GATE} GROUP BY scene_day",
    "denominators": f"""WITH {SCENES}, long AS (SELECT season, doy, 'grid' AS denominator, ice_grid AS ice FROM share_of UNION ALL SELECT season, doy, 'clear', ice_clear FROM share_of
  UNION ALL SELECT season, doy, 'classified', ice_classified FROM share_of UNION ALL SELECT season, doy, 'gated', ice_classified FROM share_of WHERE {GATE}),
days AS (SELECT denominator, season, doy, avg(ice) AS value FROM long WHERE doy BETWEEN 53 AND 180 GROUP BY ALL)
SELECT denominator, round(100 * (1 - avg(value) FILTER (WHERE season >= {SPLIT}) / avg(value) FILTER (WHERE season < {SPLIT})), 6) AS decline_pct, count(*) AS n_days FROM days GROUP BY denominator""",
    "season_coverage": f"""WITH {SCENES}, days AS (SELECT season, doy, CASE WHEN avg(share) > 0.88 THEN avg(ice_classified) END AS frac FROM share_of WHERE doy BETWEEN 53 AND 180 GROUP BY ALL),
per AS (SELECT season, count(frac) / count(*) AS c, count(frac) AS seen, count(*) AS days FROM days GROUP BY season)
SELECT round(sum(seen) / sum(days), 6) AS coverage, round(min(c), 6) AS minimum, (SELECT season FROM per ORDER BY c, season LIMIT 1) AS minimum_season FROM per""",
    "spec_curve": f"WITH {SPEC} SELECT * FROM curve",
    "curve_rank": f"""WITH {SPEC}, one AS (SELECT decline_pct AS p FROM curve WHERE series = 'ice_classified' AND "window" = '53-180' AND split = 1998 AND aggregate = 'mean' AND weighting = 'equal')
SELECT round(avg(CAST(decline_pct < p AS INT)), 6) AS below, count(*) FILTER (WHERE decline_pct < p) + 1 AS rank, list_sort(list(decline_pct))[CAST(count(*) // 2 AS INT) + 1] AS upper_median FROM curve, one""",
    "leave_one_out": f"""WITH {SEASONS}, full_d AS (SELECT 100 * (1 - avg(value) FILTER (WHERE season >= {SPLIT}) / avg(value) FILTER (WHERE season < {SPLIT})) AS f FROM seasons),
kept AS (SELECT d.season AS dropped, s.season, s.value FROM seasons d JOIN seasons s ON d.season <> s.season),
arr AS (SELECT dropped, list(value ORDER BY season) AS v, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (WHERE season < {SPLIT}) AS INT) AS k,
  100 * (1 - avg(value) FILTER (WHERE season >= {SPLIT}) / avg(value) FILTER (WHERE season < {SPLIT})) AS d FROM kept GROUP BY dropped)
SELECT dropped, CASE WHEN dropped < {SPLIT} THEN 'early' ELSE 'late' END AS period, round(d, 6) AS decline_pct, round(d - f, 6) AS shift, round({_P}, 6) AS permutation_p, CAST(n AS BIGINT) AS seasons_left FROM arr, full_d""",
    "exact_permutation": f"""WITH {SEASONS}, arr AS (SELECT list(value ORDER BY season) AS v, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (WHERE season < {SPLIT}) AS INT) AS k FROM seasons),
g AS (SELECT abs(s / k - (tot - s) / (n - k)) AS g, first / k - (tot - first) / (n - k) AS gap FROM (SELECT n, k, list_sum(list_transform(range(0, n), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN v[i + 1] ELSE 0 END)) AS s, list_sum(v) AS tot,
  list_sum(v[1:k]) AS first FROM arr, (SELECT unnest(range(0, 128)) AS m) WHERE bit_count(m) = k))
SELECT round(any_value(gap), 6) AS gap, round(avg(CAST(g >= abs(gap) - 1e-12 AS INT)), 6) AS p, CAST(count(*) AS INT) AS splits, round(max(g), 6) AS widest FROM g""",
    "mann_kendall_s": f"""WITH {SEASONS}, s AS (SELECT sum(sign(b.value - a.value)) AS s FROM seasons a JOIN seasons b ON a.season < b.season), n AS (SELECT count(*) AS n FROM seasons),
t AS (SELECT coalesce(sum(c * (c - 1) * (2 * c + 5)), 0) AS t FROM (SELECT count(*) AS c FROM seasons GROUP BY value)), v AS (SELECT (n * (n - 1) * (2 * n + 5) - t) / 18.0 AS v FROM n, t)
SELECT CAST(s AS DOUBLE) AS s, round(v, 6) AS variance, round((s - sign(s)) / sqrt(v), 6) AS z FROM s, v""",
    # p by the power series of the error function
    "mann_kendall_p": f"""WITH {SEASONS}, s AS (SELECT sum(sign(b.value - a.value)) AS s FROM seasons a JOIN seasons b ON a.season < b.season), n AS (SELECT count(*) AS n FROM seasons),
t AS (SELECT coalesce(sum(c * (c - 1) * (2 * c + 5)), 0) AS t FROM (SELECT count(*) AS c FROM seasons GROUP BY value)), v AS (SELECT (n * (n - 1) * (2 * n + 5) - t) / 18.0 AS v FROM n, t),
z AS (SELECT CAST(s AS DOUBLE) AS s, v, CASE WHEN v > 0 THEN (s - sign(s)) / sqrt(v) END AS z FROM s, v), x AS (SELECT *, abs(z) / sqrt(2) AS x FROM z)
SELECT s, round(v, 6) AS variance, round(z, 6) AS z, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow(x, 2 * k + 1) / (exp(lgamma(k + 1)) * (2 * k + 1)))), 6) AS p FROM x""",
    "scenario_decline": f"""WITH {SCENES}, r AS (SELECT 'observed' AS scenario, season, doy, ice_classified AS ice FROM share_of UNION ALL SELECT 'frozen', season, doy, {_FROZEN.format("1.0")} FROM share_of
  UNION ALL SELECT 'half', season, doy, {_FROZEN.format("0.5")} FROM share_of), s AS (SELECT scenario, season, avg(ice) AS value FROM r WHERE doy BETWEEN 53 AND 180 GROUP BY ALL),
p AS (SELECT scenario, avg(value) FILTER (WHERE season < {SPLIT}) AS e, avg(value) FILTER (WHERE season >= {SPLIT}) AS l FROM s GROUP BY scenario)
SELECT scenario, round(e, 6) AS early_mean, round(l, 6) AS late_mean, round(100 * (1 - l / e), 6) AS decline_pct FROM p""",
    "gate_positions": f"""WITH {SCENES}, r AS (SELECT gate, season, ice_classified AS ice FROM share_of, (VALUES (0.3::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) g(gate) WHERE share >= gate AND doy BETWEEN 53 AND 180),
s AS (SELECT gate, season, avg(ice) AS value FROM r GROUP BY ALL)
SELECT gate, count(*) FILTER (WHERE season < {SPLIT}) AS n_early, count(*) FILTER (WHERE season >= {SPLIT}) AS n_late, round(100 * (1 - avg(value) FILTER (WHERE season >= {SPLIT}) / avg(value) FILTER (WHERE season < {SPLIT})), 6) AS decline_pct FROM s GROUP BY gate""",
}
