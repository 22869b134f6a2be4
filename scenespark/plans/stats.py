"""Correlations, tests and resampling over line items, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.operators import calendar as cal
from scenespark.operators import clusters as cl
from scenespark.operators import contrasts as ct
from scenespark.operators import inference as st
from scenespark.plans.adapters import BANDS, SCENES, bands, r6, shares, table
from scenespark.plans.seasons import SEASONS, SPLIT, _seasons


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'N')")  # noqa: E741
    return r6(st.auc(l, "l_quantity", F.col("l_returnflag") == "A", ["l_linestatus"]))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return st.average_rank(p, "p_size", by=["p_brand"]).select("p_partkey", "rank")


def mad_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.mad_spread(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linenumber"], 500))


def rmse_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.rmse_bias(shares(spark, sf_dir), "ice_classified", "ice_grid", ["season"]))


def corr_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shares(spark, sf_dir).withColumn("bin", cal.cut(F.col("doy"), [1, 60, 120, 180, 240, 367]))
    return r6(st.correlation_by(df, "share", "ice_classified", ["bin"]))


def reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season means with the first two seasons' mix of bins."""
    df = shares(spark, sf_dir).withColumn("bin", cal.cut(F.col("doy"), [1, 60, 120, 180, 240, 300])).withColumn("c", cal.cut(F.col("share"), [0.0, 0.9, 0.95, 1.1]))
    base = df.where("season <= 1996").groupBy("bin", "c").agg(F.count("*").alias("n0"))
    own = df.groupBy("season", "bin", "c").agg(F.avg("ice_classified").alias("m"), F.count("*").alias("n"))
    return r6(ct.weighted_seasons(ct.reweight(own, base.withColumn("w", F.col("n0").cast("double")), ["bin", "c"], "w"), "season", "m", "w"))


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.correlation_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = st.linear_fit(_seasons(spark, sf_dir), "season", "value")
    return r6(got.select("slope", "intercept", "r", "n"))


def linear_fit_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.linear_fit(_seasons(spark, sf_dir), "season", "value").select("slope", "p"))


def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.theil_sen(_seasons(spark, sf_dir), "season", "value"), 9)


def theil_sen_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.theil_sen_interval(_seasons(spark, sf_dir), "season", "value"), 9)


def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(st.kendall_tau(_seasons(spark, sf_dir), "season", "value"))


def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by segment and status, roles side by side."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return r6(cl.crosstab(o, ["c_mktsegment"], "o_orderstatus", ["F", "O"], F.median("o_totalprice")))


def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return r6(l.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"), F.count_distinct("l_suppkey").alias("suppliers")))


def bootstrap_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = shares(spark, sf_dir).where("doy between 53 and 80").groupBy("season", "doy").agg(F.avg("ice_classified").alias("v"))
    return st.bootstrap_se(days, "v", ["season"], 500)


def bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.bootstrap_median(bands(spark, sf_dir), "green", ["label"], 1000)


def bootstrap_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.bootstrap_decline(_seasons(spark, sf_dir).withColumn("late", F.col("season") >= SPLIT), "value", "late", draws=2000)


def mc_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bands(spark, sf_dir).where("label < 2").withColumn("g", F.col("label") == 1)
    return st.monte_carlo_medians(b, "green", "g", draws=2000)


def clustering_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bands(spark, sf_dir).withColumn("flag", F.col("green") > 0.4)
    return st.clustering_permutation(b, "label", "flag", 2000)


QUERIES = {f.__name__: f for f in (auc_rank, average_ranks, mad_spread, rmse_bias, corr_by_bin, reweighted, correlation_matrix, linear_fit, linear_fit_p, theil_sen, theil_sen_interval, kendall_tau, group_medians, rollup_counts, bootstrap_se, bootstrap_median, bootstrap_decline, mc_permutation, clustering_permutation)}
_PAIRS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CUT = "CASE WHEN doy < 60 THEN 0 WHEN doy < 120 THEN 1 WHEN doy < 180 THEN 2 WHEN doy < 240 THEN 3 {} END"
ORACLE_SQL = {
    "auc_rank": """WITH l AS (SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'N')), r AS (SELECT l_linestatus, l_returnflag, rank() OVER w + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2 AS r FROM l WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_quantity)),
g AS (SELECT l_linestatus, sum(r) FILTER (WHERE l_returnflag = 'A') AS s, count(*) FILTER (WHERE l_returnflag = 'A') AS p, count(*) FILTER (WHERE l_returnflag = 'N') AS q FROM r GROUP BY l_linestatus)
SELECT l_linestatus, round((s - p * (p + 1) / 2) / nullif(p::DOUBLE * q, 0), 6) AS auc, p AS n_positive, q AS n_negative FROM g""",
    "average_ranks": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part",
    "mad_spread": """WITH m AS (SELECT l_returnflag, l_linenumber, median(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 500)
SELECT m.l_returnflag, m.l_linenumber, round(any_value(m), 6) AS median, round(median(abs(l_extendedprice - m)) * 1.4826, 6) AS spread, any_value(n) AS cells FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag AND l.l_linenumber = m.l_linenumber GROUP BY m.l_returnflag, m.l_linenumber""",
    "rmse_bias": f"WITH {SCENES} SELECT season, round(sqrt(avg(pow(ice_classified - ice_grid, 2))), 6) AS rmse, round(avg(ice_classified - ice_grid), 6) AS bias, round(corr(ice_classified, ice_grid), 6) AS r, count(*) AS n FROM share_of GROUP BY season",
    "corr_by_bin": f"""WITH {SCENES}, b AS (SELECT *, {_CUT.format("ELSE 4")} AS bin FROM share_of), q AS (SELECT bin, quantile_cont(share, 1.0 / 3) AS lo, quantile_cont(share, 2.0 / 3) AS hi, corr(share, ice_classified) AS c, count(*) AS n FROM b GROUP BY bin)
SELECT b.bin, round(any_value(c), 6) AS corr, any_value(n) AS n, round(avg(ice_classified) FILTER (WHERE share <= lo), 6) AS lowest_third, round(avg(ice_classified) FILTER (WHERE share >= hi), 6) AS highest_third FROM b JOIN q ON b.bin = q.bin GROUP BY b.bin""",
    "reweighted": f"""WITH {SCENES}, b AS (SELECT season, ice_classified AS ice, {_CUT.format("WHEN doy < 300 THEN 4")} AS bin, CASE WHEN share < 0.9 THEN 0 WHEN share < 0.95 THEN 1 ELSE 2 END AS c FROM share_of),
w AS (SELECT bin, c, count(*) AS w FROM b WHERE season <= 1996 AND bin IS NOT NULL GROUP BY ALL), o AS (SELECT season, bin, c, avg(ice) AS m FROM b GROUP BY ALL)
SELECT season, round(sum(m * coalesce(w, 0)) / sum(coalesce(w, 0)), 6) AS value, count(m) AS n_days FROM o LEFT JOIN w ON o.bin = w.bin AND o.c = w.c GROUP BY season""",
    "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_PAIRS) for b in _PAIRS[i:]),
    "linear_fit": f"WITH {SEASONS} SELECT round(regr_slope(value, season), 6) AS slope, round(regr_intercept(value, season), 6) AS intercept, round(corr(value, season), 6) AS r, count(*) AS n FROM seasons",
    # p by the finite sums of Student's distribution for whole degrees of freedom
    "linear_fit_p": f"""WITH {SEASONS}, f AS (SELECT regr_slope(value, season) AS slope, corr(value, season) AS r, count(*) - 2 AS v FROM seasons),
a AS (SELECT slope, v, atan(abs(r) / sqrt(1 - r * r)) AS a FROM f)
SELECT round(slope, 6) AS slope, round(1 - CASE WHEN v % 2 = 1
  THEN 2 / pi() * (a + sin(a) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda j: pow(cos(a), 2 * j + 1) * exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)))), 0))
  ELSE sin(a) * list_sum(list_transform(range(0, v // 2), lambda j: pow(cos(a), 2 * j) * exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)))) END, 6) AS p FROM a""",
    "theil_sen": f"""WITH {SEASONS}, p AS (SELECT median((b.value - a.value) / (b.season - a.season)) AS s FROM seasons a JOIN seasons b ON b.season > a.season), m AS (SELECT median(season) AS x, median(value) AS y FROM seasons)
SELECT round(s, 9) AS slope, round(y - s * x, 9) AS intercept FROM p, m""",
    "theil_sen_interval": f"""WITH {SEASONS}, p AS (SELECT list_sort(list((b.value - a.value) / (b.season - a.season))) AS s FROM seasons a JOIN seasons b ON b.season > a.season),
t AS (SELECT coalesce(sum(k * (k - 1) * (2 * k + 5)), 0) AS ties FROM (SELECT count(*) AS k FROM seasons GROUP BY value)), c AS (SELECT count(*) AS n FROM seasons),
w AS (SELECT s, len(s) AS m, 1.959963984540054 * sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0) AS w FROM p, t, c)
SELECT round(list_median(s), 9) AS slope, round(s[1 + greatest(CAST(round_even((m - w) / 2, 0) AS INT) - 1, 0)], 9) AS low, round(s[1 + least(CAST(round_even((m + w) / 2, 0) AS INT), m - 1)], 9) AS high, CAST(m AS INT) AS pairs FROM w""",
    "kendall_tau": f"WITH {SEASONS} SELECT round(sum(sign(b.value - a.value) * sign(b.season - a.season)) / sqrt(sum(abs(sign(b.value - a.value))) * sum(abs(sign(b.season - a.season)))), 6) AS tau, (SELECT CAST(count(*) AS INT) FROM seasons) AS n FROM seasons a JOIN seasons b ON a.season < b.season",
    "group_medians": """SELECT c_mktsegment, round(median(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS "F", round(median(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS "O" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "rollup_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS q, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
