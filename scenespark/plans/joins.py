"""Joins in time, selections and set operations over events, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.operators import clusters as cl
from scenespark.operators import inference as st
from scenespark.operators import scenes as sc
from scenespark.operators import temporal_joins as tj
from scenespark.plans.adapters import daily, daily_sql, r6, table


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


def lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tj.lag_pairs(daily(spark, sf_dir, "click"), ["user_id"], "day", "value", (1, 2, 3, 5, 10))
    return r6(st.spread_stats(pairs, "difference", ["lag_days"]))


def asof_nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click nearest to each purchase of a user within six hours."""
    buys, clicks = (_events(spark, sf_dir, k) for k in ("purchase", "click"))
    right = clicks.select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    got = tj.asof_nearest(buys, right, "ts", ["user_id"], ["click_id", "click_value"], 6 * 3600, "event_id", "click_id")
    return r6(got.select("event_id", "user_id", "click_id", "click_value"))


def interval_match_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase days (two roles by value) take the nearest signup of any user within a day; one that both
    roles claim is withdrawn."""
    day = F.to_date("ts")
    buys = _events(spark, sf_dir, "purchase").select("event_id", day.alias("day"), F.when(F.col("value") < 50, "low").otherwise("high").alias("role"), "user_id")
    signs = _events(spark, sf_dir, "signup").select(day.alias("day"), F.col("event_id").alias("scene"), F.col("user_id").alias("scene_user"))
    asked = buys.join(signs.select(F.col("scene_user").alias("user_id")).distinct(), "user_id", "left_semi")
    found = tj.interval_match(asked.withColumn("u", F.col("user_id") % 10), signs.withColumn("su", F.col("scene_user") % 10).select("day", "scene", "su"), "day", ["event_id"], ["scene"]).drop("u", "su")
    return tj.exclude_collisions(found, "scene", "role", [F.col("event_id")]).select("event_id", "role", "scene", "offset_days", "reject_reason")


def theta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases of one user and day whose values differ by at most five."""
    a, b = (_events(spark, sf_dir, k).select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("key"), "event_id", "value") for k in ("click", "purchase"))
    pairs = tj.same_day_pairs(a, b, "key", "value", 5.0)
    return pairs.select("event_id", "event_id_b")


def value_tolerance_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (_events(spark, sf_dir, k).select(F.to_date("ts").alias("day"), "event_id", "value") for k in ("click", "purchase"))
    return tj.unique_within(a, b, ["day"], "value", 0.5, ["event_id"]).select("event_id", "event_id_b")


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in the last year and a half."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= '2000-02-01'").select(F.col("o_custkey").alias("c_custkey"))
    return tj.resume(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


def membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return tj.members(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), big, ["c_custkey"])


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by kind of event: in both, in either, only in one; with repeats too."""
    a, b = (_events(spark, sf_dir, k).where("value > 80").select("user_id") for k in ("purchase", "signup"))
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "only_first": a.subtract(b), "first_less_second": a.exceptAll(b), "all": a.unionByName(b)}
    out = None
    for name, df in parts.items():
        one = df.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "user_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


def orbit_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as radar scenes: segments are orbits, finished and open orders the two references of a year."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey").select("o_orderkey", F.month("o_orderdate").alias("m"), F.col("c_nationkey").alias("orbit"), "o_orderstatus", "o_totalprice")
    scenes_, refs = o.where("o_orderstatus = 'P'"), o.where("o_orderstatus in ('F', 'O')")
    got = tj.orbit_reference(scenes_, refs, ["m"], "orbit", "o_orderstatus", "o_totalprice", ["F", "O"], 2)
    return r6(got.select("o_orderkey", "orbit_matched", "ref_F", "ref_O"))


def one_per_day_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order of a day, the least key of equals."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return sc.one_per_key(o, ["day"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("day", "o_orderkey")


def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))  # noqa: E741
    return sc.top_n(l, ["year", "l_returnflag"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 4).select("year", "l_returnflag", "rank", "l_orderkey", "l_linenumber")


def least_null_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cloudy scene of a part; no cloud and unknown cloud count as 100."""
    l = table(spark, sf_dir, "lineitem").withColumn("cloud", F.when(F.col("l_linenumber") > 1, F.col("l_discount") * 100))  # noqa: E741
    return sc.one_per_key(l, ["l_suppkey"], [F.round(sc.cloud_rank(F.col("cloud")), 6), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_suppkey", "l_orderkey", "l_linenumber")


def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return sc.spread_sample(o, ["year"], [F.col("o_orderdate"), F.col("o_orderkey")], 9).select("year", "o_orderkey")


def largest_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.clamp(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.abs(F.col("o_totalprice") - 150000).desc(), F.col("o_orderkey")], 25).select("o_orderkey")


def extreme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the least and the most, and the most common, in every segment."""
    c = table(spark, sf_dir, "customer")
    ends = c.groupBy("c_mktsegment").agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("poorest"), F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"))
    return ends.join(cl.mode(c, ["c_mktsegment"], "c_nationkey"), "c_mktsegment")


def day_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that purchases or clicks make, with signups where there are any, flattened again."""
    def per(kind: str) -> DataFrame:
        return _events(spark, sf_dir, kind).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))

    days = tj.assemble_days({"buys": per("purchase"), "clicks": per("click")}, {"signups": per("signup")}, "day")
    return days.select("day", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("buys", "clicks", "signups") for c in ("n", "last")))


def nested_day_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenespark.sources.tables import nested_days

    days = tj.assemble_days({"buys": _events(spark, sf_dir, "purchase").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))}, {"signups": _events(spark, sf_dir, "signup").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))}, "day")
    j = nested_days(days, "day")
    return j.select("day", F.get_json_object("json", "$.buys.n").cast("long").alias("buys"), F.get_json_object("json", "$.signups.n").cast("long").alias("signups"))


def pivot_month_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return r6(cl.crosstab(e, ["user_id"], "event_type", ["click", "purchase", "signup"], F.round(F.avg("value"), 6)))


def hour_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    got = cl.crosstab(e, ["hour"], "event_type", ["click", "purchase"], F.count(F.lit(1)))
    return got.select("hour", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "purchase")))


def sets_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = cl.instruments_by_day(e, "day", "event_type")
    return days.select("day", F.array_join("instruments", ",").alias("instruments"))


def instrument_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.reach(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "event_type", "day")


def box_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations as boxes: every pair of which the supplier covers a tenth of the nation."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_suppkey") % 37 - 20.0, F.col("s_suppkey") % 11 - 5.0, F.col("s_suppkey") % 37 - 15.0, F.col("s_suppkey") % 11 - 1.0).alias("bbox"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area_id"), F.array(F.col("n_nationkey") - 10.0, F.col("n_nationkey") % 5 - 3.0, F.col("n_nationkey") - 6.5, F.col("n_nationkey") % 5 + 0.5).alias("bbox"))
    got = sc.box_join(s, n, 2.0)
    whole = sc.coverage(F.col("bbox"), (-10.0, -5.0, 10.0, 5.0))
    return r6(got.select("s_suppkey", "area_id", "covered", whole.alias("of_area"), sc.utm_zone(F.get("bbox", 0)).alias("zone")))


QUERIES = {f.__name__: f for f in (lag_pairs, asof_nearest_tolerance, interval_match_collision, theta_pairs, value_tolerance_unique, resume_anti, membership_semi, set_operations, orbit_reference, one_per_day_ranked, topn_per_group, least_null_first, spread_sample, largest_movers, extreme_rows, day_assembly, nested_day_json, pivot_month_kind, hour_crosstab, sets_per_day, instrument_reach, box_coverage)}
_EV = "(SELECT * FROM events WHERE event_type = '{}')"
ORACLE_SQL = {
    "lag_pairs": f"""WITH {daily_sql("click")}, l(lag_days) AS (VALUES (1), (2), (3), (5), (10)),
p AS (SELECT lag_days, abs(b.value - a.value) AS d FROM series a, l, series b WHERE a.user_id = b.user_id AND b.day = a.day + lag_days)
SELECT lag_days, count(*) AS n, round(median(d), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(max(d), 6) AS worst FROM p GROUP BY lag_days""",
    "asof_nearest_tolerance": f"""WITH p AS {_EV.format("purchase")}, c AS {_EV.format("click")},
j AS (SELECT p.event_id, p.user_id, c.event_id AS click_id, c.value AS click_value, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(c.ts) - epoch_us(p.ts)), c.ts, CASE WHEN c.ts <= p.ts THEN -c.event_id ELSE c.event_id END) AS r
  FROM p JOIN c ON p.user_id = c.user_id AND abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 21600000000)
SELECT p.event_id, p.user_id, j.click_id, round(j.click_value, 6) AS click_value FROM p LEFT JOIN j ON p.event_id = j.event_id AND j.r = 1""",
    "interval_match_collision": f"""WITH s AS (SELECT event_id AS scene, CAST(ts AS DATE) AS day, user_id FROM {_EV.format("signup")}),
b AS (SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS role FROM {_EV.format("purchase")} WHERE user_id IN (SELECT user_id FROM s)),
m AS (SELECT event_id, role, scene, CAST(s.day - b.day AS INT) AS offset_days, row_number() OVER (PARTITION BY event_id ORDER BY abs(s.day - b.day), s.day - b.day DESC, scene) AS r FROM b JOIN s ON abs(s.day - b.day) <= 1),
k AS (SELECT * FROM m WHERE r = 1), c AS (SELECT scene, count(DISTINCT role) AS roles FROM k GROUP BY scene)
SELECT event_id, role, k.scene, offset_days, CASE WHEN roles > 1 THEN 'claimed by another role' WHEN row_number() OVER (PARTITION BY k.scene ORDER BY abs(offset_days), event_id) > 1 THEN 'used by the same role' END AS reject_reason FROM k JOIN c ON k.scene = c.scene""",
    "theta_pairs": f"SELECT a.event_id, b.event_id AS event_id_b FROM {_EV.format('click')} a JOIN {_EV.format('purchase')} b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND abs(a.value - b.value) <= 5",
    "value_tolerance_unique": f"""WITH p AS (SELECT a.event_id, b.event_id AS event_id_b, count(*) OVER (PARTITION BY a.event_id) AS n FROM {_EV.format("click")} a JOIN {_EV.format("purchase")} b ON CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND abs(a.value - b.value) < 0.5)
SELECT event_id, event_id_b FROM p WHERE n = 1""",
    "resume_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2000-02-01')",
    "membership_semi": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "set_operations": """WITH a AS (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80), b AS (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 80),
u AS (SELECT 'both' AS op, user_id FROM (SELECT user_id FROM a INTERSECT SELECT user_id FROM b) UNION ALL SELECT 'either', user_id FROM (SELECT user_id FROM a UNION SELECT user_id FROM b)
  UNION ALL SELECT 'only_first', user_id FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b) UNION ALL SELECT 'first_less_second', user_id FROM (SELECT user_id FROM a EXCEPT ALL SELECT user_id FROM b)
  UNION ALL SELECT 'all', user_id FROM (SELECT user_id FROM a UNION ALL SELECT user_id FROM b)) SELECT op, user_id, count(*) AS n FROM u GROUP BY op, user_id""",
    "orbit_reference": """WITH o AS (SELECT o_orderkey, month(o_orderdate) AS m, c_nationkey AS orbit, o_orderstatus AS st, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT * FROM o WHERE st IN ('F', 'O')),
x AS (SELECT m, orbit, median(v) FILTER (WHERE st = 'F') AS f, median(v) FILTER (WHERE st = 'O') AS o, least(count(*) FILTER (WHERE st = 'F'), count(*) FILTER (WHERE st = 'O')) AS n FROM r GROUP BY m, orbit),
y AS (SELECT m, median(v) FILTER (WHERE st = 'F') AS f, median(v) FILTER (WHERE st = 'O') AS o FROM r GROUP BY m)
SELECT o_orderkey, coalesce(x.n >= 2, FALSE) AS orbit_matched, round(CASE WHEN x.n >= 2 THEN x.f ELSE y.f END, 6) AS "ref_F", round(CASE WHEN x.n >= 2 THEN x.o ELSE y.o END, 6) AS "ref_O"
FROM o LEFT JOIN x ON o.m = x.m AND o.orbit = x.orbit LEFT JOIN y ON o.m = y.m WHERE o.st = 'P'""",
    "one_per_day_ranked": "SELECT day, o_orderkey FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
    "topn_per_group": """SELECT year, l_returnflag, CAST(r AS INT) AS rank, l_orderkey, l_linenumber FROM (SELECT CAST(year(l_shipdate) AS INT) AS year, l_returnflag, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY year(l_shipdate), l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 4""",
    "least_null_first": """WITH c AS (SELECT *, CASE WHEN l_linenumber > 1 THEN l_discount * 100 END AS cloud FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(CASE WHEN cloud IS NULL OR cloud = 0 THEN 100 ELSE cloud END, 6), l_orderkey, l_linenumber) AS r FROM c) WHERE r = 1""",
    "spread_sample": """WITH a AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders)
SELECT year, o_orderkey FROM a WHERE n <= 9 OR i IN (SELECT CAST(round_even(k * (n - 1) / 8.0, 0) AS BIGINT) FROM range(0, 9) t(k))""",
    "largest_movers": "SELECT o_orderkey FROM orders ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey LIMIT 25",
    "extreme_rows": """WITH p AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS a, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS b FROM customer),
c AS (SELECT c_mktsegment, c_nationkey, count(*) AS k FROM customer GROUP BY c_mktsegment, c_nationkey),
n AS (SELECT c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY k DESC, c_nationkey) AS r FROM c)
SELECT p.c_mktsegment, max(c_custkey) FILTER (WHERE a = 1) AS poorest, max(c_custkey) FILTER (WHERE b = 1) AS richest, any_value(n.c_nationkey) AS c_nationkey FROM p JOIN n ON p.c_mktsegment = n.c_mktsegment AND n.r = 1 GROUP BY p.c_mktsegment""",
    "day_assembly": """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS k, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT day FROM e WHERE k IN ('purchase', 'click'))
SELECT d.day, b.n AS buys_n, b.last AS buys_last, c.n AS clicks_n, c.last AS clicks_last, s.n AS signups_n, s.last AS signups_last FROM d LEFT JOIN e b ON d.day = b.day AND b.k = 'purchase' LEFT JOIN e c ON d.day = c.day AND c.k = 'click' LEFT JOIN e s ON d.day = s.day AND s.k = 'signup'""",
    "nested_day_json": """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2)
SELECT b.day, b.n AS buys, s.n AS signups FROM e b LEFT JOIN e s ON b.day = s.day AND s.k = 'signup' WHERE b.k = 'purchase'""",
    "pivot_month_kind": "SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS purchase, round(avg(value) FILTER (WHERE event_type = 'signup'), 6) AS signup FROM events GROUP BY user_id",
    "hour_crosstab": "SELECT CAST(hour(ts) AS INT) AS hour, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1",
    "sets_per_day": "SELECT CAST(ts AS DATE) AS day, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS instruments FROM events GROUP BY 1",
    "instrument_reach": "SELECT event_type, count(*) AS n, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY event_type",
    "box_coverage": """WITH s AS (SELECT s_suppkey, s_suppkey % 37 - 20.0::DOUBLE AS w, s_suppkey % 11 - 5.0::DOUBLE AS s, s_suppkey % 37 - 15.0::DOUBLE AS e, s_suppkey % 11 - 1.0::DOUBLE AS n FROM supplier),
a AS (SELECT n_nationkey AS area_id, n_nationkey - 10.0::DOUBLE AS w, n_nationkey % 5 - 3.0::DOUBLE AS s, n_nationkey - 6.5::DOUBLE AS e, n_nationkey % 5 + 0.5::DOUBLE AS n FROM nation),
j AS (SELECT s_suppkey, area_id, greatest(least(s.e, a.e) - greatest(s.w, a.w), 0) * greatest(least(s.n, a.n) - greatest(s.s, a.s), 0) / ((a.e - a.w) * (a.n - a.s)) AS covered,
  greatest(least(s.e, 10) - greatest(s.w, -10), 0) * greatest(least(s.n, 5) - greatest(s.s, -5), 0) / 200.0 AS of_area, CAST(floor((s.w + 180) / 6) AS INT) % 60 + 1 AS zone FROM s, a)
SELECT s_suppkey, area_id, round(covered, 6) AS covered, round(of_area, 6) AS of_area, zone FROM j WHERE covered >= 0.1""",
}
