"""Joins in time: lags, nearest, intervals, collisions, references. All are equi-joins with a bounded
look-around, so none becomes a product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_pairs(df: DataFrame, key: Sequence[str], day: str, value: str, lags: Sequence[int]) -> DataFrame:
    """key, lag_days, day, difference: absolute differences of values exactly so many days apart."""
    a = df.select(*key, F.col(day).alias("from__"), F.col(value).alias("a__"), F.explode(F.array(*map(F.lit, lags))).alias("lag_days"))
    a = a.withColumn(day, F.date_add("from__", F.col("lag_days")))
    b = df.select(*key, day, F.col(value).alias("b__"))
    return a.join(b, [*key, day]).select(*key, "lag_days", F.col("from__").alias("day"), F.abs(F.col("b__") - F.col("a__")).alias("difference"))


def asof_nearest(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], tolerance_s: float, left_id: str, right_id: str) -> DataFrame:
    """left with the `values` and time (`<on>_right`) of the nearest right row of the same `by` within a
    tolerance in seconds; NULL without one. On equal distance the earlier time is taken; of rows with one
    time the last (by right_id) at or before the left time, the first after it.

    Time is cut into buckets as wide as the tolerance and right rows are sent to the three buckets that they
    can matter to. Sides are stacked and sorted by key, bucket and time; the last row before and the first
    after are carried along. So a frequent key is spread over its buckets, and no pairs are made. Left rows
    without a time or key match nothing.
    """
    at, width = F.col(on), max(float(tolerance_s), 1.0)
    secs = lambda c: c.cast("timestamp").cast("double")
    bucket = F.floor(secs(at) / width)
    kinds = {c: dict(right.dtypes)[c] for c in values}
    pay = F.struct(at.alias("t"), F.col(right_id).alias("id"), *values)
    mine = left.select(*by, bucket.alias("bucket__"), at.alias("t__"), F.struct(*left.columns).alias("l__"))
    theirs = right.where(at.isNotNull()).select(*by, F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket__"), at.alias("t__"), pay.alias("r__"))
    both = mine.withColumn("r__", F.lit(None).cast(theirs.schema["r__"].dataType)).unionByName(theirs.withColumn("l__", F.lit(None).cast(mine.schema["l__"].dataType)))
    w = Window.partitionBy(*by, "bucket__")
    back = w.orderBy(F.col("t__"), F.col("l__").isNotNull(), F.col("r__.id"), F.col(f"l__.{left_id}")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.col("t__").desc(), F.col("l__").isNotNull(), F.col("r__.id").desc(), F.col(f"l__.{left_id}")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("p__", F.last("r__", ignorenulls=True).over(back)).withColumn("q__", F.last("r__", ignorenulls=True).over(ahead)).where("l__ is not null")
    dp, dq = secs(F.col("t__")) - secs(F.col("p__.t")), secs(F.col("q__.t")) - secs(F.col("t__"))
    p = F.when(F.col("t__").isNotNull() & (dp <= tolerance_s), F.col("p__"))
    q = F.when(F.col("t__").isNotNull() & (dq <= tolerance_s), F.col("q__"))
    best = F.when(p.isNotNull() & (q.isNull() | (dp <= dq)), p).otherwise(q)
    return near.withColumn("b__", best).select("l__.*", F.col("b__.t").alias(f"{on}_right"), *(F.col(f"b__.{c}").cast(kinds[c]).alias(c) for c in values))


def interval_match(candidates: DataFrame, scenes: DataFrame, day: str, candidate_id: Sequence[str], order: Sequence[str], within: int = 1) -> DataFrame:
    """Every candidate with the nearest scene within so many days, by |offset|, later day first, then
    `order` (columns of the scenes); offset_days is scene day less candidate day. Candidates without one are
    left out (anti-join them for the rest)."""
    offsets = F.explode(F.array(*map(F.lit, range(-within, within + 1))))
    asked = candidates.withColumn("offset_days", offsets).withColumn("day__", F.date_add(day, F.col("offset_days")))
    others = [c for c in scenes.columns if c != day]
    # the order doesn't depend on the candidate, so of each day the first scene is enough
    firsts = scenes.groupBy(F.col(day).alias("day__")).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("s__")).select("day__", "s__.*")
    found = asked.join(firsts, "day__")
    w = Window.partitionBy(*candidate_id).orderBy(F.abs("offset_days"), F.col("offset_days").desc(), *order)
    return found.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__").withColumnRenamed("day__", "scene_day")


def exclude_collisions(matches: DataFrame, scene: str, role: str, order: Sequence[Column]) -> DataFrame:
    """matches with reject_reason. A scene that several roles claim is withdrawn from all; of several claims
    of one role the one nearest in time (then by `order`) is kept."""
    w = Window.partitionBy(scene)
    roles = F.size(F.collect_set(role).over(w))
    nth = F.row_number().over(w.orderBy(F.abs("offset_days"), *order))
    marked = matches.withColumn("roles__", roles).withColumn("nth__", nth)
    reason = F.when(F.col("roles__") > 1, "claimed by another role").when(F.col("nth__") > 1, "used by the same role")
    return marked.withColumn("reject_reason", reason).drop("roles__", "nth__")


def same_day_pairs(a: DataFrame, b: DataFrame, day: str, measure: str, within: float) -> DataFrame:
    """Rows of a and b of one day whose measures differ by at most `within`; b's columns end in _b."""
    other = b.select(day, *(F.col(c).alias(f"{c}_b") for c in b.columns if c != day))
    return _close(a, other, [day], measure, within).where(F.abs(F.col(measure) - F.col(f"{measure}_b")) <= within)


def _close(a: DataFrame, b: DataFrame, by: Sequence[str], value: str, within: float) -> DataFrame:
    """Rows of a and b of one `by` whose values (value and value_b) fall into the same or neighbouring buckets, twice
    as wide as `within`: all that are within it, and few others, however many rows a `by` has."""
    if within <= 0:
        return a.join(b, list(by))
    place = lambda c: F.rint(F.col(c).cast("double") / (2 * within))
    here = a.withColumn("at__", place(value)).withColumn("at__", F.explode(F.array_distinct(F.array(*(F.col("at__") + k for k in (-1, 0, 1))))))
    return here.join(b.withColumn("at__", place(f"{value}_b")), [*by, "at__"]).drop("at__")


def unique_within(a: DataFrame, b: DataFrame, by: Sequence[str], value: str, tolerance: float, a_id: Sequence[str]) -> DataFrame:
    """a with the one row of b of the same `by` whose value is within the tolerance; rows of a with none or
    several are left out. b's columns end in _b."""
    other = b.select(*by, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in by))
    near = _close(a, other, by, value, tolerance).where(F.abs(F.col(value) - F.col(f"{value}_b")) < tolerance)
    return near.withColumn("n__", F.count("*").over(Window.partitionBy(*a_id))).where("n__ = 1").drop("n__")


def references(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every key (reverse the order for the last n)."""
    return df.withColumn("nth__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth__") <= n).drop("nth__")


def orbit_reference(scenes: DataFrame, refs: DataFrame, key: Sequence[str], orbit: str, role: str, value: str, roles: Sequence[str], least: int = 1) -> DataFrame:
    """scenes with ref_<role>: the median reference value on the scene's own orbit where every role has at
    least `least` of them there, else over all orbits; orbit_matched tells which."""

    def medians(by: Sequence[str], suffix: str) -> DataFrame:
        return refs.groupBy(*by).agg(
            *(F.median(F.when(F.col(role) == r, F.col(value))).alias(f"{r}{suffix}") for r in roles), F.least(*(F.count_if(F.col(role) == r) for r in roles)).alias(f"n{suffix}")
        )

    both = scenes.join(medians([*key, orbit], "__o"), [*key, orbit], "left").join(medians(key, "__a"), list(key), "left")
    matched = F.coalesce(F.col("n__o") >= least, F.lit(False))
    out = both.withColumn("orbit_matched", matched)
    for r in roles:
        out = out.withColumn(f"ref_{r}", F.when(F.col("orbit_matched"), F.col(f"{r}__o")).otherwise(F.col(f"{r}__a")))
    return out.drop(*(f"{r}{s}" for r in roles for s in ("__o", "__a")), "n__o", "n__a")


def resume(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")


def members(df: DataFrame, of: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(of.select(*key).distinct(), list(key), "left_semi")


def assemble_days(drivers: dict[str, DataFrame], attached: dict[str, DataFrame], day: str) -> DataFrame:
    """One row a day with a struct column for every instrument. `drivers` create days; `attached` only join
    days that exist. Each frame has one row a day."""

    def packed(name: str, df: DataFrame) -> DataFrame:
        return df.select(day, F.struct(*(c for c in df.columns if c != day)).alias(name))

    out = None
    for name, df in drivers.items():
        out = packed(name, df) if out is None else out.join(packed(name, df), day, "full_outer")
    for name, df in attached.items():
        out = out.join(packed(name, df), day, "left")
    return out
