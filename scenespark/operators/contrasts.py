"""Season tables, period contrasts, specification curves, scenarios."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark import presets as P


def denominators(df: DataFrame, solid: str = "solid", light: str = "light", water: str = "water", cloud: str = "cloud", others: Sequence[str] = ()) -> DataFrame:
    """ice shares by the grid, the clear and the classified cells, and the classified share of the grid; NULL
    over nothing."""
    ice = F.col(solid) + F.col(light)
    classified = ice + F.col(water)
    grid = sum((F.col(c) for c in others), classified + F.col(cloud))
    clear = grid - F.col(cloud) - sum((F.col(c) for c in others), F.lit(0))
    per = lambda n, d: F.try_divide(n, F.nullif(d, F.lit(0)))
    return df.withColumns({"ice_grid": per(ice, grid), "ice_clear": per(ice, clear), "ice_classified": per(ice, classified), "share": per(classified, grid)})


def daily_means(df: DataFrame, season: str, doy: str, value: str, window: tuple[int, int], keep: Column | None = None) -> DataFrame:
    inside = F.col(doy).between(*window)
    return df.where(inside if keep is None else inside & keep).groupBy(season, doy).agg(F.avg(value).alias(value))


def season_table(df: DataFrame, season: str, doy: str, value: str, window: tuple[int, int], aggregate: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """season, value, n_days over the days with a value."""
    f = F.avg if aggregate == "mean" else F.median
    return df.where(F.col(doy).between(*window) & F.col(value).isNotNull()).groupBy(*by, season).agg(f(value).alias("value"), F.count(value).alias("n_days"))


def period_decline(table: DataFrame, season: str, split: int | str, weighting: str = "equal", by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """early_mean, late_mean, decline_pct, n_early, n_late of season values before and from `split` (a year
    or a column); by_days weights seasons by n_days. NULL where a side is empty."""
    s = F.col(split) if isinstance(split, str) else F.lit(split)
    early, late = F.col(season) < s, F.col(season) >= s

    def mean(side: Column) -> Column:
        if weighting == "equal":
            return F.avg(F.when(side, F.col("value")))
        return F.try_divide(F.sum(F.when(side, F.col("value") * F.col("n_days"))), F.nullif(F.sum(F.when(side, F.col("n_days"))), F.lit(0)))

    got = table.groupBy(*by).agg(mean(early).alias("early_mean"), mean(late).alias("late_mean"), F.count_if(early).alias("n_early"), F.count_if(late).alias("n_late"))
    got = got.withColumn("decline_pct", 100 * (1 - F.try_divide(F.col("late_mean"), F.nullif("early_mean", F.lit(0.0)))))
    return got if digits is None else got.withColumns({c: F.round(c, digits) for c in ("early_mean", "late_mean", "decline_pct")})


def weighted_seasons(df: DataFrame, season: str, value: str, weight: str) -> DataFrame:
    """season, value (weighted mean), n_days."""
    return df.groupBy(season).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.nullif(F.sum(weight), F.lit(0.0))).alias("value"), F.count(value).alias("n_days"))


def reweight(df: DataFrame, weights: DataFrame, bins: Sequence[str], weight: str) -> DataFrame:
    """df with the weight of its bins, 0 where there is none."""
    return df.join(weights.select(*bins, weight), list(bins), "left").withColumn(weight, F.coalesce(weight, F.lit(0.0)))


def coverage(df: DataFrame, season: str, value: str) -> DataFrame:
    """Share of days with a value for every season, over all, and the season with the least."""
    per = df.groupBy(season).agg((F.count(value) / F.count("*")).alias("coverage"), F.count(value).alias("seen"), F.count("*").alias("days"))
    return per.agg((F.sum("seen") / F.sum("days")).alias("coverage"), F.min("coverage").alias("minimum"), F.min_by(season, F.struct("coverage", season)).alias("minimum_season"))


def split_sums(df: DataFrame, by: Sequence[str], order: str, value: str, n_early: str | int, most: int = 200_000) -> DataFrame:
    """by, gap (observed), p, splits, widest: exact two-sided permutation over all ways to choose n_early of a
    group's rows, on the gap of means, with a slack of 1e-12.

    The values of a group are one array (a season a value, so a few dozen at most); choices are built inside
    the row by extending arrays of sums, and groups stay apart. Of groups with more than `most` choices the sums of
    either half are built, and every choice is counted as a sum of one half and one of the other that together
    have n_early values, so the row holds about the square root of the choices. An empty side has a NULL p.
    """
    k = F.col(n_early) if isinstance(n_early, str) else F.lit(n_early)
    got = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"), F.max(k).cast("int").alias("k"))
    got = got.select(*by, F.transform("s", lambda x: x["v"]).alias("v"), "k").withColumn("n", F.size("v"))
    ways = F.round(F.exp(F.aggregate(F.sequence(F.lit(1), F.greatest("k", F.lit(1))), F.lit(0.0), lambda a, i: a + F.log((F.col("n") - F.col("k") + i) / i))))
    ok = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    start = F.array(F.struct(F.lit(0).alias("c"), F.lit(0.0).alias("s")))

    def extend(chosen: Column, v: Column) -> Column:
        taken = F.transform(F.filter(chosen, lambda x: x["c"] < F.col("k")), lambda x: F.struct((x["c"] + 1).alias("c"), (x["s"] + v).alias("s")))
        return F.concat(chosen, taken)

    sums = F.filter(F.aggregate(F.when(ways <= most, F.col("v")).otherwise(F.array().cast("array<double>")), start, extend), lambda x: x["c"] == F.col("k"))
    half = (F.col("n") / 2).cast("int")
    cut = lambda a, b: F.when(F.col("ok") & ~F.col("small"), F.slice("v", a, b)).otherwise(F.array().cast("array<double>"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    first = F.aggregate(F.slice("v", F.lit(1), F.col("k")), F.lit(0.0), lambda a, x: a + x)
    gap = lambda s: s / F.col("k") - (F.col("total") - s) / (F.col("n") - F.col("k"))
    got = got.withColumn("ok", ok).withColumn("small", ways <= most).withColumn("total", total).withColumn("gap", F.when(F.col("ok"), gap(first)))
    gaps = F.when(F.col("ok") & F.col("small"), F.transform(sums, lambda x: F.abs(gap(x["s"]))))
    got = got.withColumn("gaps", gaps)
    got = got.withColumn("one", F.aggregate(cut(F.lit(1), half), start, extend)).withColumn("two", F.aggregate(cut(half + 1, F.col("n")), start, extend))
    far = lambda s: F.abs(gap(s)) >= F.abs(F.col("gap")) - 1e-12
    meeting = lambda a: F.size(F.filter("two", lambda b: (a["c"] + b["c"] == F.col("k")) & far(a["s"] + b["s"]))).cast("long")
    hits = F.when(F.col("small"), F.size(F.filter("gaps", lambda g: g >= F.abs(F.col("gap")) - 1e-12)).cast("long")).otherwise(F.aggregate("one", F.lit(0).cast("long"), lambda n, a: n + meeting(a)))
    splits = F.aggregate(F.sequence(F.lit(1), F.greatest("k", F.lit(1))), F.lit(1).cast("long"), lambda a, i: F.call_function("div", a * (F.col("n") - F.col("k") + i), i).cast("long"))
    low = F.array_sort("v")
    ends = [F.aggregate(F.slice(low, *at), F.lit(0.0), lambda a, x: a + x) for at in ((F.lit(1), F.col("k")), (F.col("n") - F.col("k") + 1, F.col("k")))]
    widest = F.when(F.col("small"), F.array_max("gaps")).otherwise(F.greatest(*(F.abs(gap(e)) for e in ends)))
    return got.select(*by, "gap", *(F.when(F.col("ok"), x).alias(c) for c, x in (("p", hits / splits), ("splits", splits), ("widest", widest))))


def spec_curve(df: DataFrame, season: str, doy: str, series: Sequence[str], windows: Sequence[tuple[int, int]], splits: Sequence[int], aggregates: Sequence[str] = ("mean", "median"), weightings: Sequence[str] = ("equal", "by_days")) -> DataFrame:
    """One row for every combination of choices: n_early, n_late, decline_pct, permutation_p.

    Every day is sent once to each (series, window) that holds it and aggregated both ways in one pass; all
    further choices act on the few season values.
    """
    cases = F.array(*(F.struct(F.lit(s).alias("series"), F.lit(f"{a}-{b}").alias("window"), F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.col(s).cast("double").alias("v")) for s, (a, b) in itertools.product(series, windows)))
    rows = df.select(season, doy, F.explode(cases).alias("c")).where(F.col("c.v").isNotNull() & F.col(doy).between(F.col("c.lo"), F.col("c.hi")))
    table = rows.groupBy("c.series", "c.window", season).agg(F.avg("c.v").alias("mean"), F.median("c.v").alias("median"), F.count("*").alias("n_days"))
    how = F.explode(F.array(*(F.struct(F.lit(a).alias("aggregate"), F.col(a).alias("value")) for a in aggregates)))
    when = F.explode(F.array(*map(F.lit, splits))).alias("split")
    long = table.select("series", "window", season, "n_days", how.alias("h")).select("series", "window", season, "n_days", "h.*").select("*", when)
    by = ["series", "window", "split", "aggregate"]
    parts = [period_decline(long, season, "split", w, by).withColumn("weighting", F.lit(w)) for w in weightings]
    declines = parts[0]
    for p in parts[1:]:
        declines = declines.unionByName(p)
    early = long.withColumn("k", F.count_if(F.col(season) < F.col("split")).over(Window.partitionBy(*by)))
    tests = split_sums(early, by, season, "value", "k").select(*by, F.col("p").alias("permutation_p"))
    return declines.join(tests, by).select(*by, "weighting", "n_early", "n_late", "decline_pct", "permutation_p")


def leave_one_out(table: DataFrame, season: str, split: int) -> DataFrame:
    """dropped, period, decline_pct, shift (against all seasons), permutation_p, seasons_left."""
    dropped = table.select(F.col(season).alias("dropped"))
    kept = dropped.crossJoin(table).where(F.col(season) != F.col("dropped"))  # seasons x seasons
    full = period_decline(table, season, split).select(F.col("decline_pct").alias("full"))
    got = period_decline(kept, season, split, by=["dropped"])
    early = kept.withColumn("k", F.count_if(F.col(season) < split).over(Window.partitionBy("dropped")))
    tests = split_sums(early, ["dropped"], season, "value", "k").select("dropped", F.col("p").alias("permutation_p"))
    return got.join(tests, "dropped").crossJoin(full).select(
        "dropped", F.when(F.col("dropped") < split, "early").otherwise("late").alias("period"), "decline_pct", (F.col("decline_pct") - F.col("full")).alias("shift"), "permutation_p", (F.col("n_early") + F.col("n_late")).alias("seasons_left")
    )


def rank_in_curve(curve: DataFrame, value: str, published: Column) -> DataFrame:
    """share strictly below, rank and upper median around the published row."""
    one = curve.where(published).select(F.col(value).alias("p"))
    got = curve.crossJoin(one).agg(F.avg((F.col(value) < F.col("p")).cast("int")).alias("below"), (F.count_if(F.col(value) < F.col("p")) + 1).alias("rank"), F.array_sort(F.collect_list(value)).alias("all"))
    return got.select("below", "rank", F.get("all", F.floor(F.size("all") / 2).cast("int")).alias("upper_median"))


def set_share(df: DataFrame, flag: Column, target: float, solid: str = "solid", light: str = "light", water: str = "water") -> DataFrame:
    """Counterfactual: flagged rows' classified cells hold `target` of ice."""
    classified = F.col(solid) + F.col(light) + F.col(water)
    yes = F.coalesce(flag, F.lit(False))
    return df.withColumns({solid: F.when(yes, classified * target).otherwise(F.col(solid)), light: F.when(yes, 0.0).otherwise(F.col(light)), water: F.when(yes, classified * (1 - target)).otherwise(F.col(water))})


def scenarios(df: DataFrame, cases: dict[str, tuple[Column, float]], **columns: str) -> DataFrame:
    """The rows under every scenario (and `observed`), stacked with a column scenario."""
    out = df.withColumn("scenario", F.lit("observed"))
    for name, (flag, target) in cases.items():
        out = out.unionByName(set_share(df, flag, target, **columns).withColumn("scenario", F.lit(name)))
    return out


def relative_position(value: Column, water: Column, ice: Column, ice_cut: float = P.ICE_VERDICT, water_cut: float = P.WATER_VERDICT) -> tuple[Column, Column]:
    """Where a value lies between water (0) and ice (1), unclamped, and the verdict."""
    pos = F.try_divide(value - water, F.nullif(ice - water, F.lit(0.0)))
    return pos, F.when(pos >= ice_cut, "ice").when(pos <= water_cut, "water").when(pos.isNotNull(), "between")


def implied_by_gate(table: DataFrame, season: str, gate: str, split: int) -> DataFrame:
    """decline_pct of every gate position from (season, gate, value, n_days)."""
    return period_decline(table, season, split, by=[gate])
