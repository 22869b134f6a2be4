"""Daily series: calendar densification, gap filling, smoothing, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(df: DataFrame, key: Sequence[str], day: str, values: Sequence[str] | None = None) -> DataFrame:
    """One row for every calendar day between a key's first and last day; NULL values on added days. df has
    one row a key and day at most."""
    values = list(values) if values is not None else [c for c in df.columns if c not in (*key, day)]
    span = df.groupBy(*key).agg(F.min(day).alias("lo__"), F.max(day).alias("hi__")).where("lo__ is not null")
    days = span.select(*key, F.explode(F.sequence("lo__", "hi__")).alias(day))
    return days.join(df.select(*key, day, *values), [*key, day], "left")


def interpolate(df: DataFrame, key: Sequence[str], order: str, value: str, out: str, limit: int | None = 14, mode: str = "each_side") -> DataFrame:
    """Linear in row distance, over a dense series.

    each_side (default): up to `limit` rows inward from either neighbour, and flat at the ends, so a gap of
    up to twice the limit is filled. whole_gap: only inner gaps of at most `limit` rows. inside_only: every
    inner gap, nothing at the ends; limit is not used.
    """
    w = Window.partitionBy(*key).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(F.col("i__").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a running value, unlike a frame to the end
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    known = F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("i__").alias("i")))
    near = df.withColumn("i__", F.row_number().over(w)).withColumn("k__", known)
    near = near.withColumn("p__", F.last("k__", ignorenulls=True).over(back)).withColumn("q__", F.last("k__", ignorenulls=True).over(ahead))
    dp, dq = F.col("i__") - F.col("p__.i"), F.col("q__.i") - F.col("i__")
    p, q = F.col("p__.v"), F.col("q__.v")
    between = F.when(dp == 0, p).otherwise(p + (q - p) * dp / (dp + dq))
    both = F.col("p__").isNotNull() & F.col("q__").isNotNull()
    if mode == "each_side":
        far = F.lit(False) if limit is None else F.least(dp, dq) > limit
        filled = F.when(far, None).when(both, between).otherwise(F.coalesce(p, q))
    elif mode == "whole_gap":
        filled = F.when(both & ((dp == 0) | (dp + dq - 1 <= (limit if limit is not None else 2**31 - 1))), between)
    elif mode == "inside_only":
        filled = F.when(both, between)
    else:
        raise ValueError(f"mode {mode!r}")
    return near.withColumn(out, filled).drop("i__", "k__", "p__", "q__")


def climatology(df: DataFrame, by: Sequence[str], value: str, out: str = "climatology") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(out))


def climatology_fill(df: DataFrame, by: Sequence[str], raw: str, filled: str, out: str, inside: Column) -> DataFrame:
    """`filled`, else the mean of `raw` over the rows with the same `by` (such as the day of the year); rows
    outside the season keep `raw`."""
    means = climatology(df, by, raw, "clim__")
    return df.join(means, list(by), "left").withColumn(out, F.when(inside, F.coalesce(filled, "clim__")).otherwise(F.col(raw))).drop("clim__")


def rolling(df: DataFrame, key: Sequence[str], order: str, value: str, out: str, n: int, centred: bool = True, min_periods: int = 1, passes: int = 1) -> DataFrame:
    """Mean over n rows, centred or trailing, of at least min_periods values; repeated `passes` times."""
    half = n // 2
    frame = (-half, n - 1 - half) if centred else (1 - n, 0)
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(*frame)
    source = value
    for _ in range(passes):
        df = df.withColumn(out, F.when(F.count(source).over(w) >= min_periods, F.avg(source).over(w)))
        source = out
    return df


def bin_of(doy: Column, lo: int, width: int, n: int) -> Column:
    """Bin of width days from lo on, from 0; days before and after fall in the first and last."""
    return F.least(F.greatest(F.floor((doy - lo) / width), F.lit(0)), F.lit(n - 1)).cast("int")


def cut(c: Column, edges: Sequence[float]) -> Column:
    """Left-closed bin between edges, from 0; NULL outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((c >= a) & (c < b), i).otherwise(out)
    return out


def season_bins(df: DataFrame, season: str, doy: str, value: str, lo: int = 45, width: int = 15, n: int = 9) -> DataFrame:
    """season, bin, value: mean of every bin of every season, NULL where none was seen."""
    seen = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    means = seen.groupBy(season, bin_of(F.col(doy), lo, width, n).alias("bin")).agg(F.avg(value).alias("value"))
    grid = seen.select(season).distinct().select(season, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return grid.join(means, [season, "bin"], "left")


def binned_means(bins: DataFrame, season: str, n: int = 9, least: int = 5, last: int = 2) -> DataFrame:
    """season, value, observed: mean over a season's bins, inner gaps interpolated. Seasons without any of
    the last bins, or with fewer than `least` bins after filling, are left out."""
    filled = interpolate(bins, [season], "bin", "value", "filled__", mode="inside_only")
    got = filled.groupBy(season).agg(
        F.avg("filled__").alias("value"), F.count("value").alias("observed"), F.count("filled__").alias("n__"), F.count_if((F.col("bin") >= n - last) & F.col("value").isNotNull()).alias("late__")
    )
    return got.where((F.col("n__") >= least) & (F.col("late__") > 0)).select(season, "value", "observed")


def common_bins(left: DataFrame, right: DataFrame, season: str, least: int = 5) -> DataFrame:
    """season, shared, left_value, right_value over the bins that both instruments saw."""
    a = left.select(season, "bin", F.col("value").alias("a"))
    b = right.select(season, "bin", F.col("value").alias("b"))
    got = a.join(b, [season, "bin"]).where("a is not null and b is not null").groupBy(season).agg(F.count("*").alias("shared"), F.avg("a").alias("left_value"), F.avg("b").alias("right_value"))
    return got.where(F.col("shared") >= least)


def day_of(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1)


def piecewise(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear look-up between knots with rising xs, flat beyond them."""
    out = F.lit(float(ys[-1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(zip(xs, ys), zip(xs[1:], ys[1:])))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= xs[0], float(ys[0])).otherwise(out))
