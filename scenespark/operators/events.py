"""Events in a season: break-up dates, persistence, drops, accumulated change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark import presets as P


def breakup(df: DataFrame, key: Sequence[str], doy: str, value: str, threshold: str | float = P.BREAKUP_THRESHOLD, persistence: int = 7, min_obs: int = 2) -> DataFrame:
    """key and breakup: the first observed day below the threshold, after an observation at or above it, from
    which all observations of `persistence` days are below, at least min_obs of them; NULL if there is none.
    A day without observation is no evidence. threshold: a number or a column."""
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    seen = df.where(F.col(value).isNotNull()).withColumn("t__", t)
    w = Window.partitionBy(*key).orderBy(doy)
    ahead = w.rangeBetween(0, persistence - 1)
    marked = (
        seen.withColumn("frozen__", F.max((F.col(value) >= F.col("t__")).cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("most__", F.max(value).over(ahead))
        .withColumn("n__", F.count("*").over(ahead))
    )
    hit = (F.col(value) < F.col("t__")) & (F.col("frozen__") == 1) & (F.col("most__") < F.col("t__")) & (F.col("n__") >= min_obs)
    return marked.groupBy(*key).agg(F.min(F.when(hit, F.col(doy))).alias("breakup"))


def adaptive_threshold(df: DataFrame, key: Sequence[str], doy: str, value: str, window: tuple[int, int] = P.FROZEN, floor: float = P.BREAKUP_THRESHOLD) -> DataFrame:
    """key and threshold: mean less two standard deviations over the frozen window, at least `floor`; `floor`
    with fewer than three observations."""
    v = F.when(F.col(doy).between(*window), F.col(value))
    low = F.avg(v) - 2 * F.stddev_samp(v)
    return df.groupBy(*key).agg(F.when(F.count(v) < 3, floor).otherwise(F.greatest(low, F.lit(floor))).alias("threshold"))


def date_shift(dates: DataFrame, season: str, date: str, by: Sequence[str] = (), split: int = P.LATE_FROM) -> DataFrame:
    """early, late, shift and censored (seasons without a date) for every `by`."""
    early, late = F.avg(F.when(F.col(season) < split, F.col(date))), F.avg(F.when(F.col(season) >= split, F.col(date)))
    got = dates.groupBy(*by).agg(early.alias("early"), late.alias("late"), F.count_if(F.col(date).isNull()).alias("censored"))
    return got.select(*by, "early", "late", (F.col("late") - F.col("early")).alias("shift"), "censored")


def persistence_rows(df: DataFrame, key: Sequence[str], order: str, value: str, below: float, n: int, out: str = "start") -> DataFrame:
    """key and the first row of which it and the n - 1 after it are below. The last place from which n rows
    remain is not tried, and later ones aren't either."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = df.withColumn("most__", F.max(value).over(w.rowsBetween(0, n - 1))).withColumn("i__", F.row_number().over(w)).withColumn("n__", F.count("*").over(Window.partitionBy(*key)))
    return marked.groupBy(*key).agg(F.min(F.when((F.col("most__") < below) & (F.col("i__") <= F.col("n__") - n), F.col(order))).alias(out))


def lead_drop(df: DataFrame, key: Sequence[str], order: str, value: str, k: int = 7, out: str = "drop") -> DataFrame:
    """value less the value k rows on."""
    return df.withColumn(out, F.col(value) - F.lead(value, k).over(Window.partitionBy(*key).orderBy(order)))


def accumulated(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """running sum and its share of the key's total."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(Window.partitionBy(*key))
    return df.withColumn("running", F.sum(value).over(w)).withColumn("share", F.try_divide(F.col("running"), F.nullif(total, F.lit(0))))


def season_metrics(df: DataFrame, key: Sequence[str], doy: str, value: str, high: float = 0.5, low: float = P.BREAKUP_THRESHOLD, n: int = 7) -> DataFrame:
    """mean, ice_days (value at least high), first_high, low_start (persistence_rows below low), days,
    steepest_drop over n rows, and length from first_high to low_start."""
    drops = lead_drop(df, key, doy, value, n, "drop__")
    got = drops.groupBy(*key).agg(
        F.avg(value).alias("mean"), F.count_if(F.col(value) >= high).alias("ice_days"), F.min(F.when(F.col(value) >= high, F.col(doy))).alias("first_high"), F.count(value).alias("days"), F.max("drop__").alias("steepest_drop")
    )
    both = got.join(persistence_rows(df, key, doy, value, low, n, "low_start"), list(key))
    return both.withColumn("length", F.col("low_start") - F.col("first_high"))


def anomaly(value: Column, baseline: Column) -> Column:
    return value - baseline
