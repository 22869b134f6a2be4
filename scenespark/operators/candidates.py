"""Candidate scenes by role, thinned samples, labels of control groups, and relative brightness."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.operators.calendar import piecewise
from scenespark.operators.ordered import percentiles


def by_role(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for every role whose rule holds; one scene may have several."""
    roles = F.array_compact(F.array(*(F.when(rule, F.lit(role)) for role, rule in rules.items())))
    return df.withColumn("role", F.explode(roles))


def cap_per_season(df: DataFrame, by: Sequence[str], season: str, order: Sequence[Column], cap: int) -> DataFrame:
    """Groups above `cap` rows are thinned evenly: each season keeps max(1, cap // seasons) rows at evenly
    spaced places (halves to even); smaller groups stay whole."""
    w, ws = Window.partitionBy(*by), Window.partitionBy(*by, season)
    seasons = F.size(F.collect_set(season).over(w))
    placed = df.withColumns({"n__": F.count("*").over(w), "k__": F.greatest(F.floor(F.lit(cap) / seasons).cast("int"), F.lit(1)), "m__": F.count("*").over(ws), "at__": F.row_number().over(ws.orderBy(*order)) - 1})
    step = (F.col("m__") - 1) / F.greatest(F.col("k__") - 1, F.lit(1)).cast("double")
    want = F.transform(F.sequence(F.lit(0), F.col("k__") - 1), lambda i: F.bround(i * step).cast("int"))
    keep = (F.col("n__") <= cap) | (F.col("m__") <= F.col("k__")) | F.array_contains(want, F.col("at__"))
    return placed.where(keep).drop("n__", "k__", "m__", "at__")


def nearest_targets(df: DataFrame, by: Sequence[str], doy: str, row_id: str, n: int, window: tuple[int, int]) -> DataFrame:
    """by and row_id: groups above n rows give, for n evenly spaced days, the row nearest to each that isn't
    taken yet (the earlier, then the smaller id, of equally near ones); smaller groups stay whole. Rows without a
    day are left out. A day can give n rows at most, so only its n smallest ids reach the task of a group."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, row_id))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([doy, row_id])
        if len(pdf) > n:
            left, rows = pdf, []
            for t in np.linspace(*window, n):
                i = (left[doy] - t).abs().idxmin()
                rows.append(i)
                left = left.drop(index=i)
            pdf = pdf.loc[rows]
        return pdf[[*by, row_id]]

    place = F.row_number().over(Window.partitionBy(*by, doy).orderBy(row_id))
    near = df.select(*by, doy, row_id).where(F.col(doy).isNotNull()).withColumn("place__", place).where(F.col("place__") <= n).drop("place__")
    return near.groupBy(*by).applyInPandas(pick, schema)


def labelled(c: Column, cases: Sequence[tuple[Column, str]], other: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(other)
    for cond, name in reversed(list(cases)):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def control_group(doy: Column, ice: Column, april: tuple[int, int], july: tuple[int, int], winter: tuple[int, int]) -> Column:
    return labelled(doy, [
        (doy.between(*april) & (ice < 0.90), "april anchor, outlier"), (doy.between(*april), "april anchor, control"), (doy.between(*july), "july anchor, control"),
        (doy.between(*winter) & (ice < 0.15), "winter, anomaly"), (doy.between(*winter), "winter, ordinary"),
    ], "season, ordinary")


def scrub_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative counts become NULL."""
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share) of NULL or NaN, in one pass."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    one = df.agg(*(F.avg(gone(c).cast("int")).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns))))


def brightness_ratio(df: DataFrame, bands: Sequence[str], near: float = 0.05) -> DataFrame:
    """df with brightness (mean of the bands), ratio to its median over all rows, and is_near."""
    mean = sum((F.col(b) for b in bands[1:]), F.col(bands[0])) / len(bands)
    rows = df.withColumn("brightness", mean)
    typical = percentiles(rows, "brightness", [0.5]).select(F.col("value").alias("typical__"))
    out = rows.crossJoin(F.broadcast(typical)).withColumn("ratio", F.col("brightness") / F.col("typical__"))  # one row
    return out.withColumn("is_near", F.abs(F.col("ratio") - 1) <= near).drop("typical__")


def tracking_gate(curve: DataFrame, brightness: DataFrame, season: str, gates: Sequence[float], fixed: float) -> DataFrame:
    """season, gate, at_fixed, at_gate, shift: each season's value where the gate follows its brightness,
    read off its measured gates by linear interpolation. curve has (season, gate, value)."""
    wide = curve.groupBy(season).pivot("gate", list(gates)).agg(F.first("value"))
    ys = F.array(*(F.col(f"`{g}`") for g in gates))
    joined = wide.join(brightness.select(season, (F.col("ratio") * fixed).alias("gate__")), season).select(season, "gate__", ys.alias("ys"))

    def read(x: Column) -> Column:
        """piecewise with the row's own values: a mean of the knots, weighted by a unit curve of each."""
        units = [piecewise(x, list(gates), [1.0 if i == j else 0.0 for j in range(len(gates))]) for i in range(len(gates))]
        return sum((F.get("ys", i) * u for i, u in enumerate(units)), F.lit(0.0))

    got = joined.select(season, F.col("gate__").alias("gate"), read(F.lit(fixed)).alias("at_fixed"), read(F.col("gate__")).alias("at_gate"))
    return got.withColumn("shift", F.col("at_gate") - F.col("at_fixed"))


def band_of(scene_id: Column, bands: dict[str, dict[str, int]], name: str) -> Column:
    """The number of a named band by the sensor that starts a scene id; an unknown sensor is an error."""
    sensor = F.substring(scene_id, 1, 2)
    out = F.raise_error(F.concat(F.lit("no band map for "), F.coalesce(scene_id, F.lit("a missing id")))).cast("int")
    for s, numbers in bands.items():
        out = F.when(sensor == s, F.lit(numbers[name])).otherwise(out)
    return out


def thermal_stats(cells: DataFrame, key: Sequence[str], kelvin: Column, freezing: float) -> DataFrame:
    """kelvin (median), celsius, thermal_cells and frozen_share of cells with a temperature."""
    got = cells.withColumn("k__", kelvin).where("k__ is not null").groupBy(*key).agg(F.median("k__").alias("kelvin"), F.count("*").alias("thermal_cells"), F.avg((F.col("k__") < freezing).cast("int")).alias("frozen_share"))
    return got.withColumn("celsius", F.col("kelvin") - 273.15)


def contradicted(df: DataFrame, share: str, ice: str, frozen: str, least_share: float, open_below: float, frozen_above: float) -> DataFrame:
    """Visible, called open and yet frozen by another instrument; unknown is not."""
    flag = (F.col(share) >= least_share) & (F.col(ice) < open_below) & (F.col(frozen) > frozen_above)
    return df.withColumn("contradicted", F.coalesce(flag, F.lit(False)))


def annual(df: DataFrame, day: str, value: str) -> DataFrame:
    """year, n, mean, median, cv (standard deviation of the sample over the mean): years with a value. The median is
    exact and no task holds a year."""
    rows = df.select(F.year(day).alias("year"), F.col(value).cast("double").alias("v__")).where("v__ is not null and not isnan(v__)")
    means = rows.groupBy("year").agg(F.count("*").alias("n"), F.avg("v__").alias("mean"), F.try_divide(F.stddev_samp("v__"), F.avg("v__")).alias("cv"))
    mid = percentiles(rows, "v__", [0.5], ["year"]).select(F.col("year").alias("y__"), F.col("value").alias("median"))
    return means.join(mid, F.col("year").eqNullSafe(F.col("y__"))).select("year", "n", "mean", "median", "cv")


def monthly(df: DataFrame, day: str, value: str, baseline: tuple[int, int]) -> DataFrame:
    """year, month, mean, anomaly: monthly means against those of the baseline years."""
    m = df.groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(F.avg(value).alias("mean"))
    base = m.where(F.col("year").between(*baseline)).groupBy("month").agg(F.avg("mean").alias("b__"))
    return m.join(base, "month", "left").select("year", "month", "mean", (F.col("mean") - F.col("b__")).alias("anomaly"))
