"""Data-quality gates. Every gate is rows (gate, status, detail); the verdict follows from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenespark import presets as P

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
Gate = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Scalar:
    """A gate that one aggregation over all rows decides: named aggregates, and rows made of them. Scalar
    gates are fused, so any number of them read the table once."""

    aggs: dict[str, Column]
    rows: Sequence[tuple[str, Column, Column]]

    def __call__(self, df: DataFrame) -> DataFrame:
        return fused(df, [self])


def fused(df: DataFrame, gates: Sequence[Scalar]) -> DataFrame:
    one = df.agg(*(c.alias(n) for g in gates for n, c in g.aggs.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("gate"), s.alias("status"), d.alias("detail")) for g in gates for n, s, d in g.rows))))


def _one(df: DataFrame, gate: str, aggs: Sequence[Column], status: Column, detail: Column) -> DataFrame:
    """One row from one aggregation."""
    return df.agg(*aggs).select(F.lit(gate).alias("gate"), status.alias("status"), detail.alias("detail"))


def _n(name: str) -> Column:
    return F.col(name).cast("string")


def _bad(name: str, status: str = FAIL) -> Column:
    return F.when(F.col(name) > 0, status).otherwise(PASS)


def header(columns: Sequence[str], current: Sequence[str], legacy: Sequence[str]) -> tuple[str, str]:
    """Status and detail of a header line; decided on the driver, before any scan."""
    if list(columns) == list(current):
        return PASS, "current"
    if list(columns) == list(legacy):
        return WARN, "legacy"
    missing, extra = [c for c in current if c not in columns], [c for c in columns if c not in current]
    return FAIL, f"missing {missing}, unexpected {extra}"


def rows_intact(lines: DataFrame, fields: int, separator: str = ",") -> DataFrame:
    """From text lines (column value) without the header: too many fields fail, too few warn."""
    n = F.size(F.split("value", separator, -1))
    aggs = [F.count_if(n > fields).alias("over"), F.count_if(n < fields).alias("under")]
    status = F.when(F.col("over") > 0, FAIL).when(F.col("under") > 0, WARN).otherwise(PASS)
    return _one(lines.where("value <> ''"), "rows_intact", aggs, status, F.concat(_n("over"), F.lit(" over, "), _n("under"), F.lit(" under")))


def derived(usable_share: float = P.USABLE_SHARE) -> Scalar:
    """classified_px and usable follow from the counts."""
    classified = F.col("solid_px") + F.col("light_px") + F.col("water_px")
    grid = classified + F.col("cloud_px") + F.col("land_px") + F.col("nodata_px")
    usable = F.coalesce(F.try_divide(classified, F.nullif(grid, F.lit(0))) >= usable_share, F.lit(False)).cast("int")
    aggs = {"off_c": F.count_if(F.col("classified_px").isNull() | (F.col("classified_px") != classified)), "off_u": F.count_if(F.col("usable").isNull() | (F.col("usable") != usable))}
    return Scalar(aggs, [(f"derived_{n}", _bad(c), F.concat(_n(c), F.lit(" rows differ"))) for n, c in (("classified", "off_c"), ("usable", "off_u"))])


def no_duplicates(df: DataFrame, key: Sequence[str], gate: str) -> DataFrame:
    twice = df.groupBy(*key).count().where("count > 1")
    return _one(twice, gate, [F.count("*").alias("n")], F.when(F.col("n") > 0, FAIL).otherwise(PASS), F.concat(_n("n"), F.lit(" keys repeat")))


def tiles(df: DataFrame, tile: str, allowed: Sequence[str]) -> DataFrame:
    """Foreign tiles fail; a mixed record warns and says how much of it the most frequent tile has."""
    n = df.groupBy(tile).count().agg(
        F.coalesce(F.sum(F.when(~F.coalesce(F.col(tile).isin(*allowed), F.lit(False)), F.col("count"))), F.lit(0)).alias("foreign"), F.count("*").alias("tiles"), (F.max("count") / F.sum("count")).alias("most")
    )
    rows = F.array(
        F.struct(F.lit("tiles").alias("gate"), F.when(F.col("foreign") > 0, FAIL).otherwise(PASS).alias("status"), F.concat(_n("foreign"), F.lit(" foreign rows")).alias("detail")),
        F.struct(F.lit("tiles_mixed").alias("gate"), F.when(F.col("tiles") > 1, WARN).otherwise(PASS).alias("status"), F.concat(_n("tiles"), F.lit(" tiles, at most "), F.coalesce(F.round(100 * F.col("most")).cast("int"), F.lit(0)).cast("string"), F.lit(" % of rows in one")).alias("detail")),
    )
    return n.select(F.inline(rows))


def ranges(shares: Sequence[str] = P.SHARES, counts: Sequence[str] = P.COUNTS) -> Scalar:
    ice = F.col("solid_pct") + F.col("light_pct")
    bad = [F.count_if((F.col(c) < 0) | (F.col(c) > 1)) for c in shares] + [F.count_if(F.col(c) < 0) for c in counts] + [F.count_if((ice < 0) | (ice > 1))]
    return Scalar({"n_ranges": sum(bad[1:], bad[0])}, [("ranges", _bad("n_ranges"), F.concat(_n("n_ranges"), F.lit(" values out of range")))])


def indices(columns: Sequence[str] = ("mean_ndsi_solid", "mean_ndsi_light", "mean_ndwi_water")) -> Scalar:
    bad = [F.count_if((F.col(c) < -1) | (F.col(c) > 1)) for c in columns]
    return Scalar({"n_indices": sum(bad[1:], bad[0])}, [("indices", _bad("n_indices", WARN), F.concat(_n("n_indices"), F.lit(" index means beyond -1 to 1")))])


def zeroed_band() -> Scalar:
    """A water index of exactly 1 over nothing but water: a band read as fill."""
    bad = (F.abs(F.col("mean_ndwi_water") - 1) < 1e-6) & (F.abs(F.col("water_pct_clear") - 1) < 1e-3)
    return Scalar({"n_zeroed": F.count_if(bad)}, [("zeroed_band", _bad("n_zeroed"), F.concat(_n("n_zeroed"), F.lit(" scenes")))])


def grid(shares: Sequence[str] = P.SHARES, counts: Sequence[str] = P.COUNTS) -> Scalar:
    """Counts over shares imply one grid: rows that disagree with themselves by over 1 % fail; a spread over
    2 % of the median warns; rows that occupy over 100.5 % of it fail."""
    implied = F.filter(F.array(*(F.struct(F.col(s).alias("s"), F.try_divide(F.col(c), F.nullif(F.col(s), F.lit(0.0))).alias("g")) for s, c in zip(shares, counts))), lambda x: x["s"] > 0.01)
    large = F.transform(F.filter(implied, lambda x: x["s"] >= 0.05), lambda x: x["g"])
    g = F.array_max(implied)["g"]
    torn = (F.size(large) > 1) & (F.array_max(large) - F.array_min(large) > 0.01 * F.array_max(large))
    occupied = sum((F.col(c) for c in counts[1:]), F.col(counts[0])) - F.col("unknown_px")
    aggs = {"n_torn": F.count_if(torn), "spread": (F.max(g) - F.min(g)) / F.median(g), "n_over": F.count_if(occupied > 1.005 * g), "n_grids": F.count(g)}
    status = F.when(F.col("n_grids") == 0, WARN).when(F.col("n_torn") > 0, FAIL).when(F.col("spread") > 0.02, WARN).otherwise(PASS)
    return Scalar(aggs, [("grid", status, F.concat(_n("n_torn"), F.lit(" rows with two grids"))), ("grid_accounting", _bad("n_over"), F.concat(_n("n_over"), F.lit(" rows over the grid")))])


def season_shape(df: DataFrame, season: str, doy: str, value: str, winter: tuple[int, int], summer: tuple[int, int], least: int = 5) -> DataFrame:
    """Winter above summer in every season with enough scenes in both; seasons with fewer warn."""
    w, s = (F.when(F.col(doy).between(*x), F.col(value)) for x in (winter, summer))
    per = df.groupBy(season).agg(F.avg(w).alias("w"), F.avg(s).alias("s"), F.least(F.count(w), F.count(s)).alias("n"))
    got = per.agg(F.count_if((F.col("n") >= least) & ~(F.col("w") > F.col("s"))).alias("bad"), F.count_if(F.col("n") >= least).alias("judged"), F.count_if(F.col("n") < least).alias("thin"))
    status = F.when(F.col("bad") > 0, FAIL).when(F.col("judged") > 0, PASS).otherwise(WARN)
    return got.select(F.inline(F.array(
        F.struct(F.lit("season_shape").alias("gate"), status.alias("status"), F.concat(_n("bad"), F.lit(" of "), _n("judged"), F.lit(" seasons upside down")).alias("detail")),
        F.struct(F.lit("season_shape_thin").alias("gate"), F.when(F.col("thin") > 0, WARN).otherwise(PASS).alias("status"), F.concat(_n("thin"), F.lit(" seasons thin")).alias("detail")),
    )))


def scene_counts(df: DataFrame, season: str, expected: DataFrame) -> DataFrame:
    """At least the inventory's scenes (season, expected) in every season."""
    got = expected.join(df.groupBy(season).count(), season, "left")
    return _one(got, "scene_counts", [F.count_if(F.coalesce("count", F.lit(0)) < F.col("expected")).alias("n")], F.when(F.col("n") > 0, FAIL).otherwise(PASS), F.concat(_n("n"), F.lit(" seasons incomplete")))


def baseline_shift(new: DataFrame, old: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """shared, only_new, only_old, mean_shift, mean_abs_shift against an older series."""
    a = new.select(*key, F.col(value).alias("n"))
    b = old.select(*key, F.col(value).alias("o"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), list(key), "full_outer")
    d = F.col("n") - F.col("o")
    shared = F.col("in_a") & F.col("in_b")
    return both.agg(F.count_if(shared).alias("shared"), F.count_if(F.col("in_b").isNull()).alias("only_new"), F.count_if(F.col("in_a").isNull()).alias("only_old"), F.avg(d).alias("mean_shift"), F.avg(F.abs(d)).alias("mean_abs_shift"))


def movers(new: DataFrame, old: DataFrame, key: Sequence[str], value: str, top: int = 10) -> DataFrame:
    """The largest changes."""
    both = new.select(*key, F.col(value).alias("now")).join(old.select(*key, F.col(value).alias("was")), list(key)).withColumn("delta", F.col("now") - F.col("was"))
    return both.orderBy(F.abs("delta").desc(), *key).limit(top)


def run_gates(df: DataFrame, gates: Sequence[Gate | Scalar]) -> DataFrame:
    """Rows of all gates; the scalar ones share one pass."""
    scalar = [g for g in gates if isinstance(g, Scalar)]
    out = fused(df, scalar) if scalar else None
    for g in gates:
        if not isinstance(g, Scalar):
            out = g(df) if out is None else out.unionByName(g(df))
    return out


def verdict(rows: DataFrame) -> DataFrame:
    """REJECT if a gate failed, REVIEW if one warned, else ACCEPT."""
    return rows.agg(F.when(F.bool_or(F.col("status") == FAIL), "REJECT").when(F.bool_or(F.col("status") == WARN), "REVIEW").otherwise("ACCEPT").alias("verdict"))


def repair_derived(df: DataFrame, usable_share: float = P.USABLE_SHARE) -> DataFrame:
    """classified_px and usable recomputed; measured columns untouched, so a second run changes nothing."""
    classified = F.col("solid_px") + F.col("light_px") + F.col("water_px")
    total = classified + F.col("cloud_px") + F.col("land_px") + F.col("nodata_px")
    return df.withColumn("classified_px", classified).withColumn("usable", F.coalesce(F.try_divide(F.col("classified_px"), F.nullif(total, F.lit(0))) >= usable_share, F.lit(False)).cast("int"))


def assert_measured_unchanged(before: DataFrame, after: DataFrame, measured: Sequence[str]) -> None:
    a, b = before.select(*measured), after.select(*measured)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("a measured column moved")


def flatten_claims(claims: DataFrame, json: str = "json") -> DataFrame:
    """(path, value) of every scalar in a JSON text, nested objects by dotted paths."""
    kind = "map<string,string>"
    level = claims.select(F.explode(F.from_json(F.col(json), kind)).alias("path", "value"))
    nested = F.coalesce(F.col("value").startswith("{") & F.from_json("value", kind).isNotNull(), F.lit(False))
    inner = F.transform(F.map_entries(F.from_json("value", kind)), lambda e: F.struct(F.concat_ws(".", "path", e["key"]).alias("path"), e["value"].alias("value")))
    while not level.where(nested).isEmpty():  # a pass for each level of nesting
        level = level.select(F.inline(F.when(nested, inner).otherwise(F.array(F.struct("path", "value")))))
    return level


def drift(claims: DataFrame, computed: DataFrame, tolerance: float = 0.0006) -> DataFrame:
    """path, claimed, computed, status of two frames (path, value): numbers may differ by the tolerance, all
    else must be equal, and a path on one side only has drifted."""
    a, b = claims.select("path", F.col("value").alias("claimed")), computed.select("path", F.col("value").alias("computed"))
    x, y = F.col("claimed").try_cast("double"), F.col("computed").try_cast("double")
    same = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(F.col("claimed").eqNullSafe(F.col("computed")))
    return a.join(b, "path", "full_outer").select("path", "claimed", "computed", F.when(same, PASS).otherwise(FAIL).alias("status"))


def snapshot_drift(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """rows_a, rows_b, worst difference and same of two snapshots."""
    x = a.select(*key, F.lit(1).alias("in_a"), *(F.col(c).alias(f"{c}__a") for c in columns))
    y = b.select(*key, F.lit(1).alias("in_b"), *(F.col(c).alias(f"{c}__b") for c in columns))
    far = [F.when(F.col(f"{c}__a").eqNullSafe(F.col(f"{c}__b")), 0.0).otherwise(F.coalesce(F.abs(F.col(f"{c}__a") - F.col(f"{c}__b")), F.lit(float("inf")))) for c in columns]
    got = x.join(y, list(key), "full_outer").agg(F.count("in_a").alias("rows_a"), F.count("in_b").alias("rows_b"), F.max(F.greatest(*far, F.lit(0.0))).alias("worst"))
    return got.withColumn("same", (F.col("rows_a") == F.col("rows_b")) & (F.col("worst") <= tolerance))


def require(value: DataFrame, column: str, published: float, tolerance: float) -> None:
    """Refuses to go on unless a one-row result replicates a published figure."""
    got = value.select(column).first()[0]
    if got is None or abs(got - published) > tolerance:
        raise ValueError(f"{column} is {got}; {published} within {tolerance} was published")
