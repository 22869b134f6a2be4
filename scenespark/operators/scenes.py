"""Scene selection, scene summaries and rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark import presets as P
from scenespark.functions.spectral import raster_class

# --- catalogue guards ------------------------------------------------------------------------------------


def plausible(bbox: Column, lon: float = P.MAX_LON_SPAN, lat: float = P.MAX_LAT_SPAN) -> Column:
    """A footprint that doesn't span the globe; false where there is none."""
    ok = (F.size(bbox) >= 4) & (F.get(bbox, 2) - F.get(bbox, 0) <= lon) & (F.get(bbox, 3) - F.get(bbox, 1) <= lat)
    return F.coalesce(ok, F.lit(False))


def coverage(bbox: Column, area: Sequence[float]) -> Column:
    """Share of the area (west, south, east, north) that a box covers; 0 without a box."""
    w, s, e, n = area
    size = (e - w) * (n - s)
    dx = F.least(F.get(bbox, 2), F.lit(e)) - F.greatest(F.get(bbox, 0), F.lit(w))
    dy = F.least(F.get(bbox, 3), F.lit(n)) - F.greatest(F.get(bbox, 1), F.lit(s))
    return F.when(F.size(bbox) >= 4, F.greatest(dx, F.lit(0.0)) * F.greatest(dy, F.lit(0.0)) / size).otherwise(0.0)


def overlap_of(a: Column, b: Column) -> Column:
    """Share of box b that box a covers, both arrays of west, south, east, north."""
    dx = F.least(F.get(a, 2), F.get(b, 2)) - F.greatest(F.get(a, 0), F.get(b, 0))
    dy = F.least(F.get(a, 3), F.get(b, 3)) - F.greatest(F.get(a, 1), F.get(b, 1))
    return F.try_divide(F.greatest(dx, F.lit(0.0)) * F.greatest(dy, F.lit(0.0)), (F.get(b, 2) - F.get(b, 0)) * (F.get(b, 3) - F.get(b, 1)))


def box_join(scenes: DataFrame, areas: DataFrame, cell: float = 1.0, least: float = P.MIN_COVERAGE) -> DataFrame:
    """Scenes with every area of which they cover at least `least`; both have a column bbox, areas also
    area_id. Boxes are dealt to grid cells of `cell` degrees, so the join is an equi-join and not a product;
    a pair is kept in the south-west cell that its boxes share."""

    def cells(df: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.get("bbox", lo) / cell), F.floor(F.get("bbox", hi) / cell))
        return df.withColumn("cx", F.explode(span(0, 2))).withColumn("cy", F.explode(span(1, 3)))

    a, b = cells(scenes.where(plausible(F.col("bbox")))), cells(areas.withColumnRenamed("bbox", "bbox")).select("area_id", F.col("bbox").alias("area_box"), "cx", "cy")
    first = (F.col("cx") == F.floor(F.greatest(F.get("bbox", 0), F.get("area_box", 0)) / cell)) & (F.col("cy") == F.floor(F.greatest(F.get("bbox", 1), F.get("area_box", 1)) / cell))
    joined = a.join(b, ["cx", "cy"]).where(first).withColumn("covered", overlap_of(F.col("bbox"), F.col("area_box")))
    return joined.where(F.col("covered") >= least).drop("cx", "cy")


def utm_zone(lon: Column) -> Column:
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def zone_of_id(scene_id: Column) -> Column:
    """Zone number in an id such as S2A_22WDD_20170219_0."""
    return F.regexp_extract(scene_id, r"_(\d{2})[A-Z]{3}_", 1).try_cast("int")


def tile_of_id(scene_id: Column) -> Column:
    return F.nullif(F.regexp_extract(scene_id, r"_(\d{2}[A-Z]{3})(?:_|$)", 1), F.lit(""))


def rewrite_href(href: Column, old: str, new: str) -> Column:
    return F.replace(href, F.lit(old), F.lit(new))


def reject_partial(bands: DataFrame, key: Sequence[str], blank: float = P.BLANK_BAND, not_blank: float = P.NOT_BLANK_SCENE, spread: float = P.PARTIAL_SPREAD) -> DataFrame:
    """key and rejected, from (key, band, zero_share): scenes whose bands disagree about where data is
    missing. A band of fill in a scene that isn't, or one far above the median, is a failed read. Scenes of
    fewer than three bands are accepted."""
    medians = F.median("zero_share").over(Window.partitionBy(*key))
    n = F.count("*").over(Window.partitionBy(*key))
    bad = (n >= 3) & (((F.col("zero_share") >= blank) & (F.col("m") <= not_blank)) | (F.col("zero_share") - F.col("m") > spread))
    return bands.withColumn("m", medians).withColumn("bad", bad).groupBy(*key).agg(F.bool_or("bad").alias("rejected"))


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in a total order (end it with a unique id)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")


def top_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cloud_rank(cloud: Column) -> Column:
    """Cloud cover as it orders scenes: NULL, and 0 as well, count as 100."""
    return F.when(cloud.isNull() | (cloud == 0), 100.0).otherwise(cloud)


def clamp(df: DataFrame, order: Sequence[Column], most: int | None) -> DataFrame:
    """Sorted, and no more than `most` rows; 0 and None mean no limit."""
    return df.orderBy(*order).limit(most) if most else df.orderBy(*order)


def spread_sample(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """n rows of every key at evenly spaced places of its order (all of a key with fewer): those at
    round(i * (count - 1) / (n - 1)), halves to even."""
    w = Window.partitionBy(*key)
    placed = df.withColumn("at__", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n__", F.count("*").over(w))
    want = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("n__") - 1) / F.lit(max(n - 1, 1)).cast("double")).cast("int"))
    return placed.where((F.col("n__") <= n) | F.array_contains(want, F.col("at__"))).drop("at__", "n__")


# --- rasters and summaries -------------------------------------------------------------------------------


def pool(cells: DataFrame, key: Sequence[str], values: Sequence[str], k: int, height: int, width: int, how: str = "mean") -> DataFrame:
    """k x k blocks of (key, y, x, values); rows and columns beyond the last full block are left out.
    how: mean, or majority (the mean is at least a half)."""
    inside = cells.where((F.col("y") < height // k * k) & (F.col("x") < width // k * k))
    f = (lambda c: F.avg(c)) if how == "mean" else (lambda c: F.avg(F.col(c).cast("double")) >= 0.5)
    block = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return inside.groupBy(*key, block("y"), block("x")).agg(*(f(v).alias(v) for v in values))


def nearest_cells(cells: DataFrame, source: Sequence[float], target: Sequence[float], height: int, width: int) -> DataFrame:
    """Cells (y, x, …) on another grid of the same projection by nearest neighbour. source and target are
    affine transforms (a, b, c, d, e, f) without rotation: x = a * column + c, y = e * row + f. Every target
    cell looks up one source cell, an equi-join; cells beyond the source are absent."""
    spark = cells.sparkSession
    sa, _, sc, _, se, sf = source
    ta, _, tc, _, te, tf = target
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("ty"), (F.col("id") % width).cast("int").alias("tx"))
    wanted = grid.select("ty", "tx", F.floor(((F.col("ty") + 0.5) * te + tf - sf) / se).cast("int").alias("y"), F.floor(((F.col("tx") + 0.5) * ta + tc - sc) / sa).cast("int").alias("x"))
    return wanted.join(cells, ["y", "x"]).drop("y", "x").withColumnsRenamed({"ty": "y", "tx": "x"})


def summarise(cells: DataFrame, key: Sequence[str], digits: int = 4, nodata_share: float = P.NODATA_SHARE, usable_share: float = P.USABLE_SHARE) -> DataFrame:
    """One row a scene from cells with the flags ice_solid, ice_light, water, cloud, land, nodata and the
    indices ndsi, ndwi.

    *_px counts and *_pct shares of the grid; unknown_px: how far the classes overlap; unclassified_px: in no
    class; clear_px: not cloud, land or gap; classified_px: ice or water, the denominator of *_pct_clear
    (NULL without any); usable: classified share of the grid at least usable_share; edge_gap: gaps at least
    nodata_share; index means over their classes, NULL without any. One aggregation, combined before its
    shuffle.
    """
    flags = {"solid": "ice_solid", "light": "ice_light", "water": "water", "cloud": "cloud", "land": "land", "nodata": "nodata"}
    f = {k: F.coalesce(F.col(c), F.lit(False)) for k, c in flags.items()}
    any_of = lambda *names: F.greatest(*(f[n] for n in names))
    got = cells.groupBy(*key).agg(
        F.count("*").alias("total"),
        *(F.count_if(f[k]).alias(f"{k}_px") for k in f),
        F.count_if(any_of(*f)).alias("occupied"),
        F.count_if(~any_of("cloud", "land", "nodata")).alias("clear_px"),
        F.count_if(any_of("solid", "light", "water")).alias("classified_px"),
        F.avg(F.when(f["solid"], F.nanvl("ndsi", F.lit(None)))).alias("mean_ndsi_solid"),
        F.avg(F.when(f["light"], F.nanvl("ndsi", F.lit(None)))).alias("mean_ndsi_light"),
        F.avg(F.when(f["water"], F.nanvl("ndwi", F.lit(None)))).alias("mean_ndwi_water"),
    )
    px = [f"{k}_px" for k in f]
    summed = sum((F.col(c) for c in px[1:]), F.col(px[0]))
    share = lambda c, of: F.round(F.try_divide(F.col(c), F.nullif(F.col(of), F.lit(0))), digits)
    return got.select(
        *key, *px,
        F.greatest(summed - F.col("occupied"), F.lit(0)).alias("unknown_px"),
        F.greatest(F.col("total") - F.col("occupied"), F.lit(0)).alias("unclassified_px"),
        *(share(c, "total").alias(c.replace("_px", "_pct")) for c in px),
        "clear_px", share("clear_px", "total").alias("clear_pct"), "classified_px",
        (F.col("classified_px") / F.col("total") >= usable_share).cast("int").alias("usable"),
        *(share(f"{k}_px", "classified_px").alias(f"{k}_pct_clear") for k in ("solid", "light", "water")),
        *(F.round(c, digits).alias(c) for c in ("mean_ndsi_solid", "mean_ndsi_light", "mean_ndwi_water")),
        (F.col("nodata_px") / F.col("total") >= nodata_share).cast("int").alias("edge_gap"),
    )


def class_counts(cells: DataFrame, key: Sequence[str], flags: dict[str, Column] | None = None) -> DataFrame:
    """key and a map from class name to cells, in the raster's order of classes."""
    flags = flags or {n: F.col(n) for n in P.CLASSES.values() if n != "unclassified"}
    names = F.create_map(*(x for i, n in P.CLASSES.items() for x in (F.lit(i), F.lit(n))))
    counted = cells.select(*key, raster_class(flags).cast("int").alias("c")).groupBy(*key, "c").count()
    return counted.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.element_at(names, F.col("c")).alias("name"), "count")))).alias("classes"))


def consensus_mask(cells: DataFrame, by: Sequence[str], value: str, floor: float, share: float = 0.5) -> DataFrame:
    """Cells (by) where the given percentile of a value over a stack of scenes is above a floor."""
    return cells.groupBy(*by).agg((F.percentile(value, F.lit(share)) > floor).alias("mask"))


def any_mask(cells: DataFrame, by: Sequence[str], value: str, floor: float) -> DataFrame:
    """Cells where any scene of a stack is above a floor."""
    return cells.groupBy(*by).agg(F.coalesce(F.bool_or(F.col(value) > floor), F.lit(False)).alias("mask"))


def shares_if_covered(cells: DataFrame, key: Sequence[str], valid: Column, classes: dict[str, Column], least: float) -> DataFrame:
    """Class shares of the valid cells of scenes of which at least `least` is valid; NULL of others."""
    got = cells.groupBy(*key).agg(F.avg(valid.cast("int")).alias("coverage"), *(F.avg(F.when(valid, c.cast("int"))).alias(n) for n, c in classes.items()))
    return got.select(*key, "coverage", *(F.when(F.col("coverage") >= least, F.col(n)).alias(n) for n in classes))


def dark_scenes(cells: DataFrame, key: Sequence[str], bands: Sequence[Column], below: float = 0.01, share: float = 0.95) -> DataFrame:
    """key, dark_share and skip: scenes of which at least `share` is nearly black in all bands together."""
    total = sum(bands[1:], bands[0])
    return cells.groupBy(*key).agg(F.avg((total < below).cast("int")).alias("dark_share")).withColumn("skip", F.col("dark_share") >= share)


def radar_gates(df: DataFrame, valid_least: float = P.RADAR_VALID, contrast_above: float = P.RADAR_CONTRAST) -> DataFrame:
    """passes_gates and reject_reason of radar scenes with valid_share, water_median_db, land_contrast_db;
    the first reason that applies."""
    reason = (
        F.when(F.coalesce(F.col("valid_share") < valid_least, F.lit(True)), "valid share")
        .when(F.col("water_median_db").isNull() | F.isnan("water_median_db"), "no water median")
        .when(F.coalesce(F.col("land_contrast_db") <= contrast_above, F.lit(True)), "land contrast")
    )
    return df.withColumn("reject_reason", reason).withColumn("passes_gates", F.col("reject_reason").isNull())


def radar_scene_stats(cells: DataFrame, key: Sequence[str], linear: str = "linear", land: str = "land") -> DataFrame:
    """valid_share, cell counts and dB percentiles over water and land of cells in linear units; contrast is
    the land median above the water median."""
    from scenespark.functions.spectral import to_db

    db = cells.withColumn("db__", to_db(F.col(linear)))
    water, rock = F.when(~F.col(land), F.col("db__")), F.when(F.col(land), F.col("db__"))
    got = db.groupBy(*key).agg(
        F.avg(F.col("db__").isNotNull().cast("int")).alias("valid_share"),
        F.count(water).alias("water_cells"),
        F.count(rock).alias("land_cells"),
        F.percentile(water, F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("w"),
        F.median(rock).alias("land_median_db"),
    )
    w = [F.get("w", i) for i in range(3)]
    return got.select(*key, "valid_share", "water_cells", "land_cells", w[0].alias("water_median_db"), w[1].alias("water_p5_db"), w[2].alias("water_p95_db"), "land_median_db", (F.col("land_median_db") - w[0]).alias("land_contrast_db"))
