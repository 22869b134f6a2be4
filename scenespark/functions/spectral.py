"""Per-cell expressions: reflectance, indices, class flags, masks, radar and thermal units.

All are plain column expressions, so they run inside generated code and push into scans. Inputs are DOUBLE;
NULL in means NULL out unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenespark import presets as P


def finite(c: Column) -> Column:
    """NaN and infinities as NULL, so that aggregates skip them."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def baseline_major(text: Column) -> Column:
    """Leading whole number of a processing baseline; 0 where it can't be read."""
    return F.coalesce(text.cast("string").try_cast("double").try_cast("int"), F.lit(0))


def reflectance(dn: Column, major: Column, quantification: float = P.QUANTIFICATION, offset: float = P.OFFSET, since: int = P.OFFSET_BASELINE) -> Column:
    """Digital number to reflectance, with the offset of newer baselines."""
    return dn / quantification + F.when(major >= since, F.lit(offset)).otherwise(0.0)


def offset_by_date(day: Column, offset: float = P.OFFSET, since: str = P.OFFSET_FROM) -> Column:
    """The offset where only the acquisition date is known."""
    return F.when(day >= F.lit(since).cast("date"), offset).otherwise(0.0)


def void_value(major: Column, offset: float = P.OFFSET, since: int = P.OFFSET_BASELINE) -> Column:
    return F.when(major >= since, F.lit(offset)).otherwise(0.0)


def is_void(bands: Column, void: Column, tolerance: float = P.VOID_TOLERANCE) -> Column:
    """Every band of the array lies within tolerance of the void value."""
    return F.forall(bands, lambda b: F.abs(b - void) < tolerance)


def floor0(c: Column) -> Column:
    """Clamped at zero; NULL stays NULL (greatest() alone would turn it into 0)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def norm_diff(a: Column, b: Column, epsilon: float = P.INDEX_EPSILON) -> Column:
    return (a - b) / (a + b + epsilon)


def stable(a: Column, b: Column, floor: float = P.DENOMINATOR_FLOOR) -> Column:
    """A ratio of two near-zero numbers is noise."""
    return (a + b) > floor


def bright(green: Column, nir: Column, vis_min: float = P.VIS_BRIGHT_MIN, nir_min: float = P.NIR_BRIGHT_MIN) -> Column:
    return (green > vis_min) & (nir > nir_min)


def class_flags(
    green: Column,
    nir: Column,
    swir: Column,
    usable: Column,
    *,
    light: float = P.NDSI_LIGHT,
    solid: float | None = P.NDSI_SOLID,
    water: float = P.NDWI_WATER,
    clamp: bool = True,
    guard: bool = True,
    vis_min: float = P.VIS_BRIGHT_MIN,
    nir_min: float = P.NIR_BRIGHT_MIN,
) -> dict[str, Column]:
    """ndsi, ndwi and the flags ice_solid, ice_light, water, unclassified.

    Both cuts of light ice are strict, so an index that equals `solid` is neither kind of ice. Without clamp
    and guard this is the plain classifier; with solid=None there is one class of ice, ice_light.
    """
    g, n, s = (floor0(x) for x in (green, nir, swir)) if clamp else (green, nir, swir)
    ndsi, ndwi = norm_diff(g, s), norm_diff(g, n)
    snow_ok = bright(green, nir, vis_min, nir_min) & usable
    wet_ok = usable
    if guard:
        snow_ok, wet_ok = snow_ok & stable(g, s), wet_ok & stable(g, n)
    ice_solid = (ndsi > solid) & snow_ok if solid is not None else F.lit(False)
    ice_light = (ndsi > light) & snow_ok & ((ndsi < solid) if solid is not None else F.lit(True))
    flags = {"ice_solid": ice_solid, "ice_light": ice_light}
    flags["water"] = (ndwi > water) & wet_ok & ~ice_light & ~ice_solid
    flags["unclassified"] = usable & ~(flags["ice_solid"] | flags["ice_light"] | flags["water"])
    return {"ndsi": ndsi, "ndwi": ndwi, **{k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}}


def bit_any(qa: Column, bits: Sequence[int] = P.QA_BITS) -> Column:
    """Any of the bits is set."""
    return qa.bitwiseAND(sum(1 << b for b in bits)) > 0


def level2_reflectance(dn: Column, scale: float = P.LEVEL2_SCALE, offset: float = P.LEVEL2_OFFSET) -> Column:
    return F.when(dn != 0, dn * scale + offset)


def toa_reflectance(dn: Column, mult: Column, add: Column, sun_elevation: Column) -> Column:
    """Top-of-atmosphere reflectance; 0 is a gap."""
    return F.try_divide(F.nullif(dn, F.lit(0)) * mult + add, F.sin(F.radians(sun_elevation)))


def brightness_temperature(radiance: Column, k1: Column, k2: Column) -> Column:
    """Kelvin; NULL where the radiance isn't positive."""
    return F.when(radiance > 0, k2 / F.log(k1 / radiance + 1))


def to_db(linear: Column, floor: float = P.RADAR_FLOOR) -> Column:
    """10 log10 of values above the floor; NULL for others, NaN and infinity."""
    return F.when(finite(linear) > floor, 10 * F.log10(linear))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def raster_class(flags: dict[str, Column]) -> Column:
    """One class id a cell; the last class that holds replaces those before (see presets.CLASSES)."""
    out = F.lit(0)
    for i, name in sorted(P.CLASSES.items()):
        if name in flags:
            out = F.when(flags[name], i).otherwise(out)
    return out.cast("tinyint")


def argmax(scores: Column) -> Column:
    """Place of the largest score, from 0; the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cloudy(scores: Column, clear: int = 0) -> Column:
    """A cell whose best class isn't the clear one; the scores come from any cloud model."""
    return argmax(scores) != clear


def index_spread(a: Column, b: Column, sd_a: Column, sd_b: Column) -> Column:
    """Propagated spread of a normalised difference of two independent bands."""
    s = (a + b) * (a + b)
    return F.hypot(2 * b / s * sd_a, 2 * a / s * sd_b)


def stretch(c: Column, lo: float, hi: float, gamma: float = 1.0) -> Column:
    """Clipped to lo … hi, scaled to 0 … 1 and raised to 1/gamma."""
    return F.pow(F.least(F.greatest((c - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)), F.lit(1.0 / gamma))


def diverging(c: Column, lo: float, mid: float, hi: float) -> Column:
    """-1 … 0 … 1 around mid, clipped."""
    below, above = (c - mid) / (mid - lo), (c - mid) / (hi - mid)
    return F.when(c < mid, F.greatest(below, F.lit(-1.0))).otherwise(F.least(above, F.lit(1.0)))


def height_rgb(metres: Column, base: float = -10000.0, step: float = 0.1) -> Column:
    """24-bit height as a struct of three bytes."""
    v = F.greatest(F.least(F.rint((metres - base) / step).cast("int"), F.lit((1 << 24) - 1)), F.lit(0))
    return F.struct(F.shiftright(v, 16).bitwiseAND(255).alias("r"), F.shiftright(v, 8).bitwiseAND(255).alias("g"), v.bitwiseAND(255).alias("b"))


def tile_of(lon: Column, lat: Column, zoom: int) -> Column:
    """Web-map tile of a place: struct(x, y)."""
    n = float(1 << zoom)
    y = (1 - F.asinh(F.tan(F.radians(lat))) / 3.141592653589793) / 2 * n
    clip = lambda v: F.greatest(F.least(F.floor(v).cast("int"), F.lit((1 << zoom) - 1)), F.lit(0))
    return F.struct(clip((lon + 180) / 360 * n).alias("x"), clip(y).alias("y"))


def tile_bounds(x: Column, y: Column, zoom: int) -> Column:
    """West, north, east and south of a web-map tile, in degrees."""
    n = float(1 << zoom)
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(3.141592653589793 * (1 - 2 * v / n))))
    return F.struct(lon(x).alias("west"), lat(y).alias("north"), lon(x + 1).alias("east"), lat(y + 1).alias("south"))
