"""Thresholds from distributions. Values are counted into bins first, in one combined pass over the data;
everything after works on the bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.operators.ordered import percentiles, running_sum  # noqa: F401


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float, by: Sequence[str] = ()) -> DataFrame:
    """by, bin, n for every bin from 0, also empty ones; the last bin holds its upper edge. Values outside,
    NULL and NaN aren't counted."""
    v = F.col(value).cast("double")
    place = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    n = df.where(v.between(lo, hi) & ~F.isnan(v)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    groups = n.select(*by).distinct() if by else n.limit(1).select()
    grid = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(n, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _arrays(h: DataFrame, by: Sequence[str]) -> DataFrame:
    return h.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"].cast("double")).alias("n"))


def otsu(df: DataFrame, value: str, bins: int = 512, lo: float = -1.0, hi: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """threshold and eta (between-class share of the variance): the bin centre that parts the histogram best;
    of a run of equal ones (within 1e-12) the middle."""
    step = (hi - lo) / bins
    centre = F.col("bin") * step + (lo + step / 2)
    h = histogram(df, value, bins, lo, hi, by)
    w = Window.partitionBy(*by)
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("n") / F.sum("n").over(w)
    h = h.withColumn("c", centre).withColumn("p", p).withColumn("omega", F.sum("p").over(run)).withColumn("mu", F.sum(F.col("p") * F.col("c")).over(run)).withColumn("mu_t", F.sum(F.col("p") * F.col("c")).over(w))
    between = F.try_divide(F.pow(F.col("mu_t") * F.col("omega") - F.col("mu"), F.lit(2)), F.when((F.col("omega") > 0) & (F.col("omega") < 1), F.col("omega") * (1 - F.col("omega"))))
    h = h.withColumn("b", between).withColumn("best", F.max("b").over(w)).withColumn("var", F.sum(F.col("p") * F.pow(F.col("c") - F.col("mu_t"), F.lit(2))).over(w))
    tied = F.array_sort(F.collect_list(F.when(F.col("b") >= F.col("best") - 1e-12, F.col("c"))))
    return h.groupBy(*by).agg(tied.alias("t"), F.max("best").alias("best"), F.max("var").alias("var")).select(*by, F.get("t", F.floor(F.size("t") / 2).cast("int")).alias("threshold"), F.coalesce(F.try_divide("best", F.nullif("var", F.lit(0.0))), F.lit(0.0)).alias("eta"))


def valley(df: DataFrame, value: str, bins: int = 256, lo: float = -1.0, hi: float = 1.0, smooth: int = 9, mode_share: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """valley and modes: the lowest bin centre between the two highest modes of the smoothed histogram (the
    middle of equal ones), NULL with fewer than two modes."""
    step = (hi - lo) / bins
    w = Window.partitionBy(*by).orderBy("bin")
    half = smooth // 2
    h = histogram(df, value, bins, lo, hi, by).withColumn("s", F.sum("n").over(w.rowsBetween(half - smooth + 1, half)) / float(smooth))
    h = h.withColumn("top", F.max("s").over(Window.partitionBy(*by)))
    peak = (F.col("s") > F.lag("s").over(w)) & (F.col("s") >= F.lead("s").over(w)) & (F.col("s") >= mode_share * F.col("top"))
    h = h.withColumn("peak", F.coalesce(peak, F.lit(False)))
    rows = h.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "s"))).alias("all"), F.array_sort(F.collect_list(F.when(F.col("peak"), F.struct((-F.col("s")).alias("s"), (-F.col("bin")).alias("bin"))))).alias("peaks"))
    a, b = -F.get("peaks", 0)["bin"], -F.get("peaks", 1)["bin"]
    left, right = F.least(a, b), F.greatest(a, b)
    span = F.when(F.size("peaks") >= 2, F.filter("all", lambda x: x["bin"].between(left, right)))
    rows = rows.withColumn("span", span).withColumn("low", F.array_min(F.transform("span", lambda x: x["s"])))
    tied = F.filter("span", lambda x: x["s"] <= F.col("low") + 1e-12)
    return rows.select(*by, (F.get(tied, F.floor(F.size(tied) / 2).cast("int"))["bin"] * step + (lo + step / 2)).alias("valley"), F.size("peaks").alias("modes"))


def sweep2d(df: DataFrame, x: str, y: str, positive: Column, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """x_floor, y_floor, recall, false_rate, balanced of the gate x > x_floor and y > y_floor.

    A row is counted in the cell of the highest floors that it passes; sums over higher cells then give every
    gate. So data is read once, whatever the grid.
    """
    xs, ys = sorted(xs), sorted(ys)
    passed = lambda c, floors: F.size(F.filter(F.array(*map(F.lit, floors)), lambda f: c > f))
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(passed(F.col(x), xs).alias("i"), passed(F.col(y), ys).alias("j"), positive.alias("pos")).agg(F.count("*").alias("n"))
    totals = cells.agg(F.sum(F.when(F.col("pos"), F.col("n"))).alias("tp"), F.sum(F.when(~F.col("pos"), F.col("n"))).alias("tn"))
    grid = lambda k, floors, name: F.explode(F.array(*(F.struct(F.lit(i).alias(k), F.lit(f).alias(name)) for i, f in enumerate(floors))))
    # every counted cell to the gates that it passes: at most grid x grid rows
    gates = cells.select("i", "j", "pos", "n", grid("gi", xs, "x_floor").alias("a")).where("a.gi < i").select("j", "pos", "n", "a.x_floor", grid("gj", ys, "y_floor").alias("b")).where("b.gj < j")
    hit = gates.groupBy("x_floor", "b.y_floor").agg(F.sum(F.when(F.col("pos"), F.col("n"))).alias("p"), F.sum(F.when(~F.col("pos"), F.col("n"))).alias("q"))
    frame = totals.select("*", grid("gi", xs, "x_floor").alias("a")).select("tp", "tn", "a.x_floor", grid("gj", ys, "y_floor").alias("b")).select("tp", "tn", "x_floor", "b.y_floor")
    got = frame.join(hit, ["x_floor", "y_floor"], "left")
    rate = lambda n, d: F.try_divide(F.coalesce(F.col(n), F.lit(0)).cast("double"), F.col(d).cast("double"))
    return got.select("x_floor", "y_floor", rate("p", "tp").alias("recall"), rate("q", "tn").alias("false_rate")).withColumn("balanced", 0.5 * (F.col("recall") + 1 - F.col("false_rate")))


def plateau(scores: DataFrame, grid: str, score: str, tolerance: float, by: Sequence[str] = ()) -> DataFrame:
    """lo and hi of the grid values whose score is within the tolerance of the best."""
    best = F.max(score).over(Window.partitionBy(*by))
    return scores.withColumn("best__", best).where(F.col(score) >= F.col("best__") - tolerance).groupBy(*by).agg(F.min(grid).alias("lo"), F.max(grid).alias("hi"), F.max("best__").alias("best"))


def recommend(plateaus: DataFrame, current: Column) -> DataFrame:
    """Keep the current value if it lies on the plateau, else take the plateau's middle."""
    inside = current.between(F.col("lo"), F.col("hi"))
    return plateaus.withColumn("action", F.when(inside, "keep").otherwise("move")).withColumn("value", F.when(inside, current).otherwise((F.col("lo") + F.col("hi")) / 2))


def score_sets(df: DataFrame, candidates: dict[str, Column], label: Column, weight: Column | None = None) -> DataFrame:
    """candidate, recall, false_rate, accuracy of boolean predictions, weighted; rows without a label don't
    count. One pass for all candidates."""
    w = weight if weight is not None else F.lit(1.0)
    total = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    aggs = []
    for i, c in enumerate(candidates.values()):
        hit = F.coalesce(c, F.lit(False))
        aggs += [total(label & hit).alias(f"tp{i}"), total(~label & hit).alias(f"fp{i}")]
    one = df.where(label.isNotNull()).agg(total(label).alias("p"), total(~label).alias("q"), *aggs)
    rows = F.array(*(F.struct(F.lit(n).alias("candidate"), F.try_divide(f"tp{i}", F.col("p")).alias("recall"), F.try_divide(f"fp{i}", F.col("q")).alias("false_rate"), F.try_divide(F.col(f"tp{i}") + F.col("q") - F.col(f"fp{i}"), F.col("p") + F.col("q")).alias("accuracy")) for i, n in enumerate(candidates)))
    return one.select(F.inline(rows))


def rank_chunks(df: DataFrame, order: Sequence[str], values: Sequence[str], n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Medians of the values in n chunks by rank; the first chunks are the larger ones.

    Places in a whole table come from a range sort (see `ordered`); `order` is a total order."""
    if by:
        chunk = F.ntile(n).over(Window.partitionBy(*by).orderBy(*order))
        numbered = df.withColumn("chunk", chunk)
    else:
        one = df.select(*order, *[v for v in values if v not in order]).withColumn("one__", F.lit(1))
        nth = running_sum(one, [], order, "one__", "nth__")
        rows = nth.crossJoin(F.broadcast(nth.agg(F.max("nth__").alias("all__"))))  # one row
        k, rest, i = F.floor(F.col("all__") / n), F.col("all__") % n, F.col("nth__") - 1
        large = rest * (k + 1)
        chunk = F.when(i < large, F.floor(i / (k + 1))).otherwise(rest + F.floor((i - large) / F.greatest(k, F.lit(1)))) + 1
        numbered = rows.withColumn("chunk", chunk.cast("int"))
    return numbered.groupBy(*by, "chunk").agg(F.count("*").alias("n"), *(F.median(v).alias(v) for v in values))


def band_differences(a: DataFrame, b: DataFrame, key: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """band, median, p99, worst of absolute differences between two encodings of the same cells."""
    both = a.select(*key, *bands).join(b.select(*key, *(F.col(x).alias(f"{x}__b") for x in bands)), list(key))
    long = both.select(F.inline(F.array(*(F.struct(F.lit(x).alias("band"), F.abs(F.col(x) - F.col(f"{x}__b")).alias("d")) for x in bands))))
    return long.groupBy("band").agg(F.median("d").alias("median"), F.percentile("d", F.lit(0.99)).alias("p99"), F.max("d").alias("worst"))


def mixed_share(cells: DataFrame, key: Sequence[str], flag: str, k: int) -> DataFrame:
    """Share of k x k blocks that hold both kinds of cells."""
    block = cells.groupBy(*key, F.floor(F.col("y") / k).alias("by__"), F.floor(F.col("x") / k).alias("bx__")).agg(F.avg(F.col(flag).cast("int")).alias("m"))
    return block.groupBy(*key).agg(F.avg(((F.col("m") > 0) & (F.col("m") < 1)).cast("int")).alias("mixed_share"))
