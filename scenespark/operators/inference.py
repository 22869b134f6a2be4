"""Tests and estimates. Moments, ranks and pairs are relational; seeded resampling runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenespark.functions.special import normal_two_sided, student_two_sided
from scenespark.operators.ordered import running_sum


def average_rank(df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1; equal values share the mean of theirs. Counts of distinct values are summed, so a value
    that many rows share is one row in the sort."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n__"))
    ranks = running_sum(n, by, [value], "n__", out).withColumn(out, F.col(out) - (F.col("n__") - 1) / 2).drop("n__")
    return df.join(ranks, [*by, value])


def auc(df: DataFrame, value: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """auc (P(positive > negative) + half P(equal)), n_positive, n_negative; NULL without both.

    From counts of distinct values, so equal values and a hot class cost nothing more."""
    rows = df.where(F.col(value).isNotNull() & positive.isNotNull())
    c = rows.groupBy(*by, value).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    got = running_sum(c, by, [value], "q", "upto").withColumn("wins", F.col("p") * (F.col("upto") - F.col("q") / 2)).groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"))
    return got.select(*by, F.try_divide(F.col("wins"), F.nullif(F.col("n_positive").cast("double") * F.col("n_negative"), F.lit(0.0))).alias("auc"), "n_positive", "n_negative")


def mann_kendall(df: DataFrame, order: str, value: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """s, variance (tie-corrected), z (with continuity) and two-sided p of a short series (a row a season)."""
    rows = df.select(*by, F.col(order).alias("o__"), F.col(value).cast("double").alias("v__")).where("v__ is not null")
    got = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o__", "v__"))), lambda x: x["v__"]).alias("v"))
    n = F.size("v")
    s = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + F.aggregate(F.slice("v", i, n), F.lit(0.0), lambda b, y: b + F.signum(y - F.get("v", i - 1))))
    ties = F.aggregate(F.array_distinct("v"), F.lit(0.0), lambda a, x: a + _tie(F.size(F.filter("v", lambda y: y == x))))
    got = got.select(*by, s.alias("s"), ((n * (n - 1) * (2 * n + 5) - ties) / 18.0).alias("variance"))
    got = got.withColumn("z", F.when(F.col("variance") > 0, (F.col("s") - F.signum("s")) / F.sqrt("variance")))
    return got.withColumn("p", normal_two_sided("z")) if p_value else got


def _tie(c: Column) -> Column:
    return c * (c - 1) * (2 * c + 5)


def kendall_tau(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """tau-b of a short table, from concordant and discordant pairs."""
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("v"))
    n = F.size("v")

    def pairs(f) -> Column:
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + F.aggregate(F.slice("v", i, n), F.lit(0.0), lambda b, q: b + f(F.get("v", i - 1), q)))

    s = pairs(lambda p, q: F.signum(p["x"] - q["x"]) * F.signum(p["y"] - q["y"]))
    nx, ny = pairs(lambda p, q: F.abs(F.signum(p["x"] - q["x"]))), pairs(lambda p, q: F.abs(F.signum(p["y"] - q["y"])))
    return got.select(*by, F.try_divide(s, F.nullif(F.sqrt(nx * ny), F.lit(0.0))).alias("tau"), n.alias("n"))


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept, r, n and the two-sided p of the slope."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    got = df.where(ok).groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count("*").alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))))
    return got.withColumn("p", student_two_sided(t, (F.col("n") - 2).cast("double")))


def theil_sen(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Median of pairwise slopes of a short series, and the intercept through the medians."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = rows.select(*by, F.col(x).alias("xa"), F.col(y).alias("ya")), rows.select(*by, F.col(x).alias("xb"), F.col(y).alias("yb"))
    pairs = a.join(b, list(by)) if by else a.crossJoin(b)  # a season a row
    slopes = pairs.where("xb > xa").groupBy(*by).agg(F.median((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).alias("slope"))
    mids = rows.groupBy(*by).agg(F.median(x).alias("mx"), F.median(y).alias("my"))
    both = slopes.join(mids, list(by)) if by else slopes.crossJoin(mids)
    return both.select(*by, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def theil_sen_interval(df: DataFrame, x: str, y: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """by, slope, low, high, pairs: the median slope of a short series and its distribution-free interval: as many
    sorted slopes off the middle as Kendall's score varies, ties of either axis taken off. Two points give the one
    slope three times; a series without two different x has no row."""
    rows = df.select(*by, F.col(x).cast("double").alias("x__"), F.col(y).cast("double").alias("y__")).where("x__ is not null and y__ is not null")
    pts = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x__", "y__"))).alias("p"))  # a season a point
    later = lambda a: F.transform(F.filter("p", lambda b: b["x__"] > a["x__"]), lambda b: (b["y__"] - a["y__"]) / (b["x__"] - a["x__"]))
    got = pts.withColumn("s", F.array_sort(F.flatten(F.transform("p", later)))).where(F.size("s") > 0)
    score = lambda n: n * (n - 1) * (2 * n + 5)

    def ties(c: str) -> Column:
        vs = F.transform("p", lambda q: q[c])
        times = F.transform(F.array_distinct(vs), lambda v: F.size(F.filter(vs, lambda w: w == v)))
        return F.aggregate(times, F.lit(0.0), lambda acc, n: acc + score(n))

    z = NormalDist().inv_cdf((1 + level) / 2)
    width = z * F.sqrt(F.greatest((score(F.size("p")) - ties("x__") - ties("y__")) / 18.0, F.lit(0.0)))
    n = F.size("s")
    at = lambda i: F.get("s", F.least(F.greatest(i.cast("int"), F.lit(0)), n - 1))
    mid = (F.get("s", F.floor((n - 1) / 2).cast("int")) + F.get("s", F.floor(n / 2).cast("int"))) / 2
    return got.select(*by, mid.alias("slope"), at(F.bround((n - width) / 2) - 1).alias("low"), at(F.bround((n + width) / 2)).alias("high"), n.alias("pairs"))


def rmse_bias(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, bias (a less b), r and n of paired measures."""
    d = F.col(a) - F.col(b)
    return df.where(d.isNotNull()).groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.corr(a, b).alias("r"), F.count("*").alias("n"))


def spread_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, median, p90, worst."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"), F.max(value).alias("worst"))


def mad_spread(df: DataFrame, value: str, by: Sequence[str], least: int = 1) -> DataFrame:
    """median, spread (1.4826 times the median absolute deviation) and cells of groups with enough rows."""
    mid = df.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("cells")).where(F.col("cells") >= least)
    off = df.join(mid, list(by)).groupBy(*by).agg(F.first("median").alias("median"), (F.median(F.abs(F.col(value) - F.col("median"))) * 1.4826).alias("spread"), F.first("cells").alias("cells"))
    return off


def correlation_by(df: DataFrame, x: str, y: str, by: Sequence[str], least: int = 12) -> DataFrame:
    """corr, n and the mean y of the rows with the least and the most third of x, for groups with enough
    rows."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cuts = ok.groupBy(*by).agg(F.corr(x, y).alias("corr"), F.count("*").alias("n"), F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).where(F.col("n") >= least)
    got = ok.join(cuts, list(by)).groupBy(*by).agg(
        F.first("corr").alias("corr"), F.first("n").alias("n"), F.avg(F.when(F.col(x) <= F.get("q", 0), F.col(y))).alias("lowest_third"), F.avg(F.when(F.col(x) >= F.get("q", 1), F.col(y))).alias("highest_third")
    )
    return got


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(rows))


# --- seeded resampling -----------------------------------------------------------------------------------


def _per_group(df: DataFrame, by: Sequence[str], columns: Sequence[str], run, schema: str) -> DataFrame:
    """applyInPandas over groups; without `by` all rows are one group (small samples by nature)."""
    keys = list(by) or ["all__"]
    kinds = dict(df.dtypes)
    data = df.select(*(by or [F.lit(0).alias("all__")]), *columns)
    head = "".join(f"`{k}` {kinds.get(k, 'int')}, " for k in keys)

    def call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([run(pdf)])
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    got = data.groupBy(*keys).applyInPandas(call, head + schema)
    return got if by else got.drop("all__")


#: Values that a block of draws holds.
DRAWN = 4_000_000


def _resampled(v: np.ndarray, draws: int, rng: np.random.Generator, statistic) -> np.ndarray:
    """The statistic (of rows) of so many samples with replacement, made in blocks of bounded size."""
    out, step = np.empty(draws), max(1, DRAWN // max(1, len(v)))
    for a in range(0, draws, step):
        out[a : a + step] = statistic(v[rng.integers(0, len(v), (min(step, draws - a), len(v)))], axis=1)
    return out


def bootstrap_se(df: DataFrame, value: str, by: Sequence[str] = (), draws: int = 2000, seed: int = 20260811) -> DataFrame:
    """se and n: standard error of the mean by resampling. Values are sorted first, so a seed gives one result
    however the rows are dealt; fewer than two have none."""

    def run(pdf: pd.DataFrame) -> dict:
        v = np.sort(pdf[value].dropna().to_numpy(float))
        se = _resampled(v, draws, np.random.default_rng(seed), np.mean).std(ddof=1) if len(v) > 1 else None
        return {"se": None if se is None else float(se), "n": len(v)}

    return _per_group(df, by, [value], run, "se double, n long")


def bootstrap_median(df: DataFrame, value: str, by: Sequence[str] = (), draws: int = 5000, seed: int = 20260804, rule: str = "percentile") -> DataFrame:
    """median, lo, hi: 95 % interval by numpy's percentiles, or by places in the sorted draws (rule
    "index")."""

    def run(pdf: pd.DataFrame) -> dict:
        v = np.sort(pdf[value].dropna().to_numpy(float))
        if not len(v):
            return {"median": None, "lo": None, "hi": None, "n": 0}
        m = _resampled(v, draws, np.random.default_rng(seed), np.median)
        lo, hi = np.percentile(m, [2.5, 97.5]) if rule == "percentile" else np.sort(m)[[int(0.025 * draws), int(0.975 * draws) - 1]]
        return {"median": float(np.median(v)), "lo": float(lo), "hi": float(hi), "n": len(v)}

    return _per_group(df, by, [value], run, "median double, lo double, hi double, n long")


def bootstrap_decline(df: DataFrame, value: str, late: str, by: Sequence[str] = (), draws: int = 20_000, seed: int = 20260811) -> DataFrame:
    """decline_pct with a 95 % interval, both periods resampled; `late` is a boolean column."""

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna().sort_values(value)
        e, l = (pdf.loc[pdf[late] == k, value].to_numpy(float) for k in (False, True))  # noqa: E741
        if not len(e) or not len(l):
            return {"decline_pct": None, "lo": None, "hi": None}
        rng = np.random.default_rng(seed)
        after, before = _resampled(l, draws, rng, np.mean), _resampled(e, draws, rng, np.mean)
        lo, hi = np.percentile(100 * (1 - after / before), [2.5, 97.5])
        return {"decline_pct": 100 * (1 - l.mean() / e.mean()), "lo": float(lo), "hi": float(hi)}

    return _per_group(df, by, [value, late], run, "decline_pct double, lo double, hi double")


def monte_carlo_medians(df: DataFrame, value: str, group: str, by: Sequence[str] = (), draws: int = 20_000, seed: int = 20260804) -> DataFrame:
    """gap of the medians of two groups (a boolean column) and its p by shuffling, (hits + 1) / (draws + 1)."""

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna().sort_values([group, value])
        v, k = pdf[value].to_numpy(float), int(pdf[group].sum())
        if not 0 < k < len(v):
            return {"gap": None, "p": None}
        gap = float(np.median(v[len(v) - k :]) - np.median(v[: len(v) - k]))
        rng, hits = np.random.default_rng(seed), 0
        for a in range(0, draws, 1000):
            s = rng.permuted(np.tile(v, (min(1000, draws - a), 1)), axis=1)
            hits += int((np.abs(np.median(s[:, :k], axis=1) - np.median(s[:, k:], axis=1)) >= abs(gap) - 1e-12).sum())
        return {"gap": gap, "p": (hits + 1) / (draws + 1)}

    return _per_group(df, by, [value, group], run, "gap double, p double")


def clustering_permutation(df: DataFrame, season: str, flag: str, draws: int = 20_000, seed: int = 20260804) -> DataFrame:
    """observed sum of squared flag counts per season, and how often shuffled flags reach it."""

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna().sort_values([season, flag])
        s = pd.factorize(pdf[season])[0]
        f = pdf[flag].to_numpy(bool)
        if not len(f):
            return {"observed": None, "p": None}
        of = lambda x: int((np.bincount(s, weights=x) ** 2).sum())
        rng, observed = np.random.default_rng(seed), of(f)
        hits = sum(of(rng.permutation(f)) >= observed for _ in range(draws))
        return {"observed": observed, "p": (hits + 1) / (draws + 1)}

    return _per_group(df, (), [season, flag], run, "observed long, p double")


# --- unmixing --------------------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Least squares with non-negative coefficients, by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    g = a.T @ (b - a @ x)
    tol = 1e-10 * max(1.0, float(np.abs(a.T @ b).max()))
    for _ in range(rounds):
        if free.all() or g[~free].max() <= tol:
            break
        free[np.flatnonzero(~free)[g[~free].argmax()]] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            low = free & (z <= 0)
            x = x + np.min(x[low] / (x[low] - z[low])) * (z - x)
            free &= x > 1e-15
            x[~free] = 0
        g = a.T @ (b - a @ x)
    return x


def unmix(df: DataFrame, spectrum: str, members: dict[str, Sequence[float]], scatter: Sequence[float] | None = None, sum_to_one: float = 1e4) -> DataFrame:
    """df with shares (member -> share) and rms: every spectrum (array) as a non-negative mixture of the
    members and an optional scatter column, shares softly summing to one."""
    names = list(members)
    a = np.column_stack([*(np.asarray(members[k], float) for k in names), *([np.asarray(scatter, float)] if scatter is not None else [])])
    last = np.concatenate([np.full(len(names), sum_to_one), np.zeros(a.shape[1] - len(names))])
    stacked = np.vstack([a, last])

    @F.pandas_udf("struct<shares:map<string,double>,rms:double>")
    def solve(s: pd.Series) -> pd.DataFrame:
        shares, rms = [], []
        for v in s:
            if v is None or len(v) != len(a) or not np.isfinite(np.asarray(v, float)).all():
                shares.append(None)
                rms.append(None)
                continue
            v = np.asarray(v, float)
            x = nnls(stacked, np.append(v, sum_to_one))
            shares.append({k: float(c) for k, c in zip(names, x)})
            rms.append(float(np.sqrt(np.mean((a @ x - v) ** 2))))
        return pd.DataFrame({"shares": shares, "rms": rms})

    return df.withColumn("mix__", solve(spectrum)).select(*df.columns, "mix__.shares", "mix__.rms")
