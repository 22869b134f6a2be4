"""Distribution functions that Spark SQL lacks, as vectorised UDFs over the few rows of a test statistic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(f, *cols: pd.Series) -> pd.Series:
    ok = ~np.logical_or.reduce([c.isna() for c in cols])
    out = pd.Series(np.nan, index=cols[0].index, dtype=float)
    out[ok] = [f(*v) for v in zip(*(c[ok] for c in cols))]
    return out.astype("Float64").where(ok, pd.NA)


@F.pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return _each(math.erf, x)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) with df degrees of freedom."""
    return _each(lambda v, n: incomplete_beta(n / 2, 0.5, n / (n + v * v)) if n > 0 else math.nan, t, df)
