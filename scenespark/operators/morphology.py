"""Morphology on boolean rasters, one scene a row (an array of rows), in Arrow batches. Outside the raster is
False for every operation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RASTER = T.ArrayType(T.ArrayType(T.BooleanType()))


def _shifted(m: np.ndarray, offsets) -> list[np.ndarray]:
    h, w = m.shape
    r = max(max(abs(a), abs(b)) for a, b in offsets)
    p = np.pad(m, r)
    return [p[r + a : r + a + h, r + b : r + b + w] for a, b in offsets]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def dilate(m: np.ndarray, offsets=SQUARE) -> np.ndarray:
    return np.logical_or.reduce(_shifted(m, offsets))


def erode(m: np.ndarray, offsets=SQUARE) -> np.ndarray:
    return np.logical_and.reduce(_shifted(m, [(-a, -b) for a, b in offsets]))


def label(m: np.ndarray) -> np.ndarray:
    """Components of touching cells (by edge), numbered from 1 in reading order; 0 outside."""
    h, w = m.shape
    up = np.arange(h * w)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    flat = m.ravel()
    for a, b in _touching(m):
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    roots = np.asarray([root(i) if flat[i] else -1 for i in range(h * w)])
    _, out = np.unique(roots, return_inverse=True)
    return (out.reshape(h, w) + (0 if (roots == -1).any() else 1)) * m


def _touching(m: np.ndarray) -> list[tuple[int, int]]:
    w = m.shape[1]
    right = np.argwhere(m[:, 1:] & m[:, :-1]) @ np.asarray([w, 1])
    down = np.argwhere(m[1:] & m[:-1]) @ np.asarray([w, 1])
    return [(int(i), int(i) + 1) for i in right] + [(int(i), int(i) + w) for i in down]


def close(m: np.ndarray, offsets=SQUARE) -> np.ndarray:
    return erode(dilate(m, offsets), offsets)


def open_(m: np.ndarray, offsets=SQUARE) -> np.ndarray:
    return dilate(erode(m, offsets), offsets)


def fill_holes(m: np.ndarray) -> np.ndarray:
    """Background that does not reach the border becomes foreground."""
    if not m.size:
        return m
    back = label(np.pad(~m, 1, constant_values=True))
    return ~(back == back[0, 0])[1:-1, 1:-1]


def largest(m: np.ndarray) -> np.ndarray:
    """The largest component; the first of equal ones."""
    if not m.any():
        return m
    parts = label(m)
    return parts == np.bincount(parts[m]).argmax()


def on_raster(f, mask: Column | str) -> Column:
    """f(mask) for a column of rasters; NULL stays NULL."""

    @F.pandas_udf(RASTER)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else [r.tolist() for r in f(np.asarray([np.asarray(x, bool) for x in v], bool))] if len(v) else [])

    return run(mask)
