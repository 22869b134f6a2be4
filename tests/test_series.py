import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenespark.operators import calendar as cal
from scenespark.operators import events as ev
from scenespark.operators import temporal_joins as tj


def each_side(v, limit):
    return pd.Series(v, dtype=float).interpolate(limit=limit, limit_direction="both").tolist()


def series(rng):
    n = rng.randint(1, 60)
    out = []
    while len(out) < n:
        out += [None] * rng.choice([0, 0, 1, 3, rng.randint(1, 40)]) + [round(rng.random(), 3)] * rng.randint(0, 2)
    return out[:n]


def test_two_sided_interpolation_equals_pandas(spark):
    rng = random.Random(1)
    all_ = {k: series(rng) for k in range(120)}
    df = spark.createDataFrame([(k, i, v) for k, s in all_.items() for i, v in enumerate(s)], "k int, i int, v double")
    got = cal.interpolate(df, ["k"], "i", "v", "f", 14).toPandas().sort_values(["k", "i"])
    for k, s in all_.items():
        want = each_side(s, 14)
        np.testing.assert_allclose(got[got.k == k].f.to_numpy(float), want, atol=1e-9)


def test_other_fill_modes(spark):
    v = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, i int, v double")
    f = lambda **kw: [r.f for r in cal.interpolate(df, ["k"], "i", "v", "f", **kw).orderBy("i").collect()]
    assert f(limit=2, mode="whole_gap") == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]
    assert f(mode="inside_only") == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, None]
    assert f(limit=None) == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 8.0]
    with pytest.raises(ValueError):
        f(mode="x")


def test_nan_is_a_gap(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("nan")), (0, 2, 3.0)], "k int, i int, v double")
    assert [r.f for r in cal.interpolate(df, ["k"], "i", "v", "f").orderBy("i").collect()] == [1.0, 2.0, 3.0]


def slow_breakup(days, t, need, least):
    frozen = False
    for d, f in days:
        if f >= t:
            frozen = True
        elif frozen:
            inside = [x for e, x in days if d <= e < d + need]
            if len(inside) >= least and all(x < t for x in inside):
                return d
    return None


def test_breakup_equals_brute_force(spark):
    rng = random.Random(2)
    seasons = {s: sorted({rng.randint(50, 110): None for _ in range(rng.randint(1, 40))}) for s in range(60)}
    rows = [(s, d, round(max(0.0, 1.1 - (d - 50) / 45 + rng.uniform(-0.3, 0.3)), 3)) for s, ds in seasons.items() for d in ds]
    df = spark.createDataFrame(rows, "season int, doy int, frac double")
    for t, need, least in ((0.15, 7, 2), (0.5, 1, 1), (0.5, 14, 2), (0.3, 5, 3)):
        got = dict(map(tuple, ev.breakup(df, ["season"], "doy", "frac", t, need, least).collect()))
        assert got == {s: slow_breakup([(d, f) for x, d, f in rows if x == s], t, need, least) for s in seasons}


def test_asof_equals_pandas(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    left = [(i, rng.randint(0, 3), t0 + dt.timedelta(minutes=rng.randint(0, 400))) for i in range(120)]
    right = [(i, rng.randint(0, 3), t0 + dt.timedelta(minutes=rng.randint(0, 400)), float(i)) for i in range(90)]
    a = spark.createDataFrame(left + [(900, None, t0), (901, 1, None)], "lid int, k int, t timestamp")
    b = spark.createDataFrame(right + [(901, 1, None, 5.0)], "rid int, k int, t timestamp, v double")
    for tol in (0, 60 * 7, 60 * 60):
        got = {r.lid: r.v for r in tj.asof_nearest(a, b, "t", ["k"], ["v"], tol, "lid", "rid").collect()}
        for i, k, t in left:
            near = [(abs((s - t).total_seconds()), s, r) for r, kk, s, _ in right if kk == k and abs((s - t).total_seconds()) <= tol]
            if not near:
                assert got[i] is None
                continue
            d = min(x[0] for x in near)
            early = [r for x, s, r in near if x == d and s <= t]
            assert got[i] == float(max(early) if early else min(r for x, s, r in near if x == d))
        assert got[900] is None and got[901] is None


def test_interval_ties_take_the_later_day(spark):
    day = dt.date(2021, 4, 10)
    cand = spark.createDataFrame([("a", day), ("b", day + dt.timedelta(days=9))], "id string, day date")
    sc = spark.createDataFrame([("s1", day - dt.timedelta(days=1)), ("s2", day + dt.timedelta(days=1)), ("s0", day + dt.timedelta(days=1))], "scene string, day date")
    got = tj.interval_match(cand, sc, "day", ["id"], ["scene"]).collect()
    assert [(r.id, r.scene, r.offset_days) for r in got] == [("a", "s0", 1)]


def test_a_scene_of_two_roles_is_withdrawn(spark):
    rows = [("a", "ice", "s1", 0), ("b", "water", "s1", 0), ("c", "ice", "s2", -1), ("d", "ice", "s2", 0), ("e", "water", "s3", 1)]
    df = spark.createDataFrame(rows, "id string, role string, scene string, offset_days int")
    got = {r.id: r.reject_reason for r in tj.exclude_collisions(df, "scene", "role", [F.col("id")]).collect()}
    assert got == {"a": "claimed by another role", "b": "claimed by another role", "c": "used by the same role", "d": None, "e": None}


def test_persistence_never_tries_the_last_start(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 0.1, 0.1])], "k int, i int, v double")
    assert ev.persistence_rows(df, ["k"], "i", "v", 0.5, 2).first().start is None
    more = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 0.1, 0.1, 0.1])], "k int, i int, v double")
    assert ev.persistence_rows(more, ["k"], "i", "v", 0.5, 2).first().start == 1


def test_empty_series(spark):
    df = spark.createDataFrame([], "k int, day date, v double")
    assert cal.densify(df, ["k"], "day").count() == 0
    assert ev.breakup(df.selectExpr("k", "dayofyear(day) doy", "v"), ["k"], "doy", "v").count() == 0
