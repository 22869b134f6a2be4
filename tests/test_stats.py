import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.functions import special as fn
from scenespark.operators import candidates as cd
from scenespark.operators import clusters as cl
from scenespark.operators import contrasts as ct
from scenespark.operators import inference as st
from scenespark.operators import thresholds as th


def table(spark, values):
    return spark.createDataFrame([(2017 + i, float(v), 100) for i, v in enumerate(values)], "season int, value double, n_days long")


def slow_p(v, k):
    gap = lambda c: abs(np.mean([v[i] for i in c]) - np.mean([v[i] for i in range(len(v)) if i not in c]))
    return np.mean([gap(c) >= gap(range(k)) - 1e-12 for c in itertools.combinations(range(len(v)), k)])


# season values and what follows from them (fixed values)
SEASONS = [0.738073078125, 0.755518625, 0.61105425, 0.63084265625, 0.431086171875, 0.765605578125, 0.438425210937, 0.667575335937, 0.390190265625, 0.48442146875]


def test_published_decline(spark):
    t = table(spark, SEASONS)
    r = ct.period_decline(t, "season", 2021).first()
    assert r.decline_pct == pytest.approx(22.5658, abs=1e-3) and (r.n_early, r.n_late) == (4, 6)
    p = ct.split_sums(t.withColumn("k", F.lit(4)), [], "season", "value", "k").first()
    assert p.splits == 210 and p.p == pytest.approx(25 / 210)
    m = st.mann_kendall(t, "season", "value").first()
    assert m.s == -15 and m.p == pytest.approx(0.2105, abs=1e-4)


def test_published_leave_one_out(spark):
    got = {r.dropped: r.decline_pct for r in ct.leave_one_out(table(spark, SEASONS), "season", 2021).collect()}
    for s in got:
        kept = [(2017 + i, v) for i, v in enumerate(SEASONS) if 2017 + i != s]
        e, l = (np.mean([v for y, v in kept if (y >= 2021) == late]) for late in (False, True))  # noqa: E741
        assert got[s] == pytest.approx(100 * (1 - l / e))
    assert min(got.values()) == pytest.approx(18.5, abs=0.06) and max(got.values()) == pytest.approx(29.5, abs=0.06)


def test_permutation_equals_brute_force(spark):
    rng = random.Random(1)
    for n, k in ((2, 1), (5, 2), (9, 4), (6, 6), (4, 0)):
        v = [rng.choice([0.1, 0.2, rng.random()]) for _ in range(n)]
        r = ct.split_sums(table(spark, v), [], "season", "value", k).first()
        if 0 < k < n:
            assert r.p == pytest.approx(slow_p(v, k)) and r.splits == math.comb(n, k)
        else:
            assert r.p is None
    for n, k in ((11, 4), (12, 6), (13, 1)):  # by halves, as beyond `most`
        v = [rng.choice([0.1, 0.2, rng.random()]) for _ in range(n)]
        r, whole = (ct.split_sums(table(spark, v), [], "season", "value", k, most=m).first() for m in (10, 200_000))
        assert r.p == pytest.approx(slow_p(v, k)) and r.splits == math.comb(n, k) and r.widest == pytest.approx(whole.widest)
    r = ct.split_sums(table(spark, [rng.random() for _ in range(22)]), [], "season", "value", 11).first()
    assert r.splits == math.comb(22, 11) and 0 < r.p <= 1


def test_an_empty_period_has_no_decline(spark):
    r = ct.period_decline(table(spark, [1, 2, 3]), "season", 2030).first()
    assert r.decline_pct is None and r.n_late == 0


def test_special_functions(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 3.0), (-2.0, 10.0), (None, 2.0), (2.228139, 10.0)], "x double, n double")
    got = df.select(fn.erf("x").alias("e"), fn.normal_two_sided("x").alias("z"), fn.student_two_sided("x", "n").alias("t")).collect()
    assert got[1].e == pytest.approx(math.erf(1)) and got[2].z == pytest.approx(math.erfc(2 / math.sqrt(2))) and got[3].e is None
    assert got[0].t == pytest.approx(1) and got[4].t == pytest.approx(0.05, abs=1e-6) and got[1].t == pytest.approx(0.391002, abs=1e-6)


def test_auc(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (0.5, False), (None, True)], "v double, y boolean")
    assert st.auc(df, "v", F.col("y")).first().auc == 1.0
    same = spark.createDataFrame([(1.0, True), (1.0, False)], "v double, y boolean")
    assert st.auc(same, "v", F.col("y")).first().auc == 0.5
    assert st.auc(same.where("y"), "v", F.col("y")).first().auc is None


def test_otsu_and_valley(spark):
    rng = np.random.default_rng(2)
    two = np.concatenate([rng.normal(-0.5, 0.05, 3000), rng.normal(0.5, 0.05, 3000)])
    df = spark.createDataFrame([(float(x),) for x in two], "v double")
    o = th.otsu(df, "v").first()
    assert -0.3 < o.threshold < 0.3 and o.eta > 0.9
    v = th.valley(df, "v").first()
    assert -0.35 < v.valley < 0.35 and v.modes >= 2
    one = spark.createDataFrame([(float(x),) for x in rng.normal(0, 0.1, 3000)], "v double")
    assert th.otsu(one, "v").first().eta < 0.75
    assert th.otsu(df.where("v > 5"), "v").first() is None or th.otsu(df.where("v > 5"), "v").first().threshold is None


def test_sweep_is_monotone(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b), bool(a + b > 1)) for a, b in rng.random((500, 2))], "x double, y double, p boolean")
    got = {(r.x_floor, r.y_floor): r for r in th.sweep2d(df, "x", "y", F.col("p"), [0.1, 0.5, 0.9], [0.0, 0.5]).collect()}
    assert len(got) == 6 and got[0.1, 0.0].recall >= got[0.5, 0.0].recall >= got[0.9, 0.0].recall and got[0.9, 0.5].false_rate == 0.0


def test_bootstrap_is_reproducible(spark):
    df = spark.createDataFrame([(i % 2, float(i % 17)) for i in range(60)], "g int, v double")
    a = sorted(map(tuple, st.bootstrap_se(df, "v", ["g"], 200).collect()))
    b = sorted(map(tuple, st.bootstrap_se(df.repartition(7), "v", ["g"], 200).collect()))
    assert a == b and all(0.3 < s < 1.5 for _, s, _ in a)
    m = st.bootstrap_median(df, "v").first()
    assert m.lo <= m.median <= m.hi
    assert st.bootstrap_se(df.limit(1), "v").first().se is None


def test_monte_carlo(spark):
    rng = random.Random(4)
    apart = spark.createDataFrame([(rng.gauss(5 * (i % 2), 1), i % 2 == 1) for i in range(60)], "v double, g boolean")
    p = st.monte_carlo_medians(apart, "v", "g", draws=1000).first().p
    assert 0 < p < 0.01


def test_nnls():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.random((8, 4)), rng.normal(size=8)
        x = st.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-7).all() and abs(g @ x) < 1e-7  # the optimality conditions
    mix = np.column_stack([[0.9, 0.8, 0.1], [0.1, 0.05, 0.0]])
    assert st.nnls(mix, mix @ [0.3, 0.7]) == pytest.approx([0.3, 0.7])


def test_knn_and_split(spark):
    lab = spark.createDataFrame([(i, float(i), "a" if i < 5 else "b") for i in range(10)], "id int, x double, y string")
    q = spark.createDataFrame([(100, 0.2), (101, 9.0)], "qid int, x double")
    assert dict(map(tuple, cl.knn_labels(q, lab, ["x"], "qid", "id", "y", 3).collect())) == {100: "a", 101: "b"}
    assert dict(map(tuple, cl.knn_labels(q, lab, ["x"], "qid", "id", "y", 3, block=2, most_broadcast=0).collect())) == {100: "a", 101: "b"}
    assert dict(map(tuple, cl.knn_labels(q, lab, ["x"], "qid", "id", "y", 99, block=3).collect())) == {100: "a", 101: "a"}
    s = cl.shuffle_split(spark.range(5000), ["id"], {"train": 0.8, "valid": 0.1, "test": 0.1}).groupBy("split").count()
    n = dict(map(tuple, s.collect()))
    assert abs(n["train"] - 4000) < 150 and abs(n["valid"] - 500) < 90 and sum(n.values()) == 5000


def test_joins_make_pairs_in_proportion_to_rows(spark):
    """One day, values spread evenly: the candidates of a join by bucket stay near the pairs that are close."""
    from scenespark.operators import temporal_joins as tj

    n = 2000
    a = spark.range(n).select(F.lit(1).alias("day"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    got = tj._close(a, a.select("day", F.col("i").alias("i_b"), F.col("v").alias("v_b")), ["day"], "v", 1.0).count()
    assert got < 10 * n and tj.same_day_pairs(a, a, "day", "v", 1.0).count() == 3 * n - 2
    odd = spark.createDataFrame([(1, 1, float("nan")), (1, 2, float("inf")), (1, 3, None), (1, 4, 1e300), (1, 5, 1e300), (1, 6, -0.0), (1, 7, 1.0)], "day int, i int, v double")
    rows = {(r.i, r.i_b) for r in tj.same_day_pairs(odd, odd, "day", "v", 1.0).collect()}
    assert rows == {(4, 4), (4, 5), (5, 4), (5, 5), (6, 6), (6, 7), (7, 6), (7, 7)}
    asked = spark.range(n).select(F.col("id").alias("c"), F.lit("2020-01-01").cast("date").alias("day"))
    scenes = spark.range(n).select(F.col("id").alias("s"), F.lit("2020-01-02").cast("date").alias("day"))
    assert {tuple(r) for r in tj.interval_match(asked, scenes, "day", ["c"], ["s"]).select("offset_days", "s").distinct().collect()} == {(1, 0)}


def test_claims_of_any_depth(spark):
    from scenespark.operators import gates

    text = "1"
    for i in reversed(range(14)):
        text = f'{{"k{i}": {text}, "t{i}": "{{no object"}}'
    got = {r.path: r.value for r in gates.flatten_claims(spark.createDataFrame([(text,), (None,)], "json string")).collect()}
    assert got[".".join(f"k{i}" for i in range(14))] == "1" and got["t0"] == "{no object" and len(got) == 15


def test_theil_sen_interval(spark):
    rng = random.Random(4)
    for n in (2, 5, 12):
        pts = [(float(rng.randint(0, n)) if n > 2 else float(i), rng.choice([0.0, 1.0, rng.random()])) for i in range(n)]
        df = spark.createDataFrame([*pts, (None, 1.0), (2.0, None)], "x double, y double")
        s = sorted((d - b) / (c - a) for a, b in pts for c, d in pts if c > a)
        score = lambda k: k * (k - 1) * (2 * k + 5)
        var = (score(n) - sum(score(sum(q[i] == v for q in pts)) for i in (0, 1) for v in {q[i] for q in pts})) / 18
        w = 1.959963984540054 * math.sqrt(max(var, 0))
        low, high = max(round((len(s) - w) / 2) - 1, 0), min(round((len(s) + w) / 2), len(s) - 1)
        r = st.theil_sen_interval(df, "x", "y").first()
        assert (r.slope, r.low, r.high, r.pairs) == (pytest.approx(np.median(s)), pytest.approx(s[low]), pytest.approx(s[high]), len(s))
    assert not st.theil_sen_interval(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").collect()


def test_nearest_targets_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(1, rng.choice([60, 61, 90, 150]), i) for i in range(60)] + [(2, 70, i) for i in range(20)] + [(3, 70 + i, i) for i in range(3)] + [(1, None, 99), (None, 100, 7)]
    rng.shuffle(rows)
    want = set()
    for year in (1, 2, 3, None):
        left = sorted((d, i) for y, d, i in rows if y == year and d is not None)
        if len(left) > 8:
            picked = []
            for t in np.linspace(53, 180, 8):
                picked.append(min(left, key=lambda r: (abs(r[0] - t), r)))
                left.remove(picked[-1])
            left = picked
        want |= {(year, i) for _, i in left}
    df = spark.createDataFrame(rows, "year int, doy int, id long")
    got = cd.nearest_targets(df, ["year"], "doy", "id", 8, (53, 180)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
