import math
import random

import numpy as np
import pytest

from scenespark.llm import quality as ql

SF = "/root/testdata/sf0.01"


def test_features_see_the_whole_text():
    long = "plain words here " * 50_000 + "vilest"
    assert ql._bin(b"w vilest") in ql.bins_of(long) and ql._bin(b"s viles") in ql.bins_of(long)
    assert ql.bins_of(None) == ql.bins_of("") != ql.bins_of("x")
    assert ql._bin(b"mark %%%") in ql.bins_of("a%%% b")


def test_scorer_adds_each_weight_once():
    model = ql.OrdinalModel({ql._bin(b"w bad"): -2.0, ql._bin(b"s bad"): -1.0, ql._bin(b"mark !!"): -0.5}, (0.0, 1.0))
    assert ql.Scorer(model).score("BAD bad bad!! !!") == -3.5
    p = model.at_least(np.asarray([0.0, 5.0, -900.0]))
    assert (p[:, 0] >= p[:, 1]).all() and abs(p[0, 0] - 0.5) < 1e-12 and math.isfinite(p[2, 1])


def test_fit_recovers_the_likelihood_maximum():
    rng = np.random.default_rng(1)
    n, on = 4000, rng.random(4000) < 0.4
    score = 1.5 * on
    u = rng.logistic(size=n) + score
    grades = (u > -1).astype(int) + (u > 0.5)
    m = ql.fit(grades, [np.asarray([7, 9]) if x else np.asarray([7]) for x in on], 3, penalty=0.0)
    assert list(m.weights) == [9]
    assert abs(m.weights[9] - 1.5) < 0.25 and abs(m.thresholds[0] + 1) < 0.2 and abs(m.thresholds[1] - 0.5) < 0.2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rated = ql.ratings(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = ql.train(docs.where("doc_id % 4 <> 0"), rated)
    out = ql.classify(docs.where("doc_id % 4 = 0"), model).join(rated, "doc_id").groupBy("grade", "keep").count().collect()
    n = {(r.grade, r.keep): r["count"] for r in out}
    kept = {g: n.get((g, True), 0) / (n.get((g, True), 0) + n.get((g, False), 0)) for g in range(3)}
    assert kept[2] > 0.98 and kept[0] < 0.1 and kept[1] < 0.25, kept


def test_odd_rows(spark):
    rng = random.Random(0)
    good = [(i, " ".join(rng.choice("the sea ice is wide".split()) for _ in range(20)), 1) for i in range(60)]
    bad = [(100 + i, "%%% junk " * 10 + str(i), 1) for i in range(60)]
    odd = [(300, None, 1), (None, "no id", 1), (1, good[1][1], 1), (301, "", 1), (302, "word " * 100_000, 1)]
    df = spark.createDataFrame(good + bad + odd, "doc_id long, text string, KEEP int")
    rated = spark.createDataFrame([(i, 2) for i in range(60)] + [(100 + i, 1) for i in range(60)] + [(100, 2), (None, 1), (3, None), (999, 0)], "doc_id long, grade int")
    model = ql.train(df, rated)
    out = ql.classify(df, model)
    assert out.columns == ["doc_id", "text", "KEEP", "expected_grade", "p_grade_1", "p_grade_2", "keep_"]
    rows = out.collect()
    assert len(rows) == 125 and all(0 <= r.p_grade_2 <= r.p_grade_1 <= 1 and abs(r.expected_grade - r.p_grade_1 - r.p_grade_2) < 1e-9 for r in rows)
    assert all(r.keep_ == (r.doc_id < 100) for r in rows if r.doc_id is not None and r.doc_id < 200)
    assert ql.classify(df.limit(0), model).count() == 0
    none = ql.train(df, rated.limit(0))
    assert none is None and all(r.keep_ and r.expected_grade is None for r in ql.classify(df, none).collect())


def test_query_covers_all_rows(spark):
    out = ql.op9_quality(spark, SF)
    assert out.columns == ["doc_id", "expected_grade", "p_grade_1", "p_grade_2", "keep"]
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
