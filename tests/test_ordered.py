import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.operators import inference as st
from scenespark.operators import ordered as od
from scenespark.operators import thresholds as th


def rows(n=2000, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([round(rng.random(), 2), None, float("nan"), 0.5, 0.5]), i) for i in range(n)]


def test_percentiles_equal_numpy(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, i int").repartition(7)
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.value for r in od.percentiles(df, "v", ps, ["g"]).collect()}
    for g in ("a", "b", None):
        v = [x for k, x, _ in data if k == g and x is not None and x == x]
        for p in ps:
            assert got[g, p] == pytest.approx(np.percentile(v, 100 * p))
    whole = {r.p: r.value for r in od.percentiles(df, "v", ps).collect()}
    assert whole[0.9] == pytest.approx(np.percentile([x for _, x, _ in data if x is not None and x == x], 90))
    assert od.percentiles(df.limit(0), "v", ps).count() == 0
    assert od.percentiles(df.where("i = 0").withColumn("v", F.lit(3.0)), "v", ps).where("value <> 3").count() == 0


def test_running_sum_over_many_partitions(spark):
    data = [(("a" if i % 3 else "b"), i, i % 5) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, "g string, i int, v long").repartition(5)
        got = {(r.g, r.i): r.s for r in od.running_sum(df, ["g"], ["i"], "v", "s").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in "ab":
        total = 0
        for k, i, v in data:
            if k == g:
                total += v
                assert got[g, i] == total


def test_chunks_by_rank_equal_array_split(spark):
    v = random.Random(3).sample(range(10_000), 103)
    got = {r.chunk: (r.n, r.v) for r in th.rank_chunks(spark.createDataFrame([(float(x),) for x in v], "v double").repartition(9), ["v"], ["v"], 10).collect()}
    assert got == {i + 1: (len(c), float(np.median(c))) for i, c in enumerate(np.array_split(np.sort(v), 10))}


def test_average_ranks(spark):
    got = [r["rank"] for r in st.average_rank(spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, 3.0)], "v double"), "v").orderBy("v").collect()]
    assert got == [1.0, 2.0, 4.0, 4.0, 4.0]
