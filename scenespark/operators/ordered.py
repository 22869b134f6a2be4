"""Order statistics and running sums over tables of any size: no task holds a whole group.

Rows are range-partitioned by (group, order) and checkpointed in the shared folder, which fixes where each row
lies; a partition sums its own rows and starts where the partitions before it end. What is joined back is one
row a partition and group.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> str:
    """The shared folder: the context's or else spark.checkpoint.dir of the session, set for the context. Where both
    are unset it is a temporary folder in local mode and an error on a cluster, whose machines share none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="scenespark-"))
    return sc.getCheckpointDir()


def ranged(df: DataFrame, by: Sequence[str], part: str = "part__") -> DataFrame:
    """df sorted over all partitions by `by`, with the partition's number, which later plans can rely on."""
    checkpoints(df.sparkSession)
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id()).checkpoint(eager=True)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """df with the sum of `value` up to and with each row of its group, in a total order."""
    rows = ranged(df, [*by, *order])
    own = rows.withColumn("own__", F.sum(value).over(Window.partitionBy("part__", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy("part__", *by).agg(F.sum(value).alias("sum__"))
    before = sums.withColumn("before__", F.coalesce(F.sum("sum__").over(Window.partitionBy(*by).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum__")
    names = {c: f"{c}__b" for c in ("part__", *by)}
    b = before.select("before__", *(F.col(c).alias(n) for c, n in names.items()))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return own.join(b, cond).withColumn(out, F.col("own__") + F.col("before__")).drop("own__", "before__", "part__", *names.values())


def percentiles(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, p, value: exact percentiles with linear interpolation. Equal values are counted first; NULL and NaN
    don't count; a group without values has no rows."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("v__")).agg(F.count("*").alias("n__"))
    run = running_sum(counts, by, ["v__"], "n__", "upto__")
    total = run.groupBy(*by).agg(F.max("upto__").alias("all__"))
    if by:
        t = total.select("all__", *(F.col(c).alias(f"{c}__t") for c in by))
        cond = F.col(by[0]).eqNullSafe(F.col(f"{by[0]}__t"))
        for c in by[1:]:
            cond = cond & F.col(c).eqNullSafe(F.col(f"{c}__t"))
        both = run.join(t, cond)
    else:
        both = run.crossJoin(F.broadcast(total))  # one row
    place = lambda p: p * (F.col("all__") - 1)
    asked = F.transform(F.array(*map(F.lit, ps)), lambda p: F.struct(p.alias("p"), F.floor(place(p)).alias("lo"), F.ceil(place(p)).alias("hi"), place(p).alias("at")))
    here = lambda k: (k >= F.col("upto__") - F.col("n__")) & (k < F.col("upto__"))
    hit = both.select(*by, "v__", "upto__", "n__", F.explode(F.filter(asked, lambda x: here(x["lo"]) | here(x["hi"]))).alias("x"))
    got = hit.groupBy(*by, F.col("x.p").alias("p")).agg(
        F.max(F.when(here(F.col("x.lo")), F.col("v__"))).alias("a"), F.max(F.when(here(F.col("x.hi")), F.col("v__"))).alias("b"), F.max(F.col("x.at") - F.col("x.lo")).alias("w")
    )
    return got.select(*by, "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value"))
