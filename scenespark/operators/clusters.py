"""Clusters, neighbours and splits of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kmeans_by_brightness(df: DataFrame, bands: Sequence[str], k: int = 3, seed: int = 42, rounds: int = 20) -> DataFrame:
    """df with cluster: k-means on the bands, clusters numbered by their centre's mean, darkest 0. Rows with
    a NULL band have a NULL cluster."""
    ok = df.where(F.forall(F.array(*bands), lambda b: b.isNotNull()))
    vec = ok.withColumn("v__", array_to_vector(F.array(*(F.col(b).cast("double") for b in bands))))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="v__", predictionCol="c__").fit(vec)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: model.clusterCenters()[i].mean())
    named = model.transform(vec).withColumn("cluster", F.get(F.array(*(F.lit(order.index(i)) for i in range(len(order)))), F.col("c__"))).drop("v__", "c__")
    rest = df.where(~F.forall(F.array(*bands), lambda b: b.isNotNull())).withColumn("cluster", F.lit(None).cast("int"))
    return named.unionByName(rest)


def knn_labels(queries: DataFrame, labelled: DataFrame, features: Sequence[str], query_id: str, label_id: str, label: str, k: int = 5, block: int = 2048, most_broadcast: int = 64_000) -> DataFrame:
    """query_id, label: the most frequent label of the k nearest labelled rows (ties: by distance, then id;
    of equally frequent labels the smallest). Labelled rows are compared in blocks of some `block` rows, whose k
    nearest are merged; blocks are broadcast if they hold at most most_broadcast rows in all."""
    n = labelled.count()
    blocks = max(1, -(-n // block))
    small = labelled.select(F.col(label_id).alias("l__"), F.col(label).alias("y__"), *(F.col(f).alias(f"{f}__l") for f in features))
    palette = small.groupBy(F.pmod(F.xxhash64("l__"), F.lit(blocks)).alias("block__")).agg(F.collect_list(F.struct(*small.columns)).alias("all__"))
    palette = F.broadcast(palette) if n <= most_broadcast else palette
    d = lambda x: sum(((F.col(f) - x[f"{f}__l"]) * (F.col(f) - x[f"{f}__l"]) for f in features), F.lit(0.0))
    near = F.slice(F.array_sort(F.transform("all__", lambda x: F.struct(d(x).alias("d"), x["l__"].alias("i"), x["y__"].alias("y")))), 1, k)
    got = queries.crossJoin(palette).select(F.col(query_id), F.explode(near).alias("x"))
    if blocks > 1:
        first = Window.partitionBy(query_id).orderBy("x")
        got = got.withColumn("nth__", F.row_number().over(first)).where(F.col("nth__") <= k)
    votes = got.groupBy(query_id, F.col("x.y").alias(label)).agg(F.count("*").alias("n"))
    return votes.groupBy(query_id).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def shuffle_split(df: DataFrame, key: Sequence[str], shares: dict[str, float], seed: int = 42, out: str = "split") -> DataFrame:
    """Rows dealt to named parts by a hash of their key: stable, independent of row order, no shuffle."""
    h = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) / 1_000_000.0
    case, upto = F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())):
        case = F.when(h < upto, F.lit(name)).otherwise(case)
        upto -= share
    return df.withColumn(out, case)


def mode(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value, the smallest of equally frequent ones."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def instruments_by_day(df: DataFrame, day: str, instrument: str) -> DataFrame:
    return df.groupBy(day).agg(F.array_sort(F.collect_set(instrument)).alias("instruments"))


def reach(df: DataFrame, instrument: str, day: str) -> DataFrame:
    return df.groupBy(instrument).agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def crosstab(df: DataFrame, rows: Sequence[str], column: Column | str, values: Sequence, how: Column) -> DataFrame:
    """Pivot over known values, so no pass is spent on finding them."""
    pivoted = df.withColumn("pivot__", column if isinstance(column, Column) else F.col(column))
    return pivoted.groupBy(*rows).pivot("pivot__", list(values)).agg(how)
