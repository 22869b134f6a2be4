"""Views of the given tables in the shape of scenes, cells and daily series; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.operators.contrasts import denominators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the SQL does."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scenes: quantity, discount and tax are cells of solid and light ice and of water."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("scene_id"), F.to_date("l_shipdate").alias("scene_day"), F.year("l_shipdate").alias("season"), F.dayofyear("l_shipdate").alias("doy"),
        F.col("l_quantity").alias("solid"), (F.col("l_discount") * 100).alias("light"), (F.col("l_tax") * 100).alias("water"), F.col("l_linenumber").alias("cloud"), F.col("l_returnflag").alias("flag"),
    )


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denominators(scenes(spark, sf_dir))


SCENES = """scene AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS scene_id, CAST(l_shipdate AS DATE) AS scene_day, CAST(year(l_shipdate) AS INT) AS season,
  CAST(dayofyear(l_shipdate) AS INT) AS doy, l_quantity AS solid, l_discount * 100 AS light, l_tax * 100 AS water, l_linenumber AS cloud, l_returnflag AS flag FROM lineitem),
share_of AS (SELECT *, (solid + light) / nullif(solid + light + water + cloud, 0) AS ice_grid, (solid + light) / nullif(solid + light + water, 0) AS ice_clear,
  (solid + light) / nullif(solid + light + water, 0) AS ice_classified, (solid + light + water) / nullif(solid + light + water + cloud, 0) AS share FROM scene)"""


def daily(spark: SparkSession, sf_dir: str, kind: str = "purchase") -> DataFrame:
    """user_id, day_no (of January), day, value: mean of a user's events of a kind, a row a day with any."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("user_id", F.to_date("ts").alias("day"), "value").groupBy("user_id", "day").agg(F.avg("value").alias("value")).withColumn("day_no", F.dayofmonth("day"))


def daily_sql(kind: str = "purchase", name: str = "series") -> str:
    return f"{name} AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS value, CAST(day(CAST(ts AS DATE)) AS INT) AS day_no FROM events WHERE event_type = '{kind}' GROUP BY 1, 2)"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as cells: the first 13 numbers are bands."""
    e = table(spark, sf_dir, "embeddings")
    b = F.transform(F.slice("embedding", 1, 13), lambda x: x.cast("double"))
    return e.select("vec_id", "label", b.alias("bands")).select("*", *(band(i).alias(n) for i, n in ((2, "green"), (7, "nir"), (11, "swir"))))


def band(i: int) -> Column:
    """Magnitude of a band as a reflectance."""
    return F.abs(F.get("bands", i)) * 2


BANDS = """cell AS (SELECT vec_id, label, list_transform(embedding[1:13], lambda x: CAST(x AS DOUBLE)) AS bands, abs(CAST(embedding[3] AS DOUBLE)) * 2 AS green,
  abs(CAST(embedding[8] AS DOUBLE)) * 2 AS nir, abs(CAST(embedding[12] AS DOUBLE)) * 2 AS swir FROM embeddings)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 rasters: vec_id, y, x, v."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return e.select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.col("v").cast("double").alias("v"))


GRID = """grid AS (SELECT vec_id, CAST((p - 1) // 8 AS INT) AS y, CAST((p - 1) % 8 AS INT) AS x, CAST(embedding[p] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings))"""
