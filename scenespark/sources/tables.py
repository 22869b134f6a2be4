"""Summary tables, caches, logs and JSON: typed reads and repeatable writes."""

from __future__ import annotations

import json
import platform
import subprocess
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark import presets as P

_LONG, _DOUBLE, _STRING, _INT = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()
#: Columns of a scene summary, in their fixed order.
SUMMARY = T.StructType(
    [T.StructField("tile_id", _STRING), T.StructField("timestamp", _STRING)]
    + [T.StructField(c, _LONG) for c in (*P.COUNTS, "unknown_px")]
    + [T.StructField(c, _DOUBLE) for c in P.SHARES]
    + [T.StructField("clear_px", _LONG), T.StructField("clear_pct", _DOUBLE), T.StructField("classified_px", _LONG), T.StructField("usable", _INT)]
    + [T.StructField(c, _DOUBLE) for c in ("solid_pct_clear", "light_pct_clear", "water_pct_clear", "mean_ndsi_solid", "mean_ndsi_light", "mean_ndwi_water", "eo_cloud_cover", "sun_elev", "sun_azim")]
    + [T.StructField("edge_gap", _INT)]
)
LATER = ("clear_px", "clear_pct", "classified_px", "usable", "solid_pct_clear", "light_pct_clear", "water_pct_clear")
LEGACY = T.StructType([f for f in SUMMARY.fields if f.name not in LATER])


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column of the header as text, uncast; absent and empty fields are empty text."""
    return spark.read.csv(path, header=True, inferSchema=False).na.fill("")


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns by name, cast where they can be; what can't be read is NULL, and so are NaN, blanks and
    missing columns. Extra columns stay strings."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    kinds = {f.name: f.dataType for f in schema.fields}
    out = []
    for name, kind in kinds.items():
        if name not in raw.columns:
            out.append(F.lit(None).cast(kind).alias(name))
        elif isinstance(kind, T.StringType):
            out.append(F.nullif(F.col(name), F.lit("")).alias(name))
        else:
            d = F.trim(name).try_cast("double")
            ok = F.when(~F.isnan(d), d)
            out.append((ok if isinstance(kind, T.DoubleType) else ok.try_cast(kind)).alias(name))
    return raw.select(*out, *(c for c in raw.columns if c not in kinds))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A scene summary of either version with the columns of the current one, and day, season, doy, tile, ice
    (share of the grid) added."""
    from scenespark.operators.scenes import tile_of_id

    at = F.try_to_timestamp("timestamp", F.lit("yyyyMMdd'T'HHmmss"))
    df = read_typed_csv(spark, path, SUMMARY).withColumn("time", at)
    return df.withColumns({"day": F.to_date("time"), "season": F.year("time"), "doy": F.dayofyear("time"), "tile": tile_of_id(F.col("tile_id")), "ice": F.col("solid_pct") + F.col("light_pct")})


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def ends_with_newline(spark: SparkSession, path: str) -> DataFrame:
    """path and intact: whether a file's last byte ends a line."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", ((F.col("length") == 0) | (F.substring("content", -1, 1) == F.lit(b"\n"))).alias("intact"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and the day in the file name; the content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.withColumn("day", F.try_to_date(F.regexp_extract("path", r"(\d{8})(?!.*\d{8})", 1), "yyyyMMdd"))


def log_progress(spark: SparkSession, path: str, tail: int = 200_000) -> DataFrame:
    """path, done, total, rejected: the last progress mark (done/total) in the tail of each log, and how many
    rejections it names."""
    files = spark.read.format("binaryFile").load(path)
    text = files.select("path", F.decode(F.substring("content", -tail, tail), "UTF-8").alias("t"))
    marks = F.regexp_extract_all("t", F.lit(r"(\d+/\d+)"), F.lit(1))
    last = F.split(F.get(marks, F.size(marks) - 1), "/")
    return text.select("path", F.get(last, 0).try_cast("int").alias("done"), F.get(last, 1).try_cast("int").alias("total"), F.size(F.regexp_extract_all("t", F.lit("(?i)(reject)"), F.lit(1))).alias("rejected"))


# --- sinks -----------------------------------------------------------------------------------------------


def append_new(df: DataFrame, path: str, key: Sequence[str], schema: T.StructType | None = None) -> int:
    """Appends the rows whose key the table lacks, one a key (the first by all columns); returns how many.
    Columns that differ from the table's are an error. Running it again appends nothing."""
    spark = df.sparkSession
    want = schema or df.schema
    if [f.name for f in want] != df.columns:
        raise ValueError(f"columns {df.columns}; {[f.name for f in want]} are expected")
    w = Window.partitionBy(*key).orderBy(*df.columns)
    new = df.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")
    if _exists(spark, path):
        old = spark.read.parquet(path)
        if old.columns != df.columns:
            raise ValueError(f"the table has columns {old.columns}")
        new = new.join(old.select(*key), list(key), "left_anti").select(*df.columns)
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upsert(df: DataFrame, path: str, key: Sequence[str], into: str) -> None:
    """The table at `path` with rows of df in place of those with the same key, written to `into`."""
    old = df.sparkSession.read.parquet(path).join(df.select(*key), list(key), "left_anti")
    old.select(*df.columns).unionByName(df).write.mode("errorifexists").parquet(into)


def merge_seasons(parts: Sequence[DataFrame], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Seasons of one header as one table, a row a key, sorted. Headers that differ are an error."""
    first = parts[0]
    if any(p.columns != first.columns for p in parts):
        raise ValueError("headers differ")
    out = first
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy(*key).orderBy(*first.columns)
    return out.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__").orderBy(*order)


def export_csv(df: DataFrame, path: str) -> None:
    """One file with a header; NULL is blank. For small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def cells_and_meta(cells: DataFrame, meta: DataFrame, path: str, key: str) -> None:
    """Rasters as Parquet by scene, and one JSON line of metadata a scene."""
    cells.write.mode("overwrite").partitionBy(key).parquet(f"{path}/cells")
    meta.select(F.to_json(F.struct(*meta.columns)).alias("value")).write.mode("overwrite").text(f"{path}/meta")


def reconcile(collected: DataFrame, expected: DataFrame, key: str, count: str, palette: str) -> DataFrame:
    """key, status of collected rasters against the counts expected; palettes must be one."""
    both = collected.select(key, F.col(count).alias("got"), palette).join(expected.select(key, F.col(count).alias("want")), key, "full_outer")
    status = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("got") != F.col("want"), "count differs").otherwise("ok")
    palettes = collected.agg(F.count_distinct(F.to_json(palette) if isinstance(collected.schema[palette].dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(palette)).alias("palettes"))
    return both.select(key, status.alias("status")).crossJoin(palettes)


def manifest(config: dict, stats: dict) -> str:
    """JSON of a run: settings, results, environment, revision."""
    try:
        rev = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        rev = None
    return json.dumps({"config": config, "stats": stats, "environment": {"python": platform.python_version(), "system": platform.system()}, "git": rev, "created": datetime.now(timezone.utc).isoformat()}, default=str, sort_keys=True)


def nested_days(days: DataFrame, day: str) -> DataFrame:
    """One JSON text a day; absent instruments are left out."""
    return days.select(day, F.to_json(F.struct(*days.columns)).alias("json"))


def usable_flag(c: Column) -> Column:
    """1, true and yes in any case."""
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "1.0")
