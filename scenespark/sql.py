"""SQL over the adapters: temporary views, so that every query can be written as text too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenespark.plans import adapters as ad

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Views of the tables, and of what the adapters make of them: scene, share_of, purchases, cells, grid."""
    views = {t: ad.table(spark, sf_dir, t) for t in TABLES}
    views |= {"scene": ad.scenes(spark, sf_dir), "share_of": ad.shares(spark, sf_dir), "purchases": ad.daily(spark, sf_dir), "cells": ad.bands(spark, sf_dir), "grid": ad.grid(spark, sf_dir)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register_views(spark, sf_dir)
    return spark.sql(text)
