"""Corpus preparation: documents that a quality model keeps, without lines that earlier documents hold, one
of each group of near copies, none that holds a benchmark item, packed into sequences for training."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import decontam, jaccard, lines, quality, simhash, tokens
from scenespark.llm.common import shared_dir, table

#: Columns that the stages pass on; further columns of documents are left out, and each of these must be there.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose most likely grade isn't toxic or poor stay. Null and empty texts are
    judged by their shape; repeated rows alike; without two grades among the labels every row stays."""
    model = quality.train(docs, quality.ratings(table(spark, sf_dir, "labels")))
    return quality.classify(docs.select(*COLUMNS), model).where("keep").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that a document with a smaller doc_id holds go; a document stays, if need be empty.
    n_chars is counted anew. Null text becomes empty text; rows of one doc_id are one document, rows without
    doc_id one that comes last."""
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: the document with the smallest doc_id of each group stays. BK-trees of SimHash fingerprints over
    shards of shared 5-word shingles propose links, and a similarity of 0.8 or more confirms them. Empty texts are
    one group; a row without doc_id stays only where its group has no document; of repeated rows one does."""
    return simhash.near_dedup(docs.select(*COLUMNS), grouped=jaccard.similar_groups)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of an item go whole; rows with one doc_id and
    text together. Empty texts stay, and so does everything where the benchmark is empty."""
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: sequences of at most 2048 tokens by power-of-two decomposition, with their ids. An empty or null
    text is one piece that holds the end; repeated rows are packed each on its own."""
    return tokens.pack(docs, tokens.vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: A trained model, fingerprints and tokens are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result but the last is a table in the shared folder that the next
    stage reads."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{i}-{name.replace(' ', '-')}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
