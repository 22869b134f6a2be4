"""What the operators share: the shared folder, word rules, and grouped streams of sorted partitions."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that the contracts strip: space and the ASCII controls tab to carriage return.
WS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the scanning operators: no ASCII but digits and small letters, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() is faster but changes other alphabets, so it takes the
    texts that have none."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(low: Column) -> Column:
    """The words (see WORD) of a text in which A-Z are lower-cased. Splitting at what parts them is some
    twenty times as fast as extracting them."""
    return F.array_remove(F.split(low, BREAK, -1), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is read from spark.checkpoint.dir; where that is
    unset a temporary folder is set for the session in local mode; on a cluster, whose machines share none, that
    is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        where = sc.getCheckpointDir()
        if where is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="scenespark-")
            sc.setCheckpointDir(where)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


#: Spark's setting by which a query's shuffle files go when it ends, not whenever the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files; the session's setting is restored."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, a lost executor costs no
    recomputation, and what was shuffled for it is dropped. Every call writes a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: 64-bit words of a bit filter: 512 kB unless sized by its keys, and 8 MB at most.
FILTER_WORDS, MOST_WORDS = 1 << 16, 1 << 20


def filter_words(keys: DataFrame) -> int:
    """Size of a filter for so many keys: eight slots a key as long as that is at most MOST_WORDS. A filter that
    is full beyond that lets rows through that could have stayed: most rows are concerned then."""
    return min(MOST_WORDS, max(1024, 1 << (keys.count() // 8).bit_length()))


def bit_filter(keys: DataFrame, key: str, name: str, words: int = FILTER_WORDS) -> DataFrame:
    """One row with one array of longs (column `name`): a bit is set for the slot of every key (a long). Its size is
    bounded, so it can be broadcast; with more keys than slots it merely lets more rows through."""
    slot = F.pmod(F.col(key), F.lit(words * 64))
    some = keys.select(F.shiftright(slot, 6).alias("w__"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("b__")).groupBy("w__").agg(F.bit_or("b__").alias("b__"))
    every = keys.sparkSession.range(words).join(some, F.col("id") == F.col("w__"), "left").select("id", F.coalesce("b__", F.lit(0).cast("long")).alias("b__"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b__"))), lambda x: x["b__"]).alias(name))


def may_hold(key: Column, name: str, words: int = FILTER_WORDS) -> Column:
    """Whether the filter could hold a key: never false for one that it does."""
    slot = F.pmod(key, F.lit(words * 64))
    return F.getbit(F.get(name, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df doesn't have yet (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want += "_"
    return want


#: Rows that a function under `lean` gets at once.
PIECE = 512


def _give_back() -> None:
    """What this process has freed goes back to the system. The second step is glibc's; elsewhere it is left out."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow with less memory: it gets its rows, all and in their order, in batches of at most
    PIECE, and frees go back to the system when a partition ends. Spark keeps idle Python workers beside the
    JVM's next stages, and they would hold the most that any stage took."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                yield b.slice(at, PIECE)

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(pieces(batches))
        finally:
            _give_back()

    return leaner


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Streams (key, rows) pieces of a partition sorted by key. A long run comes in several pieces, so
    memory is bounded by a batch, not by a key's rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        ends = pa.compute.run_end_encode(keys)
        start = 0
        for end, value in zip(ends.run_ends.to_pylist(), ends.values.to_pylist()):
            yield value, batch.slice(start, end - start)
            start = end
