"""Line dedup across documents (1): keep bitmaps from a range-partitioned stream of line hashes.

Every counting line sends 128 bits of hash, its document and its position, never its text. The rows are
range-partitioned by (hash, document) and sorted within partitions by position too, so a line that a third
of all documents hold is spread over many partitions. A partition streams its rows and knows the first
holder of every hash but the one it may share with partitions before it; a row for each partition tells the
driver which hash that is and who held it first. The dropped positions come back as one compressed bitmap a
document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.llm.common import WS, ascii_lower, bit_filter, filter_words, free_name, lean, may_hold, table, written

#: Rows without doc_id stand for one document that comes after all others.
LAST = 2**63 - 1


def line_hashes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """One row for each line whose key has min_chars code points: h1, h2, doc, body (hash of the whole
    text, which tells rows of one doc_id apart), pos."""
    lines = df.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(F.col(text)).alias("body"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    keyed = lines.select("doc", "body", "pos", ascii_lower(F.btrim("line", F.lit(WS))).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "body", "pos")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: its first and last hash, and the last one's first holder here."""
    first = last = holder = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc = (b.column(i).to_numpy() for i in range(3))
        if first is None:
            first = (h1[0], h2[0])
        new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        if len(new):
            last, holder = (h1[-1], h2[-1]), doc[new[-1]]
        elif last != (h1[-1], h2[-1]):
            last, holder = (h1[-1], h2[-1]), doc[0]
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), **{k: pa.array([v], pa.int64()) for k, v in zip(("f1", "f2", "l1", "l2", "holder"), (*first, *last, holder))}})


def _carried(rows: list) -> dict[int, tuple[int, int, int]]:
    """For partitions that begin with a hash of an earlier one: that hash and its first holder."""
    out: dict[int, tuple[int, int, int]] = {}
    before = None
    for r in sorted(rows, key=lambda r: r.part):
        if before and before[:2] == (r.f1, r.f2):
            out[r.part] = before
        if (r.l1, r.l2) != (r.f1, r.f2) or r.part not in out:
            before = (r.l1, r.l2, r.holder)
    return out


def dropped_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """doc, body, pos of every line that is held first by a document with a smaller doc_id."""
    by = ["h1", "h2", "doc"]
    hashed = written(line_hashes(df, doc_id, text, min_chars), "lines")  # else finding the ranges reads all texts once more
    rows = hashed.repartitionByRange(*by).sortWithinPartitions(*by, "body", "pos").checkpoint(eager=True)
    carried = _carried(rows.mapInArrow(_ends, "part int, f1 long, f2 long, l1 long, l2 long, holder long").collect())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = carried.get(TaskContext.get().partitionId())
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h1, h2, doc = (b.column(i).to_numpy() for i in range(3))
            same = np.zeros(n, bool)
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            same[0] = h is not None and (h1[0], h2[0]) == h[:2]
            start = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
            holder = np.where(start < 0, h[2] if h else 0, doc[np.maximum(start, 0)])
            h = (h1[-1], h2[-1], holder[-1])
            drop = pa.array(doc != holder)
            yield b.select(["doc", "body", "pos"]).filter(drop)

    return rows.mapInArrow(stream, "doc long, body long, pos int")


def keep_bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """doc, body, n_dropped, keep for every document that loses lines. keep is zlib of packed bits, one a
    line up to the byte of the last dropped one (1: stays); lines beyond stay."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, maps = [], []
            for x in b.column(2):
                pos = np.unique(np.asarray(x.values))
                bits = np.ones((int(pos[-1]) // 8 + 1) * 8, np.uint8)
                bits[pos] = 0
                n.append(len(pos))
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "body", "n_dropped", "keep"])

    gone = dropped_lines(df, doc_id, text, min_chars).groupBy("doc", "body").agg(F.collect_list("pos").alias("pos"))
    return gone.mapInArrow(lean(pack), "doc long, body long, n_dropped long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines; lines before and dropped."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    gone = np.flatnonzero(bits[: len(lines)] == 0)
    drop = set(gone.tolist())
    return "\n".join([x for i, x in enumerate(lines) if i not in drop]), len(lines), len(drop)


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """df with its text reduced to the lines that stay, and n_lines (before), n_dropped, kept_sha256.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
    min_chars code points that two or more doc_ids hold stay only in the smallest of them, there with all
    repeats. Null or empty text: one empty line, which stays, and "". Rows of one doc_id are one document.
    Rows without doc_id are one document that comes last. Other columns stay; a clashing one makes the new
    name end in an underscore. An empty table gives an empty one.
    """
    new = [free_name(df, c) for c in ("n_lines", "n_dropped", "kept_sha256")]
    doc, body, keep = (free_name(df, c) for c in ("doc__", "body__", "keep__"))
    maps = written(keep_bitmaps(df, doc_id, text, min_chars), "bitmaps").select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("keep").alias(keep))
    keyed = df.withColumns({doc: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), body: F.xxhash64(F.col(text))})
    bits = free_name(df, "bits")
    could, hashed = F.broadcast(bit_filter(maps.select(body), body, bits, size := filter_words(maps))), may_hold(F.col(body), bits, size)
    # texts that lose no line are passed on where they are
    rest = keyed.join(could, hashed, "left_anti").withColumn(keep, F.lit(None).cast("binary"))
    joined = keyed.join(could, hashed, "left_semi").join(maps.hint("shuffle_hash"), [doc, body], "left").select(*df.columns, keep).unionByName(rest.select(*df.columns, keep))
    at, k = df.columns.index(text), len(df.columns)
    kinds = [T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([T.StructField(f.name, T.StringType()) if i == at else f for i, f in enumerate(df.schema.fields)] + [T.StructField(n, t) for n, t in zip(new, kinds)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, dropped, sha = [], [], [], []
            for t, m in zip(b.column(at), b.column(k)):
                kept, n, d = kept_lines(t.as_py() or "", m.as_py())
                texts.append(kept)
                lines.append(n)
                dropped.append(d)
                sha.append(hashlib.sha256(kept.encode()).hexdigest())
            cols = [*b.columns[:k], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(lean(apply), schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP1_SQL = r"""
WITH lists AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM lists),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
shared AS (SELECT line_key, min(doc_id) AS holder FROM k WHERE length(line_key) >= 10
        GROUP BY line_key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(s.holder <> k.doc_id, FALSE) AS gone
        FROM k LEFT JOIN shared s ON k.line_key = s.line_key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
