"""Exact top-k search over binary codes (5) by incremental multi-index hashing.

A code is cut into 16-bit segments, each with an index from value to rows. Two codes at Hamming distance d
have, among m segments, one that differs in at most d // m bits. So a query looks up the values within radius
0, 1, 2 … of its own segments, one segment after another, and verifies what it finds by the full distance.
Once segments 0 … j were searched to radius r and the others to r - 1, every code within m * r + j is found;
when the k-th verified distance is within that, the answer is proven and the query stops.

Rows are dealt into shards by a hash of id and code, whatever their values, so no code or bucket is hot: of
rows with one code, a shard keeps the k smallest ids, as none of the others can be among the k nearest.
Queries are sent to every shard in blocks and their k best of each shard are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenespark.llm.common import table

BITS = 16
#: Values of a segment by their number of set bits.
MASKS = [np.flatnonzero(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)) == r).astype(np.uint16) for r in range(BITS + 1)]
#: Bucket look-ups made at once.
AT_ONCE = 1 << 20


def sign_codes(df: DataFrame, dims: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, code): bit i of the code says that element i is above 0 (NaN and null are not). Rows without
    an id or without exactly `dims` elements have no code and are left out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(1)
            n = pa.compute.fill_null(pa.compute.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
            ok = (n == dims) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(ok))
            flat = pa.compute.fill_null(pa.compute.list_flatten(b.column(1)), 0.0).to_numpy(zero_copy_only=False)
            bits = np.packbits(flat.reshape(-1, dims) > 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in bits], pa.binary())], names=["vec_id", "code"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(encode, "vec_id long, code binary")


class Shard:
    """The index of some rows."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int):
        """codes: uint8, a row each."""
        wide = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
        wide[:, : codes.shape[1]] = codes
        words = wide.view("<u8")
        order = np.lexsort((ids, *words.T[::-1]))
        new = np.ones(len(order), bool)
        new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[rank < k]
        self.k, self.ids, self.words = k, ids[order], words[order]
        self.m = -(-8 * codes.shape[1] // BITS)
        segments = wide[order].view("<u2")[:, : self.m]
        self.rows = [np.argsort(s, kind="stable") for s in segments.T]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << BITS))]) for s in segments.T]

    def _best(self, q: np.ndarray, row: np.ndarray, dist: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query, and the k-th distance (a large number where there are fewer)."""
        both = np.unique(q * len(self.ids) + row, return_index=True)[1]
        q, row, dist = q[both], row[both], dist[both]
        order = np.lexsort((self.ids[row], dist, q))
        q, row, dist = q[order], row[order], dist[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        q, row, dist, rank = q[keep], row[keep], dist[keep], rank[keep]
        kth = np.full(size, 1 << 30)
        at = rank == min(self.k, len(self.ids)) - 1
        kth[q[at]] = dist[at]
        return q, row, dist, kth

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """query, row and distance of the k best of each query; and how many rows were verified."""
        n = len(codes)
        wide = np.zeros((n, self.words.shape[1] * 8), np.uint8)
        wide[:, : codes.shape[1]] = codes
        words, segments = wide.view("<u8"), wide.view("<u2")
        none = np.zeros(0, np.int64)
        best, active, seen = (none, none, none), np.arange(n), 0
        if not len(self.ids):
            return *best, 0
        for r, masks in enumerate(MASKS):
            for j in range(self.m):
                found = [best]
                step = max(1, AT_ONCE // len(masks))
                for a in range(0, len(active), step):
                    q = active[a : a + step]
                    value = (segments[q, j][:, None] ^ masks[None, :]).astype(np.int64)
                    lo = self.starts[j][value].ravel()
                    size = self.starts[j][value + 1].ravel() - lo
                    full = np.flatnonzero(size)
                    lo, size = lo[full], size[full]
                    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    row = self.rows[j][np.repeat(lo, size) + place]
                    qi = np.repeat(q[full // len(masks)], size)
                    dist = np.bitwise_count(words[qi] ^ self.words[row]).sum(axis=1, dtype=np.int64)
                    seen += len(row)
                    found.append((qi, row, dist))
                q, row, dist, kth = self._best(*(np.concatenate(x) for x in zip(*found)), n)
                best = (q, row, dist)
                active = active[kth[active] > self.m * r + j]
                if not len(active):
                    return *best, seen
        return *best, seen


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 16_384, block: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the k nearest codes of every query by (distance, vec_id).

    Both frames have (vec_id long, code binary), codes of one length. Rows repeated with one id and code
    count once, on either side; a query finds itself if it is among the codes. Of one id with several codes,
    each is a candidate, and a query, of its own. Fewer than k codes: all of them. Rows with a null are left
    out. An empty side gives an empty result.
    """
    codes, queries = (x.select("vec_id", "code").dropna().distinct() for x in (codes, queries))
    shards = max(1, -(-codes.count() // shard_rows))
    rows = codes.select(F.pmod(F.xxhash64("vec_id", "code"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "code")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "code")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds shards one after another, each with its rows before its queries."""
        at, held, index = None, [], None

        def as_codes(c: pa.Array) -> np.ndarray:
            return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1)

        for b in batches:
            key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                part, shard = b.slice(s, e - s), int(key[s]) // 2
                if shard != at:
                    at, held, index = shard, [], None
                if not key[s] % 2:
                    held.append((part.column(2).to_numpy(), as_codes(part.column(3))))
                    continue
                if index is None and held:
                    index, held = Shard(np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held]), k), []
                for i in range(0, part.num_rows if index else 0, block):
                    some = part.slice(i, block)
                    q, row, dist, _ = index.search(as_codes(some.column(3)))
                    yield pa.RecordBatch.from_arrays(
                        [some.column(2).take(pa.array(q)), some.column(3).take(pa.array(q)), pa.array(index.ids[row]), pa.array(dist, pa.int32()), pa.array([w.tobytes() for w in index.words[row]], pa.binary())],
                        names=["query_id", "query_code", "vec_id", "distance", "code"],
                    )

    dealt = rows.unionByName(asks).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(search, "query_id long, query_code binary, vec_id long, distance int, code binary")
    w = Window.partitionBy("query_id", "query_code").orderBy("distance", "vec_id", "code")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "distance")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all 64-bit sign codes for every vector whose id is divisible by 50."""
    codes = sign_codes(table(spark, sf_dir, "embeddings"), 64)
    return top_k(codes, codes.where(F.col("vec_id") % 50 == 0))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0 AND NOT isnan(x), FALSE)) AS bits FROM embeddings WHERE len(embedding) = 64),
d AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(q.bits[i] <> v.bits[i] AS INT))) AS INT) AS distance
  FROM v q JOIN v ON q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
