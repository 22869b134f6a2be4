"""SimHash near-dedup (10): 64-bit fingerprints linked within a radius by BK-trees over shards.

Texts with one fingerprint are one node. Two fingerprints within 2 bits are equal in at least two of four
16-bit blocks, so a shard holds the fingerprints that share two blocks: six shards for each, and no link is
lost. A shard builds a BK-tree, whose children are keyed by their distance to the parent, and each of its
fingerprints follows only the edges within the radius. A shard above `tree_rows` is dealt over several trees,
in separate tasks, and all of its fingerprints probe each of them. A tree returns its links as stars, never
as pairs: at most one link a fingerprint.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenespark.llm.common import bit_filter, filter_words, free_name, may_hold, table, written
from scenespark.llm.components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Which byte value sets which bits.
BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LANE = (np.arange(8, dtype=np.int64) * 256)[None, :]
#: Shingles hashed at once.
CHUNK = 1 << 18


def shingle_hashes(text: str | None, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of `size` words, repeats included, CHUNK at a time; fewer words are one shingle, none
    give none. bytes.lower() folds A-Z only and bytes.split() parts at space and tab to carriage return."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    size, digest = min(size, len(words)), xxhash.xxh64_intdigest
    for a in range(0, len(words) - size + 1, CHUNK):
        part = words[a : a + CHUNK + size - 1]
        joined = b" ".join(part)
        lens = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.concatenate([[0], np.cumsum(lens[:-1] + 1)])
        ends = (starts + lens)[size - 1 :].tolist()
        yield np.asarray([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends)], np.uint64)


def fingerprint_of(parts: list[np.ndarray]) -> int:
    """A bit is set if it is set in over half of the hashes; 0 without any."""
    return _bits(sum(map(_lanes, parts)), sum(map(len, parts))) if parts else 0


def fingerprint(text: str | None) -> int:
    """Of the 3-word shingles."""
    return fingerprint_of(list(shingle_hashes(text)))


def _lanes(h: np.ndarray) -> np.ndarray:
    return np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + LANE).ravel(), minlength=2048)


def _bits(total: np.ndarray, n: int) -> int:
    counts = (total.reshape(8, 256) @ BIT).ravel()
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, body): the fingerprint as a signed long, and a hash of the text. Null text: like empty text, 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "body"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("body")).mapInArrow(run, "doc_id long, fp long, body long")


class BKTree:
    """Nodes are indexes into a list of fingerprints; child[i] maps a distance to a node."""

    def __init__(self):
        self.fps: list[int] = []
        self.child: list[dict[int, int]] = []

    def near(self, q: int, radius: int = RADIUS) -> list[int]:
        found, todo, fps, child = [], [0] if self.fps else [], self.fps, self.child
        while todo:
            i = todo.pop()
            d = (fps[i] ^ q).bit_count()
            if d <= radius:
                found.append(i)
            kids = child[i]
            if len(kids) <= 2 * radius + 1:
                todo += [j for e, j in kids.items() if -radius <= e - d <= radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found

    def add(self, q: int) -> int:
        n = len(self.fps)
        self.fps.append(q)
        self.child.append({})
        i = 0
        while n:
            d = (self.fps[i] ^ q).bit_count()
            j = self.child[i].setdefault(d, n)
            if j == n:
                break
            i = j
        return n


class Links:
    """Stars over a tree's fingerprints."""

    def __init__(self):
        self.tree, self.up = BKTree(), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, found: list[int]) -> None:
        roots = {self.root(i) for i in found}
        least = min(roots)
        for r in roots:
            self.up[r] = least

    def member(self, q: int) -> None:
        found = self.tree.near(q)
        self.up.append(self.tree.add(q))
        if found:
            self.join([*found, len(self.up) - 1])

    def probe(self, q: int) -> int | None:
        """A fingerprint of another tree; one that it links to here."""
        found = self.tree.near(q)
        if not found:
            return None
        self.join(found)
        return self.tree.fps[found[0]]

    def stars(self) -> Iterator[tuple[int, int]]:
        for i, q in enumerate(self.tree.fps):
            if (r := self.root(i)) != i:
                yield q, self.tree.fps[r]


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, tree, probes, fp), sorted, members of a tree before those that only probe it."""
    key, links, out = None, None, []

    def batch() -> pa.RecordBatch:
        a = np.asarray(out, np.uint64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    for b in batches:
        shard, tree = b.column(0).to_numpy(), b.column(1).to_numpy()
        probes, fps = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(tree) != 0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            now = (int(shard[s]), int(tree[s]))
            if now != key:
                if links:
                    out += links.stars()
                key, links = now, None
            if links is None:
                if e - s == 1 and e != b.num_rows:
                    continue  # a shard of one
                links = Links()
            for q, only in zip(fps[s:e].tolist(), probes[s:e].tolist()):
                if not only:
                    links.member(q)
                elif (near := links.probe(q)) is not None:
                    out.append((q, near))
        if len(out) > 100_000:
            yield batch()
    if links:
        out += links.stars()
    yield batch()


def near_links(fps: DataFrame, tree_rows: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) of at most RADIUS differing bits: enough of
    them to connect every such pair."""
    block = [F.shiftright("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [F.lit(k).cast("long") * 2**32 + block[i] * 65536 + block[j] for k, (i, j) in enumerate(itertools.combinations(range(4), 2))]
    rows = fps.select("fp", F.explode(F.array(*pairs)).alias("shard"))
    large = rows.groupBy("shard").count().where(F.col("count") > tree_rows).select("shard", F.ceil(F.col("count") / tree_rows).cast("int").alias("trees"))
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    dealt = (
        rows.join(large, "shard", "left")
        .withColumn("trees", F.coalesce("trees", F.lit(1)))
        .select("shard", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), own.alias("own"), "fp")
        .select("shard", "tree", (F.col("tree") != F.col("own")).alias("probes"), "fp")
    )
    return dealt.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "probes").mapInArrow(_shard_links, "a long, b long")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tree_rows: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id, body, root) for every row of df: component_id is the smallest doc_id that is
    reached over links of at most 2 differing bits, its own included; body is a hash of the text, root tells
    components of one component_id, or of none, apart.

    Empty, blank and null texts have fingerprint 0 and link like any other. Texts of one or two words are one
    shingle. Rows repeated or with one fingerprint share a component. A null doc_id stays null and takes no
    part in the minimum; a component of none but such rows has a null component_id. An empty table gives an
    empty one; other columns don't matter.
    """
    marks = written(fingerprints(df, doc_id, text), "simhash")
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select("fp"), tree_rows))
    linked = nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(names, "root").select("fp", "root", "component_id")
    alone = nodes.join(roots, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return marks.join(of_fp.unionByName(alone), "fp").select("doc_id", "fp", "component_id", "body", "root")


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", grouped: Callable[..., DataFrame] = near_groups) -> DataFrame:
    """One row of each group: that of its smallest doc_id and, of rows with this id, of the least hash of the
    text; one of repeated rows. A row without doc_id stays only where no row of its group has one. grouped: what
    makes the groups, near_groups or jaccard.similar_groups."""
    groups = written(grouped(df, doc_id, text).select("doc_id", "body", "root"), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("k")
    found = written(groups.groupBy("root").agg(F.count("*").alias("n"), least), "firsts")
    key, body, nth = F.col(doc_id).cast("long"), F.xxhash64(F.col(text)), free_name(df, "nth__")
    own, own_body, bits = free_name(df, "keep__"), free_name(df, "body__"), free_name(df, "bits")
    several = groups.join(found.where("n > 1").select("root"), "root", "left_semi").select(F.xxhash64("doc_id", "body").alias("h"))
    could, hashed = F.broadcast(bit_filter(several, "h", bits, size := filter_words(several))), may_hold(F.xxhash64(key, body), bits, size)
    # rows that are alone in their group are passed on where they are
    keep = found.select(F.col("k.doc_id").alias(own), F.col("k.body").alias(own_body)).hint("shuffle_hash")
    kept = df.join(could, hashed, "left_semi").join(keep, key.eqNullSafe(F.col(own)) & (body == F.col(own_body)), "left_semi")
    first = Window.partitionBy(key, body).orderBy(body)
    once = kept.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return df.join(could, hashed, "left_anti").unionByName(once)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
