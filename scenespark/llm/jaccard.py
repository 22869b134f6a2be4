"""SimHash near-dedup of word shingles (10), for texts whose sets of 5-word shingles have a Jaccard similarity of
0.8 or more: BK-trees over shards propose links, an exact comparison of the sets confirms them.

Fingerprints of such texts differ in some ten bits, and blocks of 64 bits can't be shards for that. A shard is
a shingle instead: two sets that similar share one of the first n - ceil(0.8 n) + 1 shingles of each in any one
order (prefix filter), so no pair is lost. The order puts shingles that a sample finds common last; what it
finds changes the work, not the result. Shards with the same members are one shard, known by their count and
the exclusive or of their members.

A large group of near copies costs comparisons in proportion to its texts: each shard first compares its
members with one hub, the member whose shingles are shared most, which is the text that the copies were made
of if it is there. Only shards whose members are not connected then get BK-trees over their members' SimHash
fingerprints, and those apart from the rest probe them and follow the edges within RADIUS bits. What a tree
finds is checked by an odd sketch (parities of the set's hashed members), whose differing bits are never more
than the members in which two sets differ: it rejects without error. The links that remain are proposed as a
forest, confirmed exactly, and in the shards whose forest had a false one proposed once more, all of them.

RADIUS is no exact bound. Similarity 0.8 makes 9.7 differing bits on average with a deviation of about 2.9;
28 is six deviations away, and the largest distance of any similar pair in the tables is in the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark.llm.common import bit_filter, filter_words, lean, may_hold, written
from scenespark.llm.components import components
from scenespark.llm.simhash import SEED, BKTree, fingerprint_of, shingle_hashes

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 28
#: Members of a shard that one tree holds.
TREE_ROWS = 1024


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the distinct shingles, sorted."""
    return _distinct(list(shingle_hashes(text, size)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def _signed(xs: list[int]) -> pa.Array:
    return pa.array(np.asarray(xs, np.uint64).view(np.int64))


def sketch(s: np.ndarray) -> np.ndarray:
    """Odd sketch of a set: four to eight bits a member (a power of two, 64 at least), each the parity of the
    members that fall on it, as 64-bit words. The exclusive or of two sketches is the sketch of what is in one
    set alone, so it has no more bits set than that has members."""
    bits = max(64, 1 << (4 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _folded(m: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row each) as if they had been made with fewer words."""
    return np.bitwise_xor.reduce(m.reshape(len(m), -1, words), axis=1)


def _sets(df: DataFrame, size: int) -> DataFrame:
    """node, tokens of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([_signed(list(map(_node, sets))), _lists(sets)], names=["node", "tokens"])

    return df.select("text").mapInArrow(lean(run), "node long, tokens array<long>")


def _common(df: DataFrame, size: int, one_in: int, least: int, most: int) -> np.ndarray:
    """Shingles in at least `least` of a sample of the texts, at most `most` of them, rarest first."""
    some = _sets(df.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0), size)
    found = some.select(F.explode("tokens").alias("h")).groupBy("h").count().where(F.col("count") >= least)
    return np.asarray([r[0] for r in found.orderBy(F.desc("count"), "h").limit(most).collect()][::-1], np.int64).view(np.uint64)


def _marks(df: DataFrame, size: int, similarity: float, common: np.ndarray) -> DataFrame:
    """doc_id, body, node, n, fp, sketch, prefix for every row of (doc_id, body, text)."""
    by_hash = np.argsort(common)
    known = common[by_hash]

    def prefix(s: np.ndarray) -> np.ndarray:
        k = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1 if len(s) else 0
        if not len(known):
            return s[:k]
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        late = known[at] == s
        return np.concatenate([s[~late], common[np.sort(by_hash[at[late]])]])[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashed = [list(shingle_hashes(t.as_py(), size)) for t in b.column(2)]
            sets = list(map(_distinct, hashed))
            cols = [b.column(0), b.column(1), _signed(list(map(_node, sets))), pa.array(list(map(len, sets)), pa.int32()), _signed(list(map(fingerprint_of, hashed)))]
            cols += [pa.array([sketch(s).tobytes() for s in sets], pa.binary()), _lists(list(map(prefix, sets)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "body", "node", "n", "fp", "sketch", "prefix"])

    return df.mapInArrow(lean(run), "doc_id long, body long, node long, n int, fp long, sketch binary, prefix array<long>")


def _one_a_node(marks: DataFrame) -> DataFrame:
    """marks (with `row`) reduced to one row a node. Rows whose node is theirs alone are passed on where they are;
    the others meet their node's first row by node and row, so copies are spread."""
    firsts = written(marks.groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("c")), "nodes")
    twice = firsts.where("c > 1")
    bits = F.broadcast(bit_filter(twice, "node", "bits", words := filter_words(twice)))
    could = may_hold(F.col("node"), "bits", words)
    these = firsts.join(bits, could, "left_semi").select("node", "row")
    return marks.join(bits, could, "left_anti").unionByName(marks.join(bits, could, "left_semi").join(these.hint("shuffle_hash"), ["node", "row"], "left_semi"))


def _only(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key could be among keys (the same column): a bit filter, no shuffle."""
    bits = F.broadcast(bit_filter(keys, key, "bits", words := filter_words(keys)))
    return df.join(bits, may_hold(F.col(key), "bits", words), "left_semi")


def _similar(pairs: DataFrame, leads: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar, counted exactly; the sets are made anew from the texts that have them."""
    pairs = written(pairs, "tried")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    bodies = written(_only(leads.select("node", "body"), "node", asked), "bodies")
    sets = _sets(_only(texts, "body", bodies), size).groupBy("node").agg(F.first("tokens").alias("tokens"))
    sets = written(sets.join(asked, "node", "left_semi"), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("s"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t"))
    both, n, m = F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t")
    return written(pairs.join(one, "a").join(two, "b").where(both >= (n + m - both) * similarity - 1e-9).select("a", "b"), "similar")


class _Side:
    """Members of a shard in one tree, their sketches by width."""

    def __init__(self, rows: list[tuple]):
        self.node, self.n, fps, sketches, self.root = (list(x) for x in zip(*rows))
        self.tree = BKTree()
        for fp in fps:
            self.tree.add(fp)
        self.sketch = [np.frombuffer(x, "<u8") for x in sketches]
        widths = np.asarray([len(x) for x in self.sketch])
        self.at = np.zeros(len(rows), np.int64)
        self.by: dict[int, np.ndarray] = {}
        for w in np.unique(widths).tolist():
            own = np.flatnonzero(widths == w)
            self.at[own] = np.arange(len(own))
            self.by[w] = np.stack([self.sketch[i] for i in own])
        self.width, self.size, self.roots = widths, np.asarray(self.n), np.asarray(self.root)

    def near(self, fp: int, n: int, mine: np.ndarray, root: int, similarity: float) -> Iterator[tuple[float, int]]:
        """Share of differing members (at least) and place of those that could be similar and have another root."""
        found = np.asarray(self.tree.near(fp, RADIUS), np.int64)
        found = found[self.roots[found] != root] if len(found) else found
        size = self.size[found]
        found = found[np.minimum(size, n) >= np.maximum(size, n) * similarity - 1e-9]
        for w in np.unique(self.width[found]).tolist():
            some, least = found[self.width[found] == w], min(w, len(mine))
            apart = np.bitwise_count(_folded(self.by[w][self.at[some]], least) ^ _folded(mine[None, :], least)).sum(axis=1, dtype=np.int64)
            share = apart / (self.size[some] + n)
            ok = share <= (1 - similarity) / (1 + similarity) + 1e-9
            yield from zip(share[ok].tolist(), some[ok].tolist())


def _tile_links(lo: list[tuple], hi: list[tuple], similarity: float, forest: bool) -> list[tuple[int, int]]:
    """Proposed links between members (node, n, fp, sketch, root) of two blocks, or within one (hi empty), that have
    different roots; a forest that joins what they would join, or all of them."""
    roots = [r[-1] for r in lo + hi]
    values, counts = np.unique(roots, return_counts=True)
    most = int(values[np.argmax(counts)])
    found = []
    for tree, ask in ((lo, hi or lo), (hi, lo)):
        if not tree or not (asking := [r for r in ask if r[-1] != most]):
            continue
        side = _Side(tree)
        for node, n, fp, sk, root in asking:
            found += [(share, min(node, side.node[i]), max(node, side.node[i]), root, side.root[i]) for share, i in side.near(fp, n, np.frombuffer(sk, "<u8"), root, similarity)]
    if not forest:
        return list({(a, b) for _, a, b, *_ in found})
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while up.get(i, i) != i:
            i = up[i] = up.get(up[i], up[i])
        return i

    out = []
    for _, a, b, r, s in sorted(found):
        r, s = top(r), top(s)
        if r != s:
            up[max(r, s)] = min(r, s)
            out.append((a, b))
    return out


def _proposed(named: DataFrame, leads: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """(h, a, b) from the shards of named (h, m, node, n, root) whose members have several roots."""
    mixed = named.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
    left = written(named.join(mixed, "h", "left_semi"), "mixed")
    left = left.join(_only(leads.select("node", "fp", "sketch"), "node", left), "node")
    left = left.withColumn("blocks", F.ceil(F.col("m") / TREE_ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiled = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"), "node", "n", "fp", "sketch", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            got = _tile_links(*sides, similarity, forest) if sides[0] else []
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(got), pa.int64()), *(pa.array([x[k] for x in got], pa.int64()) for k in (0, 1))], names=["h", "a", "b"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for h, lo, hi, second, node, n, fp, sk, root in zip(*cols):
                if key != (h, lo, hi):
                    if key:
                        yield links()
                    key, sides = (h, lo, hi), ([], [])
                sides[second].append((node, n, fp % 2**64, sk, root))
        if key:
            yield links()

    dealt = tiled.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(lean(run), "h long, a long, b long")


def _links(leads: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes: enough of them to connect every similar pair."""
    rows = leads.select("node", "n", F.explode("prefix").alias("h"))
    held = rows.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor("node").alias("x")).where("m > 1")
    shards = written(held.groupBy("m", "x").agg(F.min("h").alias("h"), F.count("*").alias("weight")).select("h", "m", "weight"), "shards")
    buckets = written(_only(rows, "h", shards).join(shards, "h").select("h", "m", "weight", "node", "n"), "buckets")

    score = buckets.groupBy("node").agg(F.sum(F.col("m") * F.col("weight")).alias("score"))
    hubs = buckets.join(score, "node").groupBy("h").agg(F.max_by(F.struct("node", "n"), F.struct("score", "node")).alias("hub"))
    close = F.least("n", "hub.n") >= F.greatest("n", "hub.n") * similarity - 1e-9
    guess = buckets.join(hubs, "h").where((F.col("node") != F.col("hub.node")) & close).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()

    links = _similar(guess, leads, texts, size, similarity)
    again = buckets
    for forest in (True, False):
        roots = components(links).select(F.col("node").alias("of"), "root")
        named = again.join(roots, F.col("node") == F.col("of"), "left").select("h", "m", "node", "n", F.coalesce("root", "node").alias("root"))
        proposed = written(_proposed(named, leads, similarity, forest), "proposed")
        true = _similar(proposed.select("a", "b").distinct(), leads, texts, size, similarity)
        links = links.unionByName(true)
        # where all of a forest is true, what its shard's trees found is connected
        false = written(proposed.join(true, ["a", "b"], "left_anti").select("h").distinct(), "false")
        if not forest or false.isEmpty():
            break
        again = _only(buckets, "h", false).join(false, "h", "left_semi")
    return links


def similar_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, one_in: int = 64, least: int = 16, most: int = 50_000) -> DataFrame:
    """(doc_id, body, component_id, root) for every row of df: component_id is the smallest doc_id that is
    reached over links of at least `similarity`, its own included; body is a hash of the text, root tells
    components of one component_id, or of none, apart.

    Null, empty and blank texts are alike; so are texts of under `size` words with the same words. Repeated rows
    share a group, and so do ties. A null doc_id stays null and takes no part in the minimum; a component of none
    but such rows has a null component_id. An empty table gives an empty one; other columns don't matter.
    """
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    marked = _marks(texts, size, similarity, _common(texts, size, one_in, least, most))
    marks = written(marked.withColumn("row", F.monotonically_increasing_id()), "shingles")
    nodes = marks.groupBy("node").agg(F.min("doc_id").alias("least"))
    roots = components(_links(_one_a_node(marks), texts, size, similarity)).withColumnRenamed("node", "of")
    linked = nodes.join(roots, F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(linked.join(names, "root").select("node", "root", "component_id"), "node").select("doc_id", "body", "component_id", "root")
