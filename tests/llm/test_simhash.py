import random

import numpy as np
import xxhash

from scenespark.llm import simhash as sh
from scenespark.llm.components import components


def slow_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\f\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    sh3 = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh3]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps):
    fps = [(d, f) for d, f in fps]
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(fps):
        r = root(i)
        best[r] = min([x for x in (best.get(r), d) if x is not None], default=None)
    return sorted(((d, f, best[root(i)]) for i, (d, f) in enumerate(fps)), key=str)


def test_fingerprint(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "  \n", "One", "one TWO", "é É ß\tx\x0by\x1cz", "a b c", "a b c d"] + [" ".join(rng.choice("ab cd ef É gh".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(3, 60))) for _ in range(40)]
    for chunk in (1 << 18, 7):
        monkeypatch.setattr(sh, "CHUNK", chunk)
        for t in texts:
            assert sh.fingerprint(t) == slow_fingerprint(t), t


def test_spark_hashes_alike(spark):
    r = spark.sql("select xxhash64('the quick fox') as h").first()
    assert r.h % 2**64 == xxhash.xxh64_intdigest(b"the quick fox", 42)


def test_bk_tree_finds_all():
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**12, 800, np.uint64)]
    tree = sh.BKTree()
    for f in fps:
        tree.add(f)
    for q in fps[:50] + [int(x) for x in rng.integers(0, 2**12, 50)]:
        assert sorted(tree.near(q)) == [i for i, f in enumerate(fps) if (f ^ q).bit_count() <= 2]


def test_links_connect_what_is_near(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for _ in range(500)} | {rng.getrandbits(7) for _ in range(60)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = [(f - 2**64 if f >= 2**63 else f,) for _, f in rows]
    want = {}
    for d, f, c in slow_components(rows):
        want.setdefault(c, set()).add(f)
    want = sorted(map(sorted, (g for g in want.values() if len(g) > 1)))
    for size in (4096, 8):
        df = spark.createDataFrame(signed, "fp long").repartition(3)
        links = sh.near_links(df, size)
        for a, b in links.collect():
            assert ((a ^ b) % 2**64).bit_count() <= 40
        got = {}
        for node, root in components(links).collect():
            got.setdefault(root, set()).add(node % 2**64)
        assert sorted(map(sorted, got.values())) == want


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)] + [(7, 7), (1, 0)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        ra, rb = root(a), root(b)
        if a != b:
            up[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: root(i) for i in linked}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_groups_and_dedup(spark):
    rng = random.Random(9)
    long = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(long)] + [(50 + i, t + " tail") for i, t in enumerate(long)] + [(90, None), (91, ""), (92, " "), (None, long[0]), (None, "nobody else"), (93, "hi"), (93, "hi"), (94, "Hi")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, component_id int")
    got = sorted(((r[0], r[1] % 2**64, r[2]) for r in sh.near_groups(df).collect()), key=str)
    assert got == slow_components([(d, slow_fingerprint(t)) for d, t in rows])
    kept = sh.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted({c for *_, c in got}, key=str)
    assert sh.near_groups(df.limit(0)).count() == 0 == sh.near_dedup(df.limit(0)).count()


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in sh.op10_simhash_near_dedup(spark, sf).collect()), key=str)
    assert got == slow_components([(d, slow_fingerprint(t)) for d, t in docs])
