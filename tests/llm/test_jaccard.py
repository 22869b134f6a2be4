import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from scenespark.llm import jaccard as jc
from scenespark.llm.common import PIECE


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(rows):
    sets, up = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min([x for x in (best.get(root(i)), d) if x is not None], default=None)
    return sorted(((d, best[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randint(0, 10**9)}"
    return " ".join(words)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_sketches_never_have_more_bits_apart_than_members():
    rng = np.random.default_rng(5)
    for n, m, common in ((1, 1, 0), (9, 10, 8), (146, 146, 120), (500, 300, 300), (4000, 3600, 3500)):
        a = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        x, y = a[:n], np.concatenate([a[:common], a[n : n + m - common]])
        s, t = jc.sketch(x), jc.sketch(y)
        least = min(len(s), len(t))
        apart = int(np.bitwise_count(jc._folded(s[None, :], least) ^ jc._folded(t[None, :], least)).sum())
        assert apart <= n + m - 2 * common and apart % 2 == (n + m) % 2


def test_trees_find_what_a_hub_does_not_join():
    """Members in two blocks, none connected: the forest joins what is similar, and nothing else is proposed."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(100)]
    texts = [changed(rng, words, 1) for _ in range(12)] + [changed(rng, words, 60) for _ in range(12)]
    sets = [jc.shingles(t) for t in texts]
    rows = [(i, len(s), jc.fingerprint_of([s]), jc.sketch(s).tobytes(), i) for i, s in enumerate(sets)]
    pairs = {(i, j) for j in range(24) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    every = set(jc._tile_links(rows, [], 0.8, False))
    assert pairs <= every and len(every - pairs) < 3 and len(pairs) > 60
    forest = jc._tile_links(rows, [], 0.8, True)
    assert set(forest) <= every and len(forest) == 11
    assert {(i, j) for i, j in pairs if i % 2 != j % 2} <= set(jc._tile_links(rows[::2], rows[1::2], 0.8, False))


def test_groups_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(900, None), (901, ""), (902, " \t"), (None, "a b"), (903, "A  b"), (904, "a b c d e"), (905, "a b c d e f")]
    for g in range(14):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([7, 30, 60, 200]))]
        rows += [(100 * g + k, changed(rng, words, rng.randint(0, max(1, len(words) // 25)))) for k in range(rng.randint(1, 9))]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(2000 + i, passage + " " + changed(rng, ["y"] * rng.choice([4, 30]), 4)) for i in range(15)]
    want = slow_groups(rows)
    assert len({c for _, c in want}) < len(rows) - 20
    rows_a_tree = jc.TREE_ROWS
    for how, tree in (({}, rows_a_tree), ({"one_in": 1, "least": 2, "most": 9}, 3)):
        jc.TREE_ROWS = tree
        got = jc.similar_groups(frame(spark, rows), **how)
        assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str) == want
    jc.TREE_ROWS = rows_a_tree
    assert jc.similar_groups(frame(spark, rows).limit(0)).count() == 0


def test_stage_takes_copies_with_changed_words(spark):
    rng = random.Random(12)
    rows, kept = [], set()
    for g in range(10):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        far = [w if i % 50 != 25 else f"z{g}" for i, w in enumerate(words)]  # Jaccard 0.82
        rows += [(10 * g, " ".join(words)), (10 * g + 1, changed(rng, words, 1)), (10 * g + 2, " ".join(far)), (10 * g + 3, " ".join(w if i % 20 else "u" for i, w in enumerate(words)))]
        kept |= {10 * g, 10 * g + 3}
    docs = frame(spark, rows).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()) == sorted(kept)


def test_python_gets_texts_in_small_batches(spark, monkeypatch):
    frames = []
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: frames.append(f) or self)
    jc._sets(df, 5)
    batch = pa.RecordBatch.from_pydict({"text": [f"word {i} of some text" for i in range(1500)]})
    out = list(frames[0](iter([batch])))
    assert sum(b.num_rows for b in out) == 1500 and max(b.num_rows for b in out) <= PIECE
