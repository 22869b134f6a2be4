import itertools
import random
import re

from scenespark.llm import decontam as dc
from scenespark.llm.common import WORD


def words(t):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            if len(v) < 5:
                continue
            n = min(len(v), 13)
            enough = 11 if n == 13 else n - 1 if n >= 8 else n
            for shift in range(-len(v), len(w)):
                eq = [0 <= k + shift < len(w) and w[k + shift] == v[k] for k in range(len(v))]
                s = [a for a in range(len(v) - n + 1) if sum(eq[a : a + n]) >= enough]
                if s:
                    m = s[-1] + n - s[0]
                    rank = (sum(eq[s[0] : s[0] + m]), -m, -shift)
                    row = (shift + s[0], s[0], m, rank[0])
                    out[d, t, i] = max(out.get((d, t, i), (rank, row)), (rank, row))
    return sorted(((d, i, *row) for (d, t, i), (_, row) in out.items()), key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc", "item", "doc_start", "item_start", "n_words", "n_equal").collect()], key=str)


def test_masks_find_every_window_with_two_substitutions():
    for bad in itertools.combinations(range(dc.WINDOW), 2):
        assert any(all(not (c == "1" and s + k in bad) for k, c in enumerate(m)) for m in dc.MASKS for s in range(dc.WINDOW - len(m) + 1))


def test_masks_find_every_short_item_with_one_substitution():
    for n in range(8, 13):
        for bad in range(n):
            assert any(all(not (c == "1" and s + k == bad) for k, c in enumerate(m)) for m in dc.masks_for(n) for s in range(n - len(m) + 1))


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = "the of and ice sea cloud edge Bay floe É ñ 7".split()
    items = [(i, " ".join(rng.choice(vocab) + rng.choice(["", ".", ", x"]) for _ in range(rng.choice([3, 8, 12, 13, 14, 30])))) for i in range(14)] + [(40 + n, " ".join(rng.choice(vocab) for _ in range(n))) for n in (4, 5, 7, 8, 9, 10, 11, 12)] + [(90, None), (91, ""), (92, "..."), (None, "a b c d e f g h i j k l m n")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            v = words(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                if v:
                    v[rng.randrange(len(v))] = "zz"
            k = rng.randint(0, len(w))
            w[k:k] = v[rng.randint(0, 5) :] if rng.random() < 0.3 else v
        docs.append((rng.choice([d, d, None, 3]), " ".join(w)))
    docs += [(200, None), (201, ""), (202, "A B C d e f g H i j k l m n " * 2), (202, "A B C d e f g H i j k l m n " * 2), (203, "pad " * 30_000 + items[5][1] + " pad" * 100)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, doc int, Body int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    assert got(dc.overlaps(df, bench)) == want
    assert got(dc.overlaps(df, bench, most_bytes=0)) == want
    at_once, dc.AT_ONCE = dc.AT_ONCE, 2
    assert got(dc.overlaps(df, bench)) == want
    dc.AT_ONCE = at_once
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns
    hit = {(d, t) for d, t in docs if brute([(d, t)], items)}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((d, t) for d, t in docs if (d, t) not in hit), key=str)
    assert dc.overlaps(df.limit(0), bench).count() == 0 == dc.overlaps(df, bench.limit(0)).count()
    assert dc.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    short = [(d, t) for d, t in docs if len(t) < 2500]
    own = sorted([tuple(r) for r in dc.op6_decontamination(spark, sf).collect()], key=str)
    ids = {d for d, _ in short}
    assert [r for r in own if r[0] in ids] == brute(short, items) and own


def test_nothing_is_sent_through_python(spark, monkeypatch):
    """An executor would start Python workers of their own kind for rows that the driver's Python makes."""
    df = spark.createDataFrame([(1, "x a b c d e f g h i j k l m n"), (2, "y")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j k l m n")], "item_id long, text string")

    def none(*_, **__):
        raise AssertionError("rows made in Python")

    monkeypatch.setattr(type(spark), "createDataFrame", none)
    assert got(dc.overlaps(df, bench)) == [(1, 7, 1, 0, 14, 14)]
    assert [r.doc_id for r in dc.decontaminate(df, bench).collect()] == [2]
