import random
import re

from scenespark.llm import licenses as lc
from scenespark.llm.common import WORD


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(doc_id, text, threshold=lc.THRESHOLD, span=lc.SPAN):
    w = re.findall(WORD, low(text))
    at, base = [], set()
    for label, phrase in lc.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += here
        base |= {label} if here else set()
    more, most = set(), 0.0
    lines = low(text).split("\n")
    for i in range(len(lines)):
        has = set(re.findall(WORD, "\n".join(lines[i : i + span])))
        for t in lc.TEMPLATES:
            want = set(re.findall(WORD, low(t.text)))
            c = len(has & want) / len(want)
            if c >= threshold - 1e-9:
                more.add(t.label)
                most = max(most, c)
    return (doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else most)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, body_ string")
    return sorted(map(tuple, lc.scan(df, **kw).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    bits = [t.text for t in lc.TEMPLATES] + [t.text for t in lc.PHRASES]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "under the MIT license under the mit license"), (5, "under\nthe\nMIT, License"), (6, "cc by nc by nc cc BY-NC"), (None, "Apache License Version 2 é"), (7, "x " * 100_000 + "CC BY-NC"), (8, "under the mit licensé"), (4, "apache license version 2"), (9, "mit"), (9, "mit")]
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(bits).split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(["the", "Zeile", "license", "of"])
            rng.random() < 0.3 and rng.shuffle(w)
            parts.append(" ".join(w) + rng.choice(["", ".", " and more of the sea"]))
        rows.append((100 + i, rng.choice(["\n", " "]).join(parts)))
    for threshold, span in ((lc.THRESHOLD, lc.SPAN), (0.6, 2), (lc.THRESHOLD, 1)):
        assert run(spark, rows, threshold=threshold, span=span) == sorted((brute(d, t, threshold, span) for d, t in rows), key=str)
    assert run(spark, rows[:1]) == [(1, 0, 0, None, None, "", "", 0.0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lc.scan(empty).count() == 0
    assert run(spark, [(4, "released under the mit license")], templates=[]) == [(4, 5, 1, 1, 1, "mit", "mit", 1.0)]


def test_wrapped_notices(spark):
    """Every template of eight words or more, hard-wrapped to three and to six lines among others: the first is found, all as brute force has it."""
    long = [t for t in lc.TEMPLATES if len(t.text.split()) >= 8]
    rows = []
    for i, t in enumerate(long):
        w = t.text.split()
        for j, n in enumerate((3, 6)):
            cut = -(-len(w) // n)
            parts = [" ".join(w[k : k + cut]) for k in range(0, len(w), cut)]
            rows.append((2 * i + j, "\n".join(["# first", *parts, "import x", "y = x"])))
    got = {r[0]: r for r in run(spark, rows)}
    assert got == {d: brute(d, t) for d, t in rows}
    assert all(long[i].label in got[2 * i][6].split(",") for i in range(len(long)))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", lc.scan(df)._jdf.queryExecution().executedPlan().toString())
