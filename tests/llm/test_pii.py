import hashlib
import random
import re

from scenespark.llm import pii

RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base(text):
    out = []
    for k, (kind, r) in enumerate(RE.items()):
        for m in re.finditer(r, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def row(d, text):
    b = base(text)
    s = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in b)
    return (d, *(sum(k == i for _, k, _, _ in b) for i in range(4)), hashlib.sha256(s.encode()).hexdigest()), s


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, body_ int")
    return pii.find(df, **kw).collect()


def test_base_spans(spark):
    rng = random.Random(1)
    bits = ["a@b.c", "a@b.c_d@e.f", "x..y%+-@-.-", "@", ".", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.01.1.1", "99999999999999999999.1.1.1", "4111 1111-1111 1111", "4111111111111111", "4111111111111112", "+1 (017) 555-7713", "+1234567890123456", "+12", "++1 2345678901", "é🙂", " ", "-", "7", "0", "é@b.c", "a@é.c", "\n", "_", "00000000000000"]
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "a" * 60_000 + " " + "1" * 60_000 + "." + "é" * 1000 + " a@b.c"), (4, "a@b" + ".c" * 20_000), (5, "1 " * 20_000), (6, "a@b.c " * 3000), (7, "x@y.z"), (7, "x@y.z"), (7, "none"), (8, "+" + "1(" * 9000)]
    rows += [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    got = sorted((tuple(r)[:6] for r in run(spark, rows)), key=str)
    assert got == sorted((row(d, t)[0] for d, t in rows), key=str)
    for r in run(spark, rows[11:60]):
        s = [x for x in r.spans.split(",") if x and not x.startswith("id:")]
        assert ",".join(s) == row(r.doc_id, dict(rows[11:60])[r.doc_id])[1]


def test_patterns_discover_unseen_identifiers(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"é words here member key: {'a1' + hexes(18)} and more") for i in range(40)]
    rows += [(50, "other words member key: ab12-34 end"), (51, "the lot of 123456 tons"), (52, "page 123456 of it"), (53, "reach member key: zz9999zz, call +1 (017) 555-7713 now")]
    got = {r.doc_id: r.spans for r in run(spark, rows)}
    t = dict(rows)
    at = t[50].index("ab12-34")
    assert got[50] == f"id:{at}:{at + 7}" and got[51] == got[52] == ""
    a, p = t[53].index("zz9999zz"), t[53].index("+1")
    assert got[53] == f"id:{a}:{a + 8},phone:{p}:{p + 17}"
    assert got[0].startswith("id:")


def slow_patterns(edges, rounds, least, support):
    """edges: (pattern, instance) to (seed, plain)."""
    yes = {e: v[0] for e, v in edges.items()}
    for _ in range(rounds):
        conf = {}
        for q in {q for q, _ in edges}:
            pos = sum(yes[e] for e in edges if e[0] == q)
            neg = sum(edges[e][1] and not yes[e] for e in edges if e[0] == q)
            if pos >= support:
                conf[q] = (pos / (pos + neg), pos)
        wrong = {}
        for (q, i), (_, plain) in edges.items():
            if q in conf and not plain:
                wrong[i] = wrong.get(i, 1) * (1 - conf[q][0])
        yes = {e: v[0] or 1 - wrong.get(e[1], 1) >= least - 1e-9 for e, v in edges.items()}
    return {q: v for q, v in conf.items() if v[0] >= least}


def test_scores_match_brute_force(spark):
    rng = random.Random(3)
    kinds = {f"i{i}": rng.choice([(True, False), (False, False), (False, False), (False, True)]) for i in range(60)}
    edges = {(f"p{rng.randint(0, 9)}", i): kinds[i] for i in kinds for _ in range(3)}
    edges |= {("second", f"i{i}"): kinds[f"i{i}"] for i in range(60) if kinds[f"i{i}"] == (False, False)}
    df = spark.createDataFrame([(*e, *v) for e, v in edges.items()], "pattern string, instance string, seed boolean, plain boolean")
    for least, broadcast in ((0.55, pii.MOST_BROADCAST), (0.55, 0), (0.95, 0)):
        before, pii.MOST_BROADCAST = pii.MOST_BROADCAST, broadcast
        got = {r.pattern: (r.confidence, r.positive) for r in pii.confident_patterns(df, 3, least, 2).collect()}
        pii.MOST_BROADCAST = before
        want = slow_patterns(edges, 3, least, 2)
        assert got.keys() == want.keys() and all(abs(got[q][0] - want[q][0]) < 1e-9 and got[q][1] == want[q][1] for q in want)
    assert "second" in slow_patterns(edges, 3, 0.55, 2) and "second" not in slow_patterns(edges, 1, 0.55, 2)


def test_tokens_that_are_no_seeds_are_discovered(spark):
    """Half of the key-like tokens are held out: they must be found by what stands beside them alone."""
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(38)) + "a1"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, truth = [], {}
    for i in range(200):
        rows.append((i, f"{word()} {word()} {rng.choice(['token = ', 'ключ доступа: '])}\"{key()}\" {word()}, in {rng.randint(1, 9999)} of {word()}{rng.randint(1, 99)}"))
        truth[i] = True
    rows += [(300 + i, f"{word()} {word()} {key()} {word()} {word()}") for i in range(60)]  # nothing tells these
    found = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = pii.discovered(found).collect()
    new = {r.doc for r in got if not r.seed}
    seeds = {r.doc for r in got if r.seed}
    held_out = {d for d in truth if d not in seeds}
    assert 60 < len(held_out) < 140
    assert len(new & held_out) >= 0.9 * len(held_out) and len(new - held_out) == 0


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r)[:6] for r in pii.op3_pii(spark, sf).collect())
    assert got == sorted(row(d, t)[0] for d, t in docs)
