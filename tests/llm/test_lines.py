import hashlib
import random

from scenespark.llm import lines as ln

WS = " \t\n\x0b\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows):
    far = 2**63 - 1
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(far if d is None else d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != (far if d is None else d))]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256", "text").collect()], key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["A shared line of text", "  a SHARED line of text\t", "short", "", "Éine Zeile für alle hier", "éine Zeile für alle hier", "another common line"] + [f"line number {i} is rare" for i in range(40)]
    rows = [(rng.choice([i, i, i, None, 5]), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "x" * 200_000 + "\n" + "A shared line of text"), (1, "A shared line of text\nA shared line of text"), (1, "A shared line of text\nA shared line of text")]
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, keep__ int")
    assert got(ln.dedup_lines(df)) == brute(rows)


def test_one_line_in_all_documents_over_many_partitions(spark):
    rows = [(i, f"the same line everywhere\nown line of document {i}\nthe same line everywhere") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert got(ln.dedup_lines(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 3)], "doc_id long, text string, N_lines int")
    out = ln.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "N_lines", "n_lines_", "n_dropped", "kept_sha256"]
    assert out.collect()[0].n_lines_ == 1 and ln.dedup_lines(df.limit(0)).count() == 0


def test_bitmap():
    import zlib

    import numpy as np

    keep = zlib.compress(np.packbits([1, 0, 1, 0, 1, 1, 1, 1]).tobytes())
    assert ln.kept_lines("a\nb\nc\nd", keep)[0] == "a\nc"
