import random

import numpy as np

from scenespark.llm import codes as cd


def brute(codes, queries, k):
    out = set()
    for qi, qc in set(queries):
        near = sorted((sum((a ^ b).bit_count() for a, b in zip(qc, c)), i, c) for i, c in set(codes))[:k]
        out |= {(qi, r + 1, i, d) for r, (d, i, _) in enumerate(near)}
    return out


def as_codes(rows):
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def test_index_proves_its_answers():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (1500, 8), np.uint8)
    base[:500] = base[0]
    base[500:800] = base[1] ^ (1 << rng.integers(0, 8, (300, 8))).astype(np.uint8)
    ids = rng.permutation(1500)
    shard = cd.Shard(ids, base, 7)
    q = np.concatenate([base[:40], base[600:610], rng.integers(0, 256, (20, 8), np.uint8)])
    qi, row, dist, seen = shard.search(q)
    for i, c in enumerate(q):
        want = sorted((int(np.bitwise_count(c ^ b).sum()), int(d)) for b, d in zip(base, ids))[:7]
        assert [(int(d), int(shard.ids[r])) for d, r in zip(dist[qi == i], row[qi == i])] == want
    near = shard.search(base[:1])
    assert near[3] < 60  # an exact copy is proven without growing the radius


def test_top_k(spark):
    rng = random.Random(2)
    codes = [(i, rng.randbytes(8)) for i in range(300)] + [(1000 + i, b"\1" * 8) for i in range(100)] + [(5, b"\2" * 8), (5, b"\2" * 8), (7, b"\1" * 8)]
    queries = codes[:20] + [(2000, b"\1" * 8), (7, b"\3" * 8), (2000, b"\1" * 8)]
    frame = lambda rows: spark.createDataFrame([(i, bytearray(c)) for i, c in rows] + [(None, bytearray(b"x" * 8)), (1, None)], "vec_id long, code binary")
    for rows in (64, 100_000):
        assert {tuple(r) for r in cd.top_k(frame(codes), frame(queries), 5, rows, 8).collect()} == brute(codes, queries, 5)
    assert {tuple(r) for r in cd.top_k(frame(codes[:3]), frame(queries), 5).collect()} == brute(codes[:3], queries, 5)
    assert cd.top_k(frame(codes).limit(0), frame(queries)).count() == 0 == cd.top_k(frame(codes), frame(queries).limit(0)).count()


def test_sign_codes(spark):
    rows = [(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (3, [1.0]), (None, [1.0] * 4), (4, [None, float("nan"), 1.0, -0.0]), (1, [0.5, -1.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, bytes(r.code)) for r in cd.sign_codes(df, 4).collect()) == [(1, b"\x09"), (1, b"\x09"), (4, b"\x04")]
    assert cd.sign_codes(df.limit(0), 4).count() == 0
