import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scenespark.llm import common as cm


def test_bit_filter_never_misses(spark):
    rng = random.Random(1)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(500)] + [0, -1, 2**63 - 1, -(2**63)]
    others = [rng.getrandbits(64) - 2**63 for _ in range(3000)]
    have = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = spark.createDataFrame([(k,) for k in keys + others], "x long")
    for words in (4, 1024):
        bits = F.broadcast(cm.bit_filter(have, "k", "b", words))
        passed = {r.x for r in rows.join(bits, cm.may_hold(F.col("x"), "b", words), "left_semi").collect()}
        assert set(keys) <= passed
        if words == 1024:
            assert len(passed) < len(keys) + 300
        stopped = rows.join(bits, cm.may_hold(F.col("x"), "b", words), "left_anti").count()
        assert stopped + rows.join(bits, cm.may_hold(F.col("x"), "b", words), "left_semi").count() == rows.count()
    none = F.broadcast(cm.bit_filter(have.limit(0), "k", "b", 4))
    assert rows.join(none, cm.may_hold(F.col("x"), "b", 4), "left_semi").count() == 0


def test_words_and_lower(spark):
    texts = ["", "ABC def", "É Éa ÀB", "..a--b..", "İI", "x\x00y\x7fz", "  ", "a1_b2", "你好 WORLD", "ß\tẞ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", cm.ascii_lower(F.col("t")).alias("low"), cm.split_words(cm.ascii_lower(F.col("t"))).alias("w")).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.i])
        assert r.low == low and r.w == re.findall(cm.WORD, low)


def test_a_cluster_needs_a_shared_folder():
    def fake(master):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None, getConf=lambda: SimpleNamespace(get=lambda name: None))
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda name, other: None))

    assert cm.shared_dir(fake("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            cm.shared_dir(fake(master))


def test_lean_gives_all_rows_in_order_in_small_batches():
    import pyarrow as pa

    from scenespark.llm import common

    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 0), (0, 3), (3, 2000), (2000, 2512))]
    sizes = []

    def run(given):
        for b in given:
            sizes.append(b.num_rows)
            yield b

    assert [x for b in common.lean(run)(iter(batches)) for x in b.column(0).to_pylist()] == list(range(2512))
    assert max(sizes) <= common.PIECE and min(sizes) > 0


def test_written_leaves_no_shuffle_files(spark):
    import glob
    import time

    from scenespark.llm import common

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    there = lambda: {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before, was = there(), spark.conf.get(common.CLEANUP, None)
    out = common.written(spark.range(5000).repartition(7).groupBy("id").count(), "counts")
    end = time.time() + 20
    while there() - before and time.time() < end:
        time.sleep(0.2)
    assert not there() - before and spark.conf.get(common.CLEANUP, None) == was
    assert out.count() == 5000 == out.distinct().count()
