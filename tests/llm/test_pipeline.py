import random

import corpus_pipeline as cp
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_jaccard import slow_groups
from tests.llm.test_lines import brute as line_brute
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.keep_good(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    have = {r.doc_id for r in kept.select("doc_id").collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    bad = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(good & have) > 0.97 * len(good) and len(bad & have) < 0.3 * len(bad)  # of 399 ratings

    lined = cp.drop_repeated_lines(spark, kept, SF).cache()
    before = sorted(rows_of(kept).items())
    assert rows_of(lined) == {d: t for d, *_, t in line_brute(before)}
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = cp.drop_near_copies(spark, lined, SF).cache()
    before = rows_of(lined)
    assert rows_of(single) == {d: before[d] for d, c in slow_groups(sorted(before.items())) if d == c}

    clean = cp.drop_benchmark_leaks(spark, single, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    some = {d: t for d, t in rows_of(single).items() if len(t) < 3000}
    assert {d for d in rows_of(clean) if d in some} == set(some) - {r[0] for r in leaks(list(some.items()), items)}
    check_packing(cp.pack(spark, clean, SF).collect(), rows_of(clean), 2048)


def test_odd_documents(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    rows = [(i, text(50), "en", "s", 1) for i in range(20)] + [(30, None, None, None, None), (None, text(9), "en", "s", 1), (31, "", "en", "s", 0), (5, text(40), "en", "s", 1), (32, text(30_000), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {*range(20), 30, None, 32} and all(r.length <= 2048 for r in out)
    empty = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert cp.run(spark, empty).count() == 0
