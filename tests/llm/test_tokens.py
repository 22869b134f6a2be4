import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from scenespark.llm import tokens as tk

PATH = tk.vocabulary()
LIB = Tokenizer.from_file(PATH)
TEXTS = [
    "", " ", "  ", "a", "don't we're  I'll they've'll 're ''re", "\n\n  x \t\n y  ", "x \n\ty\r\n\r\n  z   ", "été 你好 🙂🙂 ñ",
    "a<|endoftext|>b  <|endoftext|><|endoftext|> .<|endo  <|endoftext|>", "..<|endoftext|>", "  <|endoftext|>\n  q", "12345678901234 $$$ %%%%", "\x1c \x85  　x",
]


def lib(text):
    return LIB.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    enc = tk.encoder(PATH)
    assert enc.exact
    for t in TEXTS:
        assert enc.ids(t) == lib(t)


@pytest.mark.parametrize("text", TEXTS)
def test_count_at_every_prefix(text):
    got = tk.counter(PATH).counts(text)
    assert list(got) == [len(lib(text[: i + 1])) for i in range(len(text))]
    assert list(tk.unsqueeze(tk.squeeze(got))) == list(got)


def test_count_at_every_prefix_of_random_texts():
    rng = random.Random(7)
    bits = [" ", "  ", "\n", "\t", "'", "'re", "'s", "ll", "the", "ing", "É", "9", "10", "!", "--", "<|", "<|endoftext|>", "　", "🙂", "a"]
    for _ in range(300):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert list(tk.counter(PATH).counts(t)) == [len(lib(t[: i + 1])) for i in range(len(t))], repr(t)


def test_prefix_counts_frame(spark):
    rows = [(1, "hello there  world", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (None, "we're " * 2000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = tk.prefix_counts(df, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens", "n_bytes", "n_tokens_", "prefix_counts"]
    got = out.select("*", tk.tokens_at("prefix_counts", tk.F.lit(7)).alias("at7"), tk.longest_prefix("prefix_counts", tk.F.lit(3)).alias("fit3")).collect()
    assert len(got) == 5
    for r in got:
        t = r.text or ""
        assert r.n_tokens_ == len(lib(t)) and r.n_bytes == len(t.encode()) and r.at7 == len(lib(t[:7]))
        assert r.fit3 == max([i for i in range(min(len(t), 60) + 1) if len(lib(t[:i])) <= 3])
    assert tk.prefix_counts(df.limit(0), PATH).count() == 0


def check_packing(rows, docs, most):
    by = {}
    for r in rows:
        assert r.length <= most and r.length & (r.length - 1) == 0 and r.offset == 0
        by.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d, t in docs.items():
        ids = [*lib(t or ""), 1]
        own = sorted(by.pop(d), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by


def test_pack(spark):
    docs = {1: "hello there", 2: None, 3: "", 4: "word " * 999, 5: "a<|endoftext|>b", None: "x"}
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id long, text string, length int")
    for most in (2048, 16):
        check_packing(tk.pack(df, PATH, most).collect(), docs, most)
    one = tk.pack(df.where("doc_id = 1"), PATH, with_ids=True).collect()
    assert [i for r in sorted(one, key=lambda r: r.start) for i in r.token_ids] == [*lib("hello there"), 1]
    assert tk.pack(df.limit(0), PATH).count() == 0
    twice = tk.pack(df.where("doc_id = 1").union(df.where("doc_id = 1")), PATH).collect()
    assert len({r.sequence_id for r in twice}) == len(twice)
    with pytest.raises(ValueError):
        tk.pack(df, PATH, 100)


def test_queries_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packing(tk.op7_packing(spark, sf).collect(), docs, 2048)
    got = {r.doc_id: r for r in tk.op8_token_counts(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for d, t in docs.items():
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), len(lib(t)), len(lib(t)) > 512)
