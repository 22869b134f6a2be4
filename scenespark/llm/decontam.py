"""Benchmark decontamination (6) by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of some words of a short span; fixed masks say which, and the words between are ignored.
Seeds of benchmark and training texts are joined; a common seed proposes an alignment of a benchmark item
with a document, and alignments are verified word by word, so that substituted words are tolerated.

Items of WINDOW words or more are found by their windows: two masks find every one with at most two
substitutions, since wherever two words differ, one of the masks fits somewhere without touching them. That is
a similarity of 11/13 > 0.8 word for word, and 13 words hold nine 5-word shingles. Items of 8 to 12 words are
found whole with at most one substitution, those of 8 and 9 by a lighter mask that fits into them. Items of 5 to
7 words are found whole and unchanged: a seed that a substitution leaves whole has three words there, and three
words stand in texts by chance. Items under LEAST = 5 words hold no 5-word shingle and aren't searched: a
document isn't suspect for the word "yes".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm.common import ascii_lower, bit_filter, filter_words, free_name, may_hold, split_words, table, written

WINDOW, EQUAL, LEAST = 13, 11, 5
#: For windows and items of 10 to 12 words; for items of 8 and 9.
MASKS, LIGHT = ("11101011", "110100111"), ("110011",)
#: Bytes that a seed of the benchmark takes in a broadcast, and how many may be broadcast.
SEED_BYTES, MOST_BYTES = 64, 64_000_000
#: Alignments of a document that are verified in one row.
AT_ONCE = 512


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of items of n words."""
    return MASKS if n >= 10 else LIGHT if n >= 8 else ("1" * n,) if n >= LEAST else ()


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))))


def _seeds(df: DataFrame, masks: list[str], keep: list[str], known: tuple[DataFrame, int] | None = None) -> DataFrame:
    """keep, pos and seed of every place where a mask fits; df has the column `hashed` (hashes of its words). With
    known, a bit filter of seeds and its size, only those that it lets through.

    Words are set beside their neighbours by zipping shifted arrays, so all that is done for each of them is
    compiled."""
    ones = {m: [i for i, c in enumerate(m) if c == "1"] for m in masks}
    shifts = sorted({i for o in ones.values() for i in o})
    n = F.size("hashed")
    zipped = F.arrays_zip(*(F.slice("hashed", i + 1, F.greatest(n, F.lit(1))).alias(f"w{i}") for i in shifts))
    placed = df.select(*keep, F.posexplode(zipped).alias("pos", "w"))
    seed = {m: F.when(F.col(f"w.w{o[-1]}").isNotNull(), F.xxhash64(F.lit(m), *(F.col(f"w.w{i}") for i in o))) for m, o in ones.items()}
    names = [f"s{k}" for k in range(len(masks))]
    rows = placed.select(*keep, "pos", *(seed[m].alias(x) for m, x in zip(masks, names)))
    if known is not None:
        bits, words = known
        some = F.lit(False)
        for x in names:
            some = some | F.coalesce(may_hold(F.col(x), "bits", words), F.lit(False))
        rows = rows.join(F.broadcast(bits), some, "left_semi")
    return rows.select(*keep, "pos", F.explode(F.array(*names)).alias("seed")).where("seed is not null")


def overlaps(df: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc, body, item, doc_start, item_start, n_words, n_equal: the best alignment of every document with
    every item of which it holds a window (in words from 0; from the first to the last window that fits).
    body is a hash of the text that tells rows of one doc_id apart.

    Words are A-Z lower-cased runs of letters, digits and non-ASCII characters. Null, empty and wordless texts
    hold nothing, and items under LEAST words are held by nothing. Repeated rows give one result; of alignments
    that tie, the one further left. Null ids are kept as null. Empty tables give an empty one. Other columns don't
    matter. Seeds of the benchmark are broadcast if they take at most most_bytes, and shuffled beyond.
    """
    words = words_of(F.col(item_text))
    items = bench.select(F.col(item_id).alias("item"), words.alias("item_words")).where(F.size("item_words") >= LEAST)
    items = written(items.distinct().withColumn("key", F.xxhash64("item", F.array_join("item_words", " "))).withColumn("size", F.size("item_words")), "items")
    sizes = sorted(r[0] for r in items.select(F.least("size", F.lit(10)).alias("s")).distinct().collect())  # 5 to 10
    hashed = items.withColumn("hashed", F.transform("item_words", lambda w: F.xxhash64(w)))
    none = df.sparkSession.range(0).selectExpr("id AS key", "0 AS size", "0 AS pos", "id AS seed")  # rows from Python would start workers
    for s in sizes:
        none = none.unionByName(_seeds(hashed.where(F.least("size", F.lit(10)) == s), list(masks_for(s)), ["key", "size"]))
    known = written(none, "seeds")
    many = known.count()
    own_masks = list(dict.fromkeys(m for s in sizes for m in masks_for(s))) or list(MASKS)

    docs = df.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("hashed"))
    size = filter_words(known)
    own = _seeds(docs, own_masks, ["doc", "body"], (bit_filter(known, "seed", "bits", size), size))
    asked = known.withColumnRenamed("pos", "item_pos")
    hits = own.join(F.broadcast(asked) if many * SEED_BYTES <= most_bytes else asked, "seed")
    found = written(hits.select("doc", "body", "key", "size", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "alignments")

    # a row holds at most some AT_ONCE alignments of a document, each with the words that it covers
    crowded = found.groupBy("doc", "body").agg(F.count("*").alias("c")).where(F.col("c") > AT_ONCE).select(F.col("doc").alias("d"), F.col("body").alias("b"), F.ceil(F.col("c") / AT_ONCE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key", "shift"), F.coalesce("parts", F.lit(1)))
    parted = found.join(crowded, F.col("doc").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left").withColumn("part", part)
    proposed = written(parted.groupBy("doc", "body", "part").agg(F.collect_list(F.struct("key", "size", "shift")).alias("proposed")), "proposed")

    # only texts that could have an alignment are shuffled to it
    there = df.select(F.col(doc_id).alias("doc_"), F.xxhash64(F.col(text)).alias("body_"), F.col(text).alias("text_"))
    bits = F.broadcast(bit_filter(proposed, "body", "bits", size := filter_words(proposed)))
    there = there.join(bits, may_hold(F.col("body_"), "bits", size), "left_semi")
    both = there.join(proposed.hint("shuffle_hash"), F.col("doc_").eqNullSafe(F.col("doc")) & (F.col("body_") == F.col("body")))
    both = both.select("doc", "body", "proposed", words_of(F.col("text_")).alias("words"))
    covered = lambda c: F.slice("words", F.greatest(c["shift"], F.lit(0)) + 1, F.greatest(c["size"] + F.least(c["shift"], F.lit(0)), F.lit(0)))
    tried = both.select("doc", "body", F.explode(F.transform("proposed", lambda c: F.struct(c["key"].alias("key"), c["shift"].alias("shift"), covered(c).alias("part")))).alias("c")).select("doc", "body", "c.*").distinct()

    joined = tried.join(items, "key")
    length = F.least(F.col("size"), F.lit(WINDOW))
    enough = F.when(F.col("size") >= WINDOW, EQUAL).when(F.col("size") >= 8, F.col("size") - 1).otherwise(F.col("size"))
    equal = F.transform("item_words", lambda w, i: F.get(F.col("part"), i + F.least("shift", F.lit(0))).eqNullSafe(w))
    judged = joined.select("doc", "body", "item", "shift", equal.alias("equal"), length.alias("length"), enough.alias("enough"))
    starts = F.filter(F.sequence(F.lit(0), F.size("equal") - F.col("length")), lambda s: F.size(F.filter(F.slice("equal", s + 1, F.col("length")), lambda e: e)) >= F.col("enough"))
    fits = judged.withColumn("starts", starts).where(F.size("starts") > 0)
    spans = fits.select("doc", "body", "item", "shift", "equal", F.col("starts")[0].alias("item_start"), (F.array_max("starts") + F.col("length") - F.col("starts")[0]).alias("n_words"))
    counted = spans.withColumn("n_equal", F.size(F.filter(F.slice("equal", F.col("item_start") + 1, F.col("n_words")), lambda e: e)))
    row = F.struct((F.col("shift") + F.col("item_start")).alias("doc_start"), "item_start", "n_words", "n_equal")
    rank = F.struct("n_equal", -F.col("n_words"), -F.col("shift"))
    best = counted.groupBy("doc", "body", "item").agg(F.max_by(row, rank).alias("r"))
    return best.select("doc", "body", "item", "r.*")


def decontaminate(df: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of df that hold no window of a benchmark item; all columns as they are. Repeated rows stay or
    go together."""
    found = written(overlaps(df, bench, doc_id, text, **how).select("doc", "body").distinct(), "leaks")
    doc, body = free_name(df, "doc"), free_name(df, "body")
    same = F.col(doc_id).eqNullSafe(F.col(doc)) & F.xxhash64(F.col(text)).eqNullSafe(F.col(body))
    bits = free_name(df, "bits")
    could, hashed = F.broadcast(bit_filter(found, "body", bits, size := filter_words(found))), may_hold(F.xxhash64(F.col(text)), bits, size)
    # rows that can't be among them are passed on where they are
    rest = df.join(could, hashed, "left_semi").join(found.select(F.col("doc").alias(doc), F.col("body").alias(body)).hint("shuffle_hash"), same, "left_anti")
    return df.join(could, hashed, "left_anti").unionByName(rest)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item of which it holds a window."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "doc_start", "item_start", "n_words", "n_equal")
