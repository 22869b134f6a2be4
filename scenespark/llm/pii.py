"""Personal data (3) by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the e-mail and IP addresses, card and phone numbers that fixed expressions and checks find, and one
in `seed_one_in` of the tokens that look like keys, by a hash of the token. All other tokens with a digit start
without a score; those of under LEAST code points, and short plain numbers, count against what they stand by. The
words just before and just after a token are its lexical patterns; patterns and tokens form a graph, and scores
go back and forth on it. A pattern's confidence is the share of positive ones among its tokens that are known to
be positive or negative, if it has enough positive ones; a token's score is the chance that not all of its
patterns are wrong (noisy or). Tokens of high score are positive in the next round, so patterns that no seed has
can be found by way of them. In the end patterns of high confidence give the tokens that they stand by, seeds or
not: being a seed alone reports nothing, so the key-like tokens that are no seeds tell how much is discovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenespark.llm.common import ascii_lower, bit_filter, filter_words, may_hold, table, written

#: Kinds in the order of the contract; possessive and anchored so that long runs take linear time.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit: ASCII letters and digits, parts joined by hyphens.
TOKEN = r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9]*+(?:-[A-Za-z0-9]++)*+"
TOKEN_KIND = "id"
#: Code points of text beside a token that patterns are made of: a pattern's words stand within them.
CONTEXT = 200
#: Code points of the shortest token that can be an identifier, and of the shortest plain number.
LEAST, LEAST_NUMBER = 6, 9
#: Patterns that are broadcast at most (of at most CONTEXT code points each).
MOST_BROADCAST, SALTS = 50_000, 32


def _checked(kind: str, found: Column) -> Column:
    """Whether a match of the kind's expression counts."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":

        def add(total: Column, i: Column) -> Column:
            d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        luhn = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), add) % 10 == 0
        return F.when(n.between(14, 19), luhn).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _found(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each match of an expression: doc, body, row (tells repeated rows apart), kind, nth,
    before (code points since the match before), context (their last ones), after (those that follow), found."""
    t = F.col("t")
    digit = t.rlike("[0-9]")
    may = {"email": t.contains("@"), "ip": digit & t.contains("."), "card": digit, "phone": digit & t.contains("+"), TOKEN_KIND: digit}
    none = F.array().cast("array<string>")

    def cut(k: int, kind: str, expression: str) -> Column:
        pieces = F.when(may[kind], F.split(t, expression, -1)).otherwise(none)
        return F.struct(F.lit(k).alias("k"), pieces.alias("pieces"), F.when(may[kind], F.regexp_extract_all(t, F.lit(expression), F.lit(0))).otherwise(none).alias("found"))

    rows = df.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t")).where(t.isNotNull() & digit | t.contains("@"))
    kinds = rows.select("doc", "body", "row", F.explode(F.array(*(cut(k, kind, {**PATTERNS, TOKEN_KIND: TOKEN}[kind]) for k, kind in enumerate((*KINDS, TOKEN_KIND))))).alias("c")).where(F.size("c.found") > 0)
    short = F.transform("c.pieces", lambda p: F.struct(F.char_length(p).alias("before"), F.right(p, F.lit(CONTEXT)).alias("context")))
    after = F.transform(F.slice("c.pieces", 2, F.size("c.found")), lambda p: F.left(p, F.lit(CONTEXT)))
    zipped = F.arrays_zip(short.alias("s"), F.col("c.found").alias("found"), after.alias("after"))
    return kinds.select("doc", "body", "row", F.col("c.k").alias("kind"), F.posexplode(zipped).alias("nth", "m")).where("m.found is not null").select(
        "doc", "body", "row", "kind", "nth", F.col("m.s.before").alias("before"), F.col("m.s.context").alias("context"), F.col("m.after").alias("after"), F.col("m.found").alias("found")
    )


def spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, body, kind (its place in KINDS; len(KINDS) for a token), start, end, found, context, after: what the
    expressions find and the checks let pass, in code points. Repeated rows give one result."""
    w = Window.partitionBy("doc", "body", "row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("found")
    placed = _found(df, doc_id, text).withColumn("end", F.sum((F.col("before") + length).cast("long")).over(w))
    ok = F.lit(False)
    for k, kind in enumerate(KINDS):
        ok = F.when(F.col("kind") == k, _checked(kind, F.col("found"))).otherwise(ok)
    ok = F.when(F.col("kind") == len(KINDS), F.lit(True)).otherwise(ok)
    return placed.where(ok).select("doc", "body", "kind", (F.col("end") - length).alias("start"), "end", "found", "context", "after").distinct()


def key_like(token: Column) -> Column:
    """Long, with letters and digits."""
    return (F.length(token) >= 16) & token.rlike("[A-Za-z].*[0-9]|[0-9].*[A-Za-z]")


def too_plain(token: Column) -> Column:
    """No identifier: a few characters, or a short number."""
    return (F.length(token) < LEAST) | ((F.length(token) < LEAST_NUMBER) & ~token.rlike("[^0-9]"))


def _occurrences(found: DataFrame, seed_one_in: int) -> DataFrame:
    """doc, body, start, end, kind, pattern, instance, seed, plain: tokens and base spans with the one to three
    patterns on either side of them; a token inside a base span is not one of its own."""
    k = len(KINDS)
    base = found.where(F.col("kind") < k).groupBy("doc", "body").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    f, b = found.alias("f"), base.alias("b")
    same = F.col("f.doc").eqNullSafe(F.col("b.doc")) & F.col("f.body").eqNullSafe(F.col("b.body"))
    inside = F.exists("spans", lambda s: (s["start"] < F.col("f.end")) & (F.col("f.start") < s["end"]))
    own = f.join(b, same, "left").where((F.col("kind") < k) | ~F.coalesce(inside, F.lit(False))).select("f.*")
    plainly = lambda c: ascii_lower(F.regexp_replace(c, "[0-9]", "0"))
    left = [F.regexp_extract(plainly("context"), rf"(?:(?<!\S)\S+\s+){{{n}}}\S*$", 0) for n in range(3)]
    right = [F.regexp_extract(plainly("after"), rf"^\S*(?:\s+\S+(?!\S)){{{n}}}", 0) for n in range(1, 3)]
    told = lambda ps: F.filter(F.array_distinct(F.array(*ps)), lambda p: p.rlike(r"\p{L}{2}") & p.rlike(r"[^\s\p{L}0-9]|\S\s+\S"))
    patterns = F.concat(F.transform(told(left), lambda p: F.concat(p, F.lit("\u2026"))), F.transform(told(right), lambda p: F.concat(F.lit("\u2026"), p)))
    instance, token = F.lower("found"), F.col("kind") == k
    seed = ~token | (key_like(F.col("found")) & (F.pmod(F.xxhash64(instance), F.lit(seed_one_in)) == 0))
    return own.select("doc", "body", "start", "end", "kind", instance.alias("instance"), seed.alias("seed"), (token & too_plain(F.col("found"))).alias("plain"), F.explode(patterns).alias("pattern"))


def _beside(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """rows joined to patterns by pattern. A few patterns are broadcast; more are salted, since one may have a third
    of all rows, which a bit filter thins first."""
    many = patterns.count()
    if many <= MOST_BROADCAST:
        return rows.join(F.broadcast(patterns), "pattern")
    hashed = patterns.select(F.xxhash64("pattern").alias("k"))
    bits = F.broadcast(bit_filter(hashed, "k", "bits", words := filter_words(hashed)))
    some = rows.join(bits, may_hold(F.xxhash64("pattern"), "bits", words), "left_semi").withColumn("salt", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int"))
    return some.join(patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pattern", "salt"]).drop("salt")


def confident_patterns(edges: DataFrame, rounds: int = 3, least_score: float = 0.8, least_seeds: int = 5) -> DataFrame:
    """(pattern, confidence, positive) of the graph edges (pattern, instance, seed, plain), one row an edge: patterns
    whose confidence is at least least_score after the rounds, with least_seeds positive instances or more."""
    known = edges.withColumn("yes", F.col("seed"))
    for r in range(rounds):
        counts = known.groupBy("pattern").agg(F.count_if("yes").alias("positive"), F.count_if(F.col("plain") & ~F.col("yes")).alias("negative")).where(F.col("positive") >= least_seeds)
        found = written(counts.select("pattern", (F.col("positive") / (F.col("positive") + F.col("negative"))).alias("confidence"), "positive"), "patterns")
        if r + 1 == rounds:
            break
        wrong = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-12)))))
        scored = _beside(edges.where("not plain").select("pattern", "instance"), found).groupBy("instance").agg((1 - wrong).alias("score"))
        accepted = written(scored.where(F.col("score") >= least_score).select(F.col("instance").alias("of")), "accepted")
        known = edges.join(accepted, F.col("instance") == F.col("of"), "left").select("pattern", "instance", "seed", "plain", (F.col("seed") | F.col("of").isNotNull()).alias("yes"))
    return found.where(F.col("confidence") >= least_score)


def discovered(found: DataFrame, rounds: int = 3, least_score: float = 0.8, least_seeds: int = 5, seed_one_in: int = 2) -> DataFrame:
    """doc, body, kind, start, end, seed of the tokens among found (see spans) that a confident pattern stands by."""
    seen = written(_occurrences(found, seed_one_in), "occurrences")
    edges = written(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min("plain").alias("plain")), "edges")
    good = written(confident_patterns(edges, rounds, least_score, least_seeds).select("pattern"), "confident")
    return _beside(seen.where((F.col("kind") == len(KINDS)) & ~F.col("plain")), good).select("doc", "body", "kind", "start", "end", "seed").distinct()


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id for every row of df; how: see discovered.

    Base spans are the leftmost matches, not overlapping within a kind, that pass the kind's check (parts at
    most 255; 14 to 19 digits and Luhn; 10 to 15 digits). spans is kind:start:end of all, ordered by start and
    kind, base kinds before `id`, which is the method's and counted in n_id. Null and empty texts have none (the
    hash is that of ""). Repeated rows each have their row; a null doc_id stays null. Other columns don't matter; an
    empty table gives an empty one.
    """
    k = len(KINDS)
    found = written(spans(df, doc_id, text), "spans")
    new = discovered(found, **how).drop("seed")
    every = found.where(F.col("kind") < k).select("doc", "body", "kind", "start", "end").unionByName(new)
    lists = every.groupBy("doc", "body").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("at"))

    def joined(xs: Column) -> Column:
        kind = F.array(*map(F.lit, (*KINDS, TOKEN_KIND)))
        return F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("body_"))
    at = F.coalesce("at", F.array().cast(lists.schema["at"].dataType))
    both = rows.join(lists, rows.doc_id.eqNullSafe(lists.doc) & rows.body_.eqNullSafe(lists.body), "left").select("doc_id", at.alias("at"))
    counts = [_count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return both.select("doc_id", *counts, F.sha2(joined(F.filter("at", lambda s: s["kind"] < k)), 256).alias("base_sha256"), joined(F.col("at")).alias("spans"), _count(k).alias("n_id"))


def _count(kind: int) -> Column:
    return F.size(F.filter("at", lambda s: s["kind"] == kind)).cast("long")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))
