"""License scans (2): exact set-similarity join of text blocks with license templates, in DataFrame functions.

A block is a run of SPAN lines, so that a wrapped notice is one (a text of fewer lines is one block); every
line begins a block. A block matches a template if it holds at least THRESHOLD of the template's distinct
words, however they stand; what a shorter run would meet, the block that holds it meets too. Tokens that no
template has cannot count, so blocks are reduced to template tokens; a text that holds too few of every
template as a whole has no block that matches and goes first. Tokens are ordered by the number of blocks that
have them, rarest first, over all documents. A
template that needs `need` common tokens can only be met by a block that has one of its first
size - need + 1 tokens (prefix filter) and at least `need` tokens at all (length filter); the first common
token bounds what can still follow on either side (positional filter). What is left is counted exactly.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm.common import WORD, ascii_lower, split_words, table, written

THRESHOLD = 0.9
#: Lines in a block.
SPAN = 4


class Template(NamedTuple):
    label: str
    text: str


#: Phrases and labels of the registered query (fixed values).
PHRASES = (Template("mit", "under the mit license"), Template("apache-2", "apache license version 2"), Template("cc-by-nc", "cc by nc"))
#: Sentences by which public licenses are given.
TEMPLATES = (
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2", "you may not use this file except in compliance with the License"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template("cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def _tokens(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sorted(set(re.findall(WORD, low)))


def _array(xs: Iterable[str]) -> Column:
    return F.array(*map(F.lit, xs)) if (xs := list(xs)) else F.array().cast("array<string>")


def _stands(ws: list[str]):
    """Whether the column `words` has ws from a place on."""

    def at(i: Column) -> Column:
        out = F.get(F.col("words"), i).eqNullSafe(ws[0])
        for k, w in enumerate(ws[1:], 1):
            out = out & F.get(F.col("words"), i + k).eqNullSafe(w)
        return out

    return at


def _line_blocks(low: Column, universe: Column, span: int) -> Column:
    """The distinct template tokens of every run of `span` lines, by the line that it begins with."""
    lines = F.transform(F.split(low, "\n", -1), lambda line: F.array_intersect(split_words(line), universe))
    if span == 1:
        return lines

    def of(has: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(has) - span + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_distinct(F.flatten(F.slice(has, i, span))))

    return F.get(F.transform(F.array(lines), of), 0)  # the lambda binds the lines once


def matches(df: DataFrame, templates: Iterable[Template] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """doc, body, block (its first line, from 0), label, containment: every block of every document that holds at
    least `threshold` of a template's distinct words; body is a hash of the text, which tells rows of one doc_id
    apart. Blocks overlap, so a notice is found once in each that holds it. Null and empty texts have no match;
    repeated rows repeat theirs."""
    sets = [(i, t.label, _tokens(t.text)) for i, t in enumerate(templates)]
    sets = [(i, label, toks, math.ceil(threshold * len(toks) - 1e-9)) for i, label, toks in sets if toks]
    spark = df.sparkSession
    if not sets:
        return df.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.lit(0).alias("block"), F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    universe = sorted({t for *_, toks, _ in sets for t in toks})
    least = min(need for *_, need in sets)
    low = ascii_lower(F.coalesce(F.col(text), F.lit("")))

    def may_match(has: Column) -> Column:
        return functools.reduce(operator.or_, (F.size(F.array_intersect(has, _array(toks))) >= need for *_, toks, need in sets))

    docs = df.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("body"), low.alias("low"))
    docs = docs.where(F.exists(F.array(F.array_intersect(split_words(F.col("low")), _array(universe))), may_match))
    lines = docs.select("doc", "body", F.posexplode(_line_blocks(F.col("low"), _array(universe), span)).alias("block", "has"))
    blocks = written(lines.where(F.size("has") >= least), "blocks")

    counts = blocks.select(F.explode("has").alias("t")).groupBy("t").count().collect()  # a row for each template token at most
    often = {r[0]: r[1] for r in counts}
    order = sorted(universe, key=lambda t: (often.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    prefix, whole = [], []
    for i, label, toks, need in sets:
        toks = sorted(toks, key=rank.__getitem__)
        whole.append((i, label, toks, need))
        prefix += [(t, i, at) for at, t in enumerate(toks[: len(toks) - need + 1])]
    small = spark.createDataFrame(prefix, "t string, template int, at int").join(spark.createDataFrame(whole, "template int, label string, tokens array<string>, need int"), "template")

    ordered = blocks.withColumn("has", F.array_intersect(_array(order), F.col("has")))
    placed = ordered.select("doc", "body", "block", "has", F.posexplode("has").alias("place", "t"))
    # the templates' tokens: bounded by the templates, which are a parameter
    near = placed.join(F.broadcast(small), "t").where(
        (F.size("has") >= F.col("need"))
        & (1 + F.least(F.size("tokens") - F.col("at") - 1, F.size("has") - F.col("place") - 1) >= F.col("need"))
        & ((F.col("place") == 0) | ~F.arrays_overlap(F.slice("has", F.lit(1), F.greatest(F.col("place"), F.lit(1))), F.col("tokens")))
    )
    common = F.size(F.array_intersect("has", "tokens"))
    return near.where(common >= F.col("need")).select("doc", "body", "block", "label", (common / F.size("tokens")).alias("containment"))


def scan(df: DataFrame, phrases: Iterable[Template] = PHRASES, templates: Iterable[Template] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of df.

    Words are A-Z lower-cased runs of letters, digits and non-ASCII characters. base_*: places where a
    phrase's words stand one after another. labels adds those of matched templates; score is the largest
    containment of a template, 1 where a phrase stands and 0 without any. Null text is empty text: no words,
    no places, empty labels, score 0. Repeated rows each have their row; a null doc_id stays null.
    """
    low = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("body_"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    base = low.withColumn("words", split_words(F.col("low")))
    places, named = [], []
    for label, phrase in phrases:
        ws = phrase.split()
        may = F.lit(True)
        for w in ws:
            may = may & F.col("low").contains(w)  # most texts lack a word of the phrase
        n = F.size("words") - len(ws)
        places.append(F.when(may & (n >= 0), F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), _stands(ws))).otherwise(F.array().cast("array<int>")))
        named.append(label)
    placed = base.select("doc_id", "body_", F.size("words").cast("long").alias("n_words"), *(p.alias(f"at_{k}") for k, p in enumerate(places)))
    at = [F.col(f"at_{k}") for k in range(len(places))]
    every = F.concat(*at) if at else F.array().cast("array<int>")
    names = F.array_compact(F.array(*(F.when(F.size(a) > 0, F.lit(n)) for a, n in zip(at, named)))) if at else _array([])
    docs = placed.select(
        "doc_id", "body_", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(names)).alias("base"),
    )
    found = matches(df, templates, threshold, doc_id, text, span).groupBy("doc", "body").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    both = docs.join(found, docs.doc_id.eqNullSafe(found.doc) & docs.body_.eqNullSafe(found.body), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", _array([]))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_array(xs: Iterable[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def oracle_sql() -> str:
    """The same by comparing every block with every template."""
    templates = ", ".join(f"('{t.label}', {_sql_array(_tokens(t.text))}, {math.ceil(THRESHOLD * len(_tokens(t.text)) - 1e-9)})" for t in TEMPLATES)
    low = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = []
    for label, phrase in PHRASES:
        ws = phrase.split()
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(ws, 1))
        places.append(f"list_filter(range(0, greatest(len(words) - {len(ws) - 1}, 0)), lambda i: {same})")
    names = ", ".join(f"CASE WHEN len(a{k}) > 0 THEN '{t.label}' END" for k, t in enumerate(PHRASES))
    return rf"""
WITH d AS (SELECT doc_id, {low.format("text")} AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{WORD}') AS words FROM d),
p AS (SELECT doc_id, len(words) AS n_words, {", ".join(f"{x} AS a{k}" for k, x in enumerate(places))} FROM w),
b AS (SELECT doc_id, n_words, {" || ".join(f"a{k}" for k in range(len(PHRASES)))} AS places,
  list_filter([{names}], lambda x: x IS NOT NULL) AS base FROM p),
t(label, tokens, need) AS (VALUES {templates}),
l AS (SELECT doc_id, string_split(low, chr(10)) AS lines FROM d),
r AS (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - {SPAN}, 0) + 1)) AS i FROM l),
s AS (SELECT doc_id, list_distinct(regexp_extract_all(array_to_string(lines[i + 1 : i + {SPAN}], chr(10)), '{WORD}')) AS has FROM r),
m AS (SELECT doc_id, label, len(list_intersect(has, tokens)) / len(tokens) AS containment
  FROM s JOIN t ON len(list_intersect(has, tokens)) >= need),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(containment) AS most FROM m GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ','), '') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(most, 0.0) END AS score
FROM b LEFT JOIN g ON b.doc_id = g.doc_id
"""
