"""URL filters (4): rules in a sorted array of 64-bit digests that workers memory-map.

A rule is a host and a path prefix. The index file holds the sorted xxhash64 digests of all rule strings,
the places of the strings and the strings themselves. For a url, every suffix of its host joined to every
path prefix of a length that some rule has is looked up by one vectorised binary search a batch; a digest
that is found counts only if the stored string is the same.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from scenespark.llm.common import LOWER, UPPER, free_name, shared_dir, table

FOLD = str.maketrans(UPPER, LOWER)
VERDICTS = ("allow", "block")
HEAD = 4


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the registered query (fixed values).
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def index_bytes(rules: Iterable[Rule]) -> bytes:
    """Head (rules, most labels of a host, number of path lengths, 0), path lengths, digests, string places,
    verdicts and strings. Of rules with one host and path the last counts."""
    by = {(r.host.translate(FOLD) + r.path).encode(): r for r in rules}
    if any("/" in r.host or not r.path.startswith("/") or r.verdict not in VERDICTS for r in by.values()):
        raise ValueError("a rule needs a host without a slash, a path that starts with one, and allow or block")
    order = sorted(by, key=lambda s: (xxhash.xxh64_intdigest(s), s))
    lengths = sorted({len(r.path) for r in by.values()})
    most = max((r.host.count(".") + 1 for r in by.values()), default=0)
    places = np.cumsum([0, *map(len, order)], dtype="<u8")
    digests = np.asarray([xxhash.xxh64_intdigest(s) for s in order], "<u8")
    verdicts = np.asarray([VERDICTS.index(by[s].verdict) for s in order], "<u8")
    return b"".join(x.tobytes() for x in (np.asarray([len(order), most, len(lengths), 0], "<u8"), np.asarray(lengths, "<u8"), digests, places, verdicts)) + b"".join(order)


class Index:
    """The file, memory-mapped."""

    def __init__(self, path: str):
        words = np.memmap(path, "<u8", "r", shape=(os.path.getsize(path) // 8,)) if os.path.getsize(path) >= 8 * HEAD else None
        n, self.most, k, _ = (int(x) for x in words[:HEAD])
        cuts = np.cumsum([HEAD, k, n, n + 1, n])
        lengths, self.digests, self.places, self.verdicts = (words[a:b] for a, b in zip(cuts, cuts[1:]))
        self.lengths = lengths.tolist()
        self.strings = np.memmap(path, np.uint8, "r", offset=8 * int(cuts[-1]), shape=(int(self.places[-1]),)) if n else np.zeros(0, np.uint8)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        n = len(self.digests)
        if not keys or not n:
            return out
        want = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, want)
        for k in np.flatnonzero(self.digests[np.minimum(at, n - 1)] == want).tolist():
            i = int(at[k])
            while i < n and self.digests[i] == want[k]:
                if self.strings[int(self.places[i]) : int(self.places[i + 1])].tobytes() == keys[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def string(self, i: int) -> str:
        return self.strings[int(self.places[i]) : int(self.places[i + 1])].tobytes().decode()


@functools.lru_cache(maxsize=4)
def index(path: str) -> Index:
    return Index(path)


def shipped(spark: SparkSession, rules: Iterable[Rule], max_bytes: int = 512 << 20) -> str:
    """Writes the index to the shared folder and hands it to every executor; its name there. The size is
    checked."""
    data = index_bytes(rules)
    if len(data) > max_bytes:
        raise ValueError(f"the index takes {len(data)} bytes; max_bytes is {max_bytes}")
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:32]}.idx"
    if not any(x.rstrip("/").endswith(name) for x in spark.sparkContext.listFiles):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data))
        out.close()
        spark.sparkContext.addFile(path.toString())
    return name


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    if url is None or (i := url.find("://")) < 0:
        return "", ""
    rest = url[i + 3 :]
    end = min((k for k in (rest.find(c) for c in "?#") if k >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(FOLD), slash + path


def keys_of(host: str, path: str, lengths: list[int], most: int) -> list[tuple[int, str]]:
    """Every rule that could fit, longest first; of equally long ones the longer host first."""
    labels, out, at = host.count(".") + 1, [], len(host)
    for _ in range(min(labels, most)):
        at = host.rfind(".", 0, at)
        suffix = host[at + 1 :]
        out += [(len(suffix), suffix + path[:n]) for n in lengths if n <= len(path)]
        if at < 0:
            break
    return sorted(out, key=lambda x: (-len(x[1]), -x[0]))


def filter_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", max_bytes: int = 512 << 20) -> DataFrame:
    """df with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule (host
    and path together; then the longer host) gives the verdict, and where none fits, `default`. Null urls and
    those without :// have an empty host and path, no rule and the default. Other columns stay; a clashing
    one makes the new name end in an underscore. Repeated rows are judged alike; no shuffle.
    """
    if default not in VERDICTS:
        raise ValueError("default is allow or block")
    name = shipped(df.sparkSession, rules, max_bytes)
    new = [free_name(df, c) for c in ("host", "path", "rule", "verdict")]
    at = df.columns.index(url)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in new)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(SparkFiles.get(name))
        for b in batches:
            both = [parts(u) for u in b.column(at).to_pylist()]
            keys: list[bytes] = []
            ends = [0]
            for h, p in both:
                keys += [k.encode("utf-8", "surrogatepass") for _, k in keys_of(h, p, ix.lengths, ix.most)]
                ends.append(len(keys))
            found = ix.find(keys)
            rules, verdicts = [], []
            for a, z in zip(ends, ends[1:]):
                hit = next((i for i in found[a:z] if i >= 0), None)
                rules.append(None if hit is None else ix.string(hit))
                verdicts.append(default if hit is None else VERDICTS[int(ix.verdicts[hit])])
            cols = [[h for h, _ in both], [p for _, p in both], rules, verdicts]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string()) for c in cols)], names=schema.names)

    return df.mapInArrow(judge, schema)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
