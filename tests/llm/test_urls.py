import random

import pytest

from scenespark.llm import urls as ul


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def run(spark, urls, rules, **kw):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, Path string")
    return [tuple(r)[3:] for r in sorted(ul.filter_urls(df, rules, **kw).collect())]


def test_registered_rules(spark):
    urls = [None, "", "nourl", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net/en/", "http://example.net/en/", "https://X.Example.NET/en/q?x#y", "http://example.net?/en/", "http://example.net#/en/",
            "http://notexample.com/de/", "http://example.com/de", "http://a.example.com/de/1", "http://fr.org/fr/", "http://org/fr/x", "http://x.org/FR/", "a://b://c/d", "http://..net/", "http://.net/", "http://é.net/é", "http://a.net/\nfoo", "http://" + "a." * 5000 + "net/" + "x" * 50_000]
    assert run(spark, urls, ul.RULES) == [brute(u, ul.RULES) for u in urls]


def test_random_rules(spark):
    rng = random.Random(1)
    hosts = ["a", "b.a", "c.b.a", "bb.a", "b", "a.b", "é.a"]
    paths = ["/", "/x", "/xy/", "/é/", "/x/y", "/y"]
    rules = [ul.Rule(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(30)]
    rules = list({(r.host, r.path): r for r in rules}.values())
    urls = ["http://" + rng.choice(["", "z.", "b.", "q.w."]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "y/", "q"]) for _ in range(400)]
    assert run(spark, urls, rules, default="block") == [brute(u, rules, "block") for u in urls]


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(ul.xxhash, "xxh64_intdigest", lambda b: len(b))
    p = tmp_path / "i"
    p.write_bytes(ul.index_bytes([ul.Rule("aa", "/", "block"), ul.Rule("bb", "/", "allow")]))
    ix = ul.Index(str(p))
    assert [ix.string(i) if i >= 0 else None for i in ix.find([b"aa/", b"bb/", b"cc/", b"dddd/"])] == ["aa/", "bb/", None, None]


def test_limits(spark):
    assert run(spark, ["http://a/"], []) == [("a", "/", None, "allow")]
    df = spark.createDataFrame([], "page_id long, url string")
    assert ul.filter_urls(df, ul.RULES).count() == 0
    with pytest.raises(ValueError):
        ul.filter_urls(df, ul.RULES, max_bytes=10)
    with pytest.raises(ValueError):
        ul.index_bytes([ul.Rule("a/b", "/", "allow")])
