"""Every core query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from scenespark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    r = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["early_mean", "late_mean", "decline_pct"]
    assert set(e.oracle_sql()) <= set(e.queries())
