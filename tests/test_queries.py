"""Every registered query runs on the smallest tables; those with SQL equal DuckDB's result."""

import math

import duckdb
import pytest

from hawser.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(float(v), 5)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    rel = duck.sql(registry.ORACLES[name])
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_stream_equals_batch(spark, small):
    stream = {r.sample_id: tuple(r) for r in registry.QUERIES["t01_congestion_stream"](spark, small).collect()}
    batch = {r.sample_id: tuple(r) for r in registry.QUERIES["t01_congestion_batch"](spark, small).collect()}
    assert stream == batch and stream


def test_sticky_stream_equals_batch(spark, small):
    stream = {r.id: r.region for r in registry.QUERIES["t15_sticky_stream"](spark, small).collect()}
    assert stream == {r.id: r.region for r in registry.QUERIES["t15_sticky_sessions"](spark, small).collect()} and stream
