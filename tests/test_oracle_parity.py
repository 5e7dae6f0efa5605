"""Every query with an oracle must equal the DuckDB SQL on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from paths import SF001
from factorcast.plans.catalog import SEQUENTIAL_SQL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_parity(spark, con, name):
    _same(spark, con, name, E.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(SEQUENTIAL_SQL))
def test_sequential_learning_parity(spark, con, name):
    """Learning in a fixed order equals a recursive SQL that learns row by row."""
    _same(spark, con, name, SEQUENTIAL_SQL[name])


def _same(spark, con, name, sql):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == want


def test_every_query_registered_has_callable():
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    assert len(q) >= 60


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n"] > 0
