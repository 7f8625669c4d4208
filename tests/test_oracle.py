"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        return "<nan>" if math.isnan(v) else repr(float(v))
    return str(v)


@pytest.fixture(scope="module")
def con():
    import os

    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_builder():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 90


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    rel = con.execute(SQL[name])
    drows = rel.fetchall()
    dcols = [d[0] for d in rel.description]
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    order = sorted(scols)
    ss = sorted(tuple(_norm(r[scols.index(c)]) for c in order) for r in srows)
    ds = sorted(tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows)
    assert ss == ds


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert "tail_abs_diff_mean" in df.columns
