"""Every registered query against its DuckDB oracle on sf0.001."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, norm

SQL = E.oracle_sql()
KEYS = sorted(E.queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"train_n", "run", "intent", "text", "dist", "rk"} <= set(df.columns)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf, con, key):
    df = E.queries()[key](spark, sf)
    rows = [tuple(norm(x) for x in r) for r in df.collect()]
    if key not in SQL:
        pytest.skip("no SQL oracle for this query (checked elsewhere)")
    rel = con.execute(SQL[key])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    idx = [cols.index(c) for c in df.columns]
    drows = [tuple(norm(r[i]) for i in idx) for r in rel.fetchall()]
    assert Counter(rows) == Counter(drows)
