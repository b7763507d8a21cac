"""Every registered query with an oracle equals its DuckDB statement on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.oracle_check import TABLES, rows_of

SQLS = E.oracle_sql()
OWN_TESTS = tuple(f"op{n}_" for n in range(1, 14)) + ("pipeline",)   # held in tests/llm


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(k for k in SQLS if not k.startswith(OWN_TESTS)))
def test_query_matches_oracle(spark, sf, con, name):
    sdf = E.queries()[name](spark, sf)
    sc, sr = rows_of(sdf.toPandas())
    dc, dr = rows_of(con.execute(SQLS[name]).fetchdf())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_every_query_has_a_callable_and_most_an_oracle():
    qs = E.queries()
    assert set(SQLS) <= set(qs)
    assert len(qs) >= 50
    assert {k for k in qs if not k.startswith(OWN_TESTS)} <= set(SQLS)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "similarity" in df.columns
