"""Every registered query against its SQL oracle (DuckDB) on the smallest tables."""

import os

import pytest

import __spark_entry__ as E
from gridlens.plans import catalog
from tests.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) <= set(E.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    msg, ok = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SF)
    assert ok, msg


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["o_orderstatus", "_depth", "o_custkey", "_rank"]
    assert df.count() == 4
