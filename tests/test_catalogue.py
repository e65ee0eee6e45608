"""Every query with DuckDB text gives the same rows there."""

import math
import os

import duckdb
import pytest

from lectern.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    found = QUERIES[name](spark, SF)
    names = sorted(found.columns)
    mine = sorted(str([plain(r[n]) for n in names]) for r in found.collect())
    other = duck.sql(ORACLES[name])
    assert sorted(other.columns) == names
    at = [other.columns.index(n) for n in names]
    assert mine == sorted(str([plain(r[k]) for k in at]) for r in other.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert len(QUERIES[name](spark, SF).take(1)) == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
