"""All registered queries that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tallyroom import plans
from tallyroom.plans.proxies import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = duck.sql(plans.ORACLES[name])
    assert df.columns == got.columns
    assert rows(map(tuple, df.collect())) == rows(got.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
