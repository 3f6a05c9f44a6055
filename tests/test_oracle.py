"""Every registered query against its DuckDB twin on sf0.001 (the driver
does the same at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck
from tickwise.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)  # the optional subpackage tests its own


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(E.oracle_sql())
    assert not missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["status"] == "match", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["symbol", "date"]
    assert df.count() > 0
