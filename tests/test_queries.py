"""Registered queries: the driver contract and Spark-vs-DuckDB agreement on sf0.001."""
import pytest

import __spark_entry__ as E
from compare import compare, duck
from conftest import SF_SMALL
from sitemill.plans.catalog import ORACLES, QUERIES


def test_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 35


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[0] == "page_id" and df.count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    info = compare(spark, SF_SMALL, name, E.queries()[name], ORACLES[name], con)
    assert info["ok"] and info["duck_rows"] > 0, info


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0
