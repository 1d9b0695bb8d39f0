"""Every registered query with SQL must equal it on the smallest tables."""

import os

import pytest

from oracle import compare, connect
from redline import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalogue.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    ok, message = compare(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    assert not catalogue.QUERIES[name](spark, SF).isEmpty()
