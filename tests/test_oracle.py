"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from oracle.sql import ORACLE
from pageledger.plans.registered import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    assert difference(QUERIES[name](spark, FOLDER), tables, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["site", "total_pages"]
