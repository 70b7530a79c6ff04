"""Every catalogue query against its SQL, and the entry point."""

import os

import pytest

import __spark_entry__ as entry_point
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.all_queries(), entry_point.all_oracles()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    assert compare(spark, tables, name, QUERIES[name], SQL[name], SF) is None


def test_entry(spark):
    row = entry_point.entry(spark).first()
    assert row.ingested == 1500 == row.stored + row.type_mismatches
