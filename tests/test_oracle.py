"""Every registered query with SQL, compared on the smallest tables."""

import os

import pytest

import oracle
from amrspark.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    assert oracle.compare(catalog.QUERIES[name](spark, SF_DIR), con, catalog.SQL[name]) == ""


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
