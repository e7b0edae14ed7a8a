"""Every registered query against its SQL in a second engine, on the smallest test tables."""

import os

import pytest

import __spark_entry__ as driver
from tests.conftest import DATA
from tools import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(DATA)


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    hits = driver.entry(spark)
    assert hits.count() > 0 and hits.columns == ["query_id", "doc_id", "score", "rank"]


@pytest.mark.parametrize("name", sorted(compare.QUERIES))
def test_query(spark, con, name):
    ok, message = compare.compare(spark, con, DATA, name)
    assert ok, message
