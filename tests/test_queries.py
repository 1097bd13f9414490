"""Every registered query against its SQL on the smallest sample."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
