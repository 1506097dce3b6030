"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from brightloom.plans import registry
from oracle_check import compare, oracle_connection

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle_connection(small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    ok, message, _ = compare(spark, con, small, name, QUERIES[name], ORACLES.get(name), close=True)
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert entry.queries().keys() >= entry.oracle_sql().keys()
