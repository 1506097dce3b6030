"""Registered corpus queries against their oracles, or for whole results where there is none."""

import pytest

from brightloom.llm import queries
from oracle_check import compare, oracle_connection


@pytest.fixture(scope="module")
def con(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, con, name):
    ok, message, _ = compare(spark, con, small, name, queries.QUERIES[name], queries.ORACLES.get(name), close=True)
    assert ok, message


def test_every_operator_is_registered_once():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
