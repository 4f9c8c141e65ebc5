"""Every registered query against its DuckDB twin, on whole tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, data):
    problem, _ = compare(spark, con, QUERIES[name], ORACLES.get(name), data)
    assert not problem, problem
