"""Differential test: every registered query against its DuckDB oracle at sf0.001,
and the driver contract of ``__spark_entry__``."""

import pytest

import __spark_entry__ as ent
from pitchside.plans.oracle import oracle_queries
from pitchside.plans.registry import registry
from pitchside.verify import compare, duckdb_connection

from .conftest import SF001

QUERIES = registry()
ORACLES = oracle_queries()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF001)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(ent.queries())
    assert set(ent.oracle_sql()) <= set(ent.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    r = compare(spark, SF001, name, QUERIES[name], ORACLES[name], con)
    assert r["status"] == "match", r


def test_entry(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert "points_over_expected_per_game" in df.columns
