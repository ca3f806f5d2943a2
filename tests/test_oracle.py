"""Every registered query equals its DuckDB oracle on the driver tables."""

import pytest

import __spark_entry__ as entry
from shelfwise.plans import oracle, registry
from tests.compare import compare, duck_connection
from tests.conftest import SMALL_SF

QUERIES = registry.all_queries()
ORACLE = oracle.oracle_queries()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SMALL_SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SMALL_SF), con, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["medicine_name", "category", "manufacturer"]
    assert df.count() > 0
