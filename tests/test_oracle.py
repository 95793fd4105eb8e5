"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from scorelake.plans.registry import QUERIES
from conftest import SMALL
from oracle import compare, connect

# checked against brute force in the other test files instead
WITHOUT_SQL = {
    "coherence", "overall_score", "fuzzy_accuracy", "ann_cells", "ann_hyperplanes", "prompt_contexts",
}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    state, _, detail = compare(spark, con, SMALL, queries()[name], oracle_sql().get(name))
    assert state in ("match", "rows-only"), detail


def test_only_listed_queries_lack_sql():
    assert set(QUERIES) - set(oracle_sql()) == WITHOUT_SQL and set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
