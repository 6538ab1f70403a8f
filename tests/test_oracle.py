"""Every registered query equals its SQL on the test tables."""

import oracle
import pytest
from conftest import SF_MEDIUM, SF_SMALL

import __spark_entry__ as entry
from querybook import book

# Empty on the smallest tables, which have a vector for every document.
NEEDS_MORE_ROWS = {"index_missing_vectors"}


@pytest.fixture(scope="module")
def connections():
    return {path: oracle.connect(path) for path in (SF_SMALL, SF_MEDIUM)}


@pytest.mark.parametrize("name", list(book()))
def test_query_equals_sql(spark, connections, name):
    path = SF_MEDIUM if name in NEEDS_MORE_ROWS else SF_SMALL
    assert oracle.compare(spark, path, name, connections[path]) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
