"""Every registered query against its SQL check on the smallest data."""

import pytest
from oracle_check import compare, database

from tallymark.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, connection, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    if name in registry.CHECKS:
        assert compare(frame, connection, registry.CHECKS[name]) == []
    else:
        assert frame.count() > 0


def test_checks_belong_to_queries():
    assert set(registry.CHECKS) <= set(registry.QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 3
    assert queries().keys() >= oracle_sql().keys()
