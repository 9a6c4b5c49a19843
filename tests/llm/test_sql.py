"""Operators that SQL can express against their checks, and the list of queries."""

import re

import pytest
from oracle_check import compare, database

from tallymark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.CHECKS[name]) == []


def test_every_operator_is_registered():
    import corpus_pipeline
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered

    numbers = {m[1] for name in registered() if (m := re.match(r"op(\d+)_", name))}
    assert numbers == {str(n) for n in range(1, 14)} and "pipeline" in registered()
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in oracle_sql()
    assert len(corpus_pipeline.STAGES) == 5
