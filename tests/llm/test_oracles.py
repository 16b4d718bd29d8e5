"""Queries that SQL can say give the rows of their SQL."""

import pytest

from finloom.llm import queries

from ..compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) == []
