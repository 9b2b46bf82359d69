"""Queries of the subpackage against their SQL twins."""

import pytest
from twins import SF, compare

from fleetloom.llm import queries


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name], SF)
