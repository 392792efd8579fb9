"""Queries of the subpackage that SQL can express give what DuckDB gives."""

import pytest
from conftest import SF, rows_of

from loomlog.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLES[name]).df())
