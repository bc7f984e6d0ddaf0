"""Queries of the text package that SQL can express, against DuckDB."""

import pytest
from compare import duck, same

from compindex.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert same(spark, duck(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir).startswith("ok")
