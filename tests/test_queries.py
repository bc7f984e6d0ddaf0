"""Every registered query against its SQL on the same tables."""

import os

import pytest

from compare import duck, same
from compindex.workload import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    result = same(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], sf_dir)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
