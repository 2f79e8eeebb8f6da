"""Every registered query against its SQL on the smallest tables."""

import pytest

from symlake.plans.registry import load
from tests.oracle import compare, connect

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf, con):
    ok, message = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert ok, message


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["container", "entry_path", "key", "n_entries", "position"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
