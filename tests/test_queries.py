"""Every registered query of the engine against its SQL twin, and an entry point without the optional parts."""

import pytest

from tests.compare import duck, same
from tidemark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["path", "state", "direction"] and df.count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())
