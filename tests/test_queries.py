"""Every registered query beside its SQL, on the smallest tables."""

import pytest
from compare import connection, differences

import __spark_entry__ as entry
from quillmere import plans, registry

plans.load()
CORE = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        assert differences(con, df, registry.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
