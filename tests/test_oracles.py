"""Every registered query against its SQL, on the smallest tables."""

import pytest

from lodestone import registry
from tests.compare import database, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, sf, con):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == sql_rows(con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "score"]
