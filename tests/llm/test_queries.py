"""Registered queries against their SQL, and the driver's view of them."""

import pytest

from lodestone.llm import queries
from tests.compare import database, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(database(sf), queries.ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
