"""Every catalog query against its SQL, and none of them empty."""

import pytest

from shelfmark.plans import cases, queries
from tests.oracle import connect, spark_rows, sql_rows

QUERIES, ORACLES = queries.QUERIES | cases.QUERIES, queries.ORACLES | cases.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    found = spark_rows(QUERIES[name](spark, sf))
    assert found[1]
    if name in ORACLES:
        assert found == sql_rows(connect(sf), ORACLES[name])


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries()) and len(QUERIES) == len(queries.QUERIES) + len(cases.QUERIES)
    assert set(QUERIES) == set(ORACLES)
