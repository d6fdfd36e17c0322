"""Every core query against its SQL on the smallest tables."""

import pytest

from gridloom import queries
from tests.compare import DATA, connect, from_spark, from_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert from_spark(queries.QUERIES[name](spark, DATA)) == from_sql(connect(), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).schema.names == ["i0", "i1", "v"]
