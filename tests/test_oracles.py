"""Every registered query against its SQL on the smallest files."""

import pytest
from oracle import compare, connect

from sensorquery.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    cursor = duck.execute(SQL[name])
    problem = compare(df.columns, rows, [d[0] for d in cursor.description], cursor.fetchall())
    assert problem == ""


def test_every_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) / len(QUERIES) > 0.95


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.columns == [
        "thing_id", "thing", "datastream_id", "rn", "id", "at", "result_number", "total", "more"
    ]
    assert df.count() > 0
