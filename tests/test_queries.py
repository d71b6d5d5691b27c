"""Every core query against its SQL; those without SQL must run."""

import oracle
import pytest

from quillspark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, name):
    assert oracle.compare(spark, QUERIES[name], SQL[name], data) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
