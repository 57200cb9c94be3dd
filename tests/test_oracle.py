"""Every query with an SQL twin gives the same whole result as the twin."""

import pytest
from compare import differences, open_tables

import __spark_entry__ as entry
from ligatable.plans import catalog, oracle

SQL = oracle.all_sql()
QUERIES = catalog.all_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return open_tables(sf_dir)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
