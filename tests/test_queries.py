"""Every query with SQL gives its rows; the others run."""

import pytest

import __spark_entry__ as entry
from lithoscan.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, same_as_sql, name):
    df = registry.QUERIES[name](spark, sf_dir)
    sql = registry.ORACLE_SQL.get(name)
    if sql:
        same_as_sql(df, sql)
    else:
        assert df.collect() is not None


def test_only_the_greedy_tree_has_no_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"tree_budgeted"}


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0].rank == 1


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
