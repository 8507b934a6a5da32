"""Registered queries against their SQL on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
import oracles
import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES, oracles.ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, con):
    assert oracle.difference(QUERIES[name], SQL[name], spark, con, SF) is None


def test_entry_registers_all():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
