"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.compare import compare, duckdb_views
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duckdb_views(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    query, sql = QUERIES[name], ORACLE[name]
    assert compare(spark, connection, name, query, sql, SF) is None


def test_entry_has_rows(spark, connection):
    expected = len(connection.execute(ORACLE["notifications"]).fetchall())
    assert contract.entry(spark).count() == expected > 0
