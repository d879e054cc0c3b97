"""Queries beside their SQL, as the driver compares them."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.compare import compare, duckdb_views
from evotrail.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, duckdb_views(folder), name, QUERIES[name], ORACLE[name], folder) is None


def test_every_operator_is_registered():
    names = {name.split("_")[0] for name in contract.queries()}
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= names
    assert set(ORACLE) <= set(contract.oracle_sql())
