from __future__ import annotations

import re

import pytest

from evotrail.functions.globs import glob_regex
from evotrail.operators import filter_table as ft
from tests.events import plan_text

FILTERS = (
    "users-1", "users-*", "*-key", "a.b*", "*mid*", "*x*", "*", "u[0-9]*", "ab?*", "", "**",
    "lo" * 30 + "*", "*" + "ng" * 30, "a*a", None, "é*",
)
SUBJECTS = (
    "users-1", "users-22", "my-key", "a.bc", "axbc", "amid", "mid", "mi", "x", "u7", "ac", "abc",
    "", "lo" * 30, "lo" * 29, "ng" * 31, "a", "aa", "aba", "two\nlines", "été", None,
)


def matched(spark, filters):
    table = spark.createDataFrame([(f,) for f in filters], "filter string")
    events = spark.createDataFrame([(s, i) for i, s in enumerate(SUBJECTS * 2)], "event_subject string, n int")
    return sorted(r.n for r in ft.in_filter_table(events, table).collect())


def expected(filters):
    def hit(name, subject):
        if "*" not in name:
            return name == subject
        return re.fullmatch(glob_regex(name), subject) is not None

    names = [f for f in filters if f is not None]
    return [
        i for i, s in enumerate(SUBJECTS * 2) if s is not None and any(hit(f, s) for f in names)
    ]


@pytest.mark.parametrize("part", [FILTERS[i::5] for i in range(5)] + [FILTERS, ()])
def test_equals_a_plain_loop(spark, part):
    assert matched(spark, part) == expected(part)


def test_patterns_are_filed_under_literal_text(spark):
    table = spark.createDataFrame([(f,) for f in FILTERS if f], "filter string")
    kinds = {r.regex: r.kind for r in ft.filter_index(table).collect()}
    assert kinds[r"\A(?:users-.*)\z"] == "first" and kinds[r"\A(?:.*-key)\z"] == "last"
    assert kinds[r"\A(?:.*mid.*)\z"] == "piece" and kinds[r"\A(?:ab?.*)\z"] == "any"


def test_ten_thousand_patterns_without_a_nested_loop(spark):
    filters = spark.range(10_000).selectExpr("concat(id, '-orders-*') AS filter")
    events = spark.range(3000).selectExpr("concat(id * 7, '-orders-', id) AS event_subject")
    found = ft.in_filter_table(events, filters)
    assert found.count() == 1429
    plan = plan_text(found, "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
