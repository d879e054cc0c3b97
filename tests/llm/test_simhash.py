from __future__ import annotations

import random

import pytest

from evotrail.llm import simhash
from evotrail.llm.batches import table
from evotrail.llm.components import connected_components
from tests.llm import brute

SCHEMA = "doc_id long, text string, fp string, component_id int"


def result(rows, **more):
    found = simhash.near_duplicates(rows, "doc_id", "text", **more).collect()
    return {r.doc_id: (r.fingerprint, r.component_id) for r in found}


@pytest.mark.parametrize("pair_limit", [simhash.PAIR_LIMIT, 2])
def test_equals_brute_force_on_documents(spark, pair_limit):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(documents, pair_limit=pair_limit) == brute.simhash(rows)


@pytest.mark.parametrize("pair_limit", [1000, 3])
def test_dense_neighbourhood_links_exactly(spark, pair_limit):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    ordered = sorted(v - (v >> 63 << 64) for v in values)
    classes = spark.createDataFrame([(v,) for v in ordered], "fp long")
    links = simhash.fingerprint_links(classes, 2, pair_limit)
    found = dict(connected_components(links).collect())
    pairs = [
        (i, j)
        for i in range(len(ordered))
        for j in range(i + 1, len(ordered))
        if ((ordered[i] ^ ordered[j]) & (2**64 - 1)).bit_count() <= 2
    ]
    roots = brute.components(len(ordered), pairs)
    assert [found.get(v, v) for v in ordered] == [ordered[r] for r in roots]


def test_chain_budgets_never_lose_a_pair(spark):
    rng = random.Random(3)
    rows = [sum(1 << b for b in rng.sample(range(64), n)) for n in (0, 1, 2) for _ in range(200)]
    rows = spark.createDataFrame([(v - (v >> 63 << 64),) for v in rows], "d long")
    assert rows.where(simhash.chain_holds(rows["d"], 2)).count() == 600


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [
        (1, None, "x", 9), (2, "", "x", 9), (3, " \n", "x", 9), (4, "one two", None, None),
        (5, "ONE  two", "x", 9), (6, "one two three four " * 3000, "x", 9), (7, "alone here now", "x", 9),
        (7, "alone here now", "x", 9), (None, "one two", "x", 9),
    ]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found) == [
        (0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7),
    ]
    assert {r.fingerprint for r in found if r.doc_id in (1, 2, 3)} == {"0" * 16}


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == {}
