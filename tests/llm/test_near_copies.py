from __future__ import annotations

import random

import pytest

from evotrail.llm import near_copies, stages
from evotrail.llm.batches import table
from evotrail.llm.near_copies import copy_groups
from tests.llm import brute


def shingles(text):
    words = (text or "").encode().lower().split()
    span = min(5, len(words))
    return {tuple(words[at : at + span]) for at in range(len(words) - span + 1)} if words else set()


def similar(a, b):
    return (not a and not b) or len(a & b) >= 0.8 * len(a | b)


def expected(rows):
    """Ids kept of (id, text) rows, ids rising: the first of each group."""
    sets = [shingles(text) for _, text in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i + 1, len(rows))
        if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))
        and similar(sets[i], sets[j])
    ]
    return {rows[root][0] for root in brute.components(len(rows), links)}


def test_stage_drops_all_pairs_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = stages.drop_near_copies(spark, docs, "")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    found = {r.doc_id for r in kept.collect()}
    assert found == expected(rows)
    # Pairs at 3 to 10 bits, similar to 0.8 or more.
    for pair in ((643, 770), (2, 56), (1, 255), (582, 875), (709, 944)):
        assert not found.issuperset(pair)


@pytest.mark.parametrize("pair_limit", [2, 24])
def test_crowded_buckets_lose_no_pair(spark, pair_limit):
    rng = random.Random(5)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(80)]
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(80), rng.randint(0, 4)):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = copy_groups(frame, "text", 5, 2, pair_limit=pair_limit)
    nodes = groups.count()
    roots = groups.select("root").distinct().count()
    distinct = len({text for _, text in rows})
    assert distinct - nodes + roots == len(expected(list({t: (k, t) for k, t in rows[::-1]}.values())))


@pytest.fixture
def pairs_compared(monkeypatch):
    """How many pairs each step verifies."""
    found, verify = [], near_copies.similar_pairs

    def counted(pairs, sets, similar):
        found.append(pairs.count())
        return verify(pairs, sets, similar)

    monkeypatch.setattr(near_copies, "similar_pairs", counted)
    return found


def test_texts_around_one_long_passage_are_not_paired(spark, pairs_compared):
    passage = [f"p{i}" for i in range(104)]
    totals = []
    for n in (150, 600):
        texts = [" ".join(passage + [f"x{k}w{i}" for i in range(24)]) for k in range(n)]
        frame = spark.createDataFrame([(text,) for text in texts], "text string")
        assert copy_groups(frame, "text", 5, 2).count() == 0
        totals.append(sum(pairs_compared))
        pairs_compared.clear()
    # All pairs would be 16 times as many; bands and pivots grow with the texts.
    assert totals[1] < 50 * 600 and totals[1] < 8 * totals[0]


def test_a_large_loose_group_is_searched_exactly(spark, pairs_compared):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 3, 4, 5])):
            words[at] = rng.choice(["x", "y", f"z{k}"])
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = copy_groups(frame, "text", 5, 2, pair_limit=4)
    nodes, roots = groups.count(), groups.select("root").distinct().count()
    distinct = list({t: (k, t) for k, t in rows[::-1]}.values())
    assert len(distinct) - nodes + roots == len(expected(sorted(distinct)))
    assert sum(pairs_compared) < len(distinct) * (len(distinct) - 1) / 2


def test_prefixes_and_parities_lose_no_similar_pair(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(300):
        a = rng.integers(0, 1 << 40, rng.integers(1, 60)).astype(np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], a[:3] + np.uint64(1)]))
        a = np.unique(a)
        differing = np.setxor1d(a, b).size
        bits = near_copies.parity_bits(a) ^ near_copies.parity_bits(b)
        assert np.bitwise_count(bits.view(np.uint64)).sum() <= differing


def test_odd_texts_and_columns(spark):
    rows = [(None, 1), ("", 1), (" ", 1), ("\t", 1), ("one word", 1), ("one word", 1), ("w " * 90_000, 1)]
    frame = spark.createDataFrame(rows, "text string, node int").selectExpr("*", "1 AS bucket", "2 AS grams")
    groups = copy_groups(frame, "text", 5, 2).collect()
    assert len({r.root for r in groups}) == 1 and len(groups) == 3
    assert copy_groups(frame.limit(0), "text", 5, 2).collect() == []
