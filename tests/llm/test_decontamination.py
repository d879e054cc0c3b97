from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evotrail.llm import decontamination as d
from evotrail.llm.batches import table
from tests.llm import brute


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def result(documents, benchmark, **more):
    found = d.overlaps(documents, "doc_id", "text", benchmark, "item_id", "text", **more)
    return {
        (r.doc_id, r.item_id): (r.windows, r.covered_words, r.equal_words) for r in found.collect()
    }


def expected(documents, items):
    found = {}
    for key, text in documents:
        for item, item_text in items:
            best = brute.overlap(words(text), words(item_text), d.WINDOW, d.SUBSTITUTIONS)
            if best:
                found[key, item] = best
    return found


def test_masks_miss_no_choice_of_substitutions():
    for gone in combinations(range(d.WINDOW), d.SUBSTITUTIONS):
        assert any(
            not any(shift + place in gone for place in mask)
            for mask in d.MASKS
            for shift in range(d.WINDOW - d.SPAN + 1)
        ), gone
    assert all(max(mask) == d.SPAN - 1 for mask in d.MASKS)


@pytest.mark.parametrize("seed_limit", [d.SEED_LIMIT, 40])
def test_equals_brute_force_with_substitutions(spark, seed_limit):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 30)))) for i in range(12)]
    items.append((50, items[3][1].upper()))
    documents = []
    for number in range(60):
        own = rng.choices(vocabulary, k=rng.randint(0, 30))
        part = items[rng.randrange(12)][1].split()
        for at in rng.sample(range(len(part)), rng.randint(0, 4)):
            part[at] = "changed"
        documents.append((number, ", ".join(own + part + own[:3])))
    frames = (
        spark.createDataFrame(documents, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    found = result(*frames, seed_limit=seed_limit)
    assert found == expected(documents, items[:12])
    assert len(found) > 20


def test_whole_benchmark_passages_are_found(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    benchmark = table(spark, "/root/testdata/sf0.001", "benchmark")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    found = result(documents, benchmark)
    for key, text in rows:
        for item, item_text in items:
            if len(words(item_text)) >= d.WINDOW and item_text in text:
                assert (key, item) in found


def test_members_of_item_classes(spark):
    rows = [(3, "A b"), (1, "a, B"), (2, "c"), (4, None), (5, "")]
    found = d.item_classes(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    item = " ".join(f"b{i}" for i in range(15))
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [
        (1, None, "k", "l"), (2, "", "k", "l"), (3, long + " " + item, "k", "l"), (3, item, "k", "l"),
        (None, item, "k", "l"), (4, item, "k", "l"), (4, item, "k", "l"), (5, "clean", None, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, leak_ string, item_id string")
    benchmark = spark.createDataFrame(
        [(7, item, 1), (8, None, 1), (9, "", 1), (None, "short item", 1)],
        "item_id long, text string, doc_id int",
    )
    found = result(frame, benchmark)
    assert found == {(key, 7): (3, 15, 15) for key in (None, 3, 4)}
    kept = d.without_overlaps(frame, "doc_id", "text", benchmark, "item_id", "text")
    assert kept.columns == frame.columns
    # The row without an id holds the item too, and goes.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5"]
    nothing = spark.createDataFrame([], benchmark.schema)
    assert result(frame, nothing) == {}
    assert result(frame.where(F.lit(False)), benchmark) == {}


def test_main_path_is_native(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    benchmark = table(spark, "/root/testdata/sf0.001", "benchmark")
    plan = d.overlaps(documents, "doc_id", "text", benchmark, "item_id", "text")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", text)


def test_items_without_an_id_are_found(spark):
    passages = [" ".join(f"{name}{i}" for i in range(15)) for name in "abc"]
    benchmark = spark.createDataFrame(
        [(None, passages[0]), (None, passages[1]), (7, passages[2])], "item_id long, text string"
    )
    documents = spark.createDataFrame(
        [(1, passages[0]), (2, " ".join(passages)), (3, "clean")], "doc_id long, text string"
    )
    found = d.overlaps(documents, "doc_id", "text", benchmark, "item_id", "text").collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in found) == [
        (1, "None"), (2, "7"), (2, "None"), (2, "None"),
    ]
    kept = d.without_overlaps(documents, "doc_id", "text", benchmark, "item_id", "text")
    assert [r.doc_id for r in kept.collect()] == [3]
