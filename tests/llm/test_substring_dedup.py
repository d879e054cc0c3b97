from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evotrail.llm import substring_dedup
from evotrail.llm.batches import table
from evotrail.llm.substring_dedup import remove_repeats
from tests.llm import brute


def result(rows, window):
    found = remove_repeats(rows, "doc_id", "text", window).select(
        "doc.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)
    )
    return sorted((tuple(r) for r in found.collect()), key=str)


def expected(rows, window):
    pairs = [(r["doc_id"], r["text"]) for r in rows.collect()]
    return sorted(brute.substring(pairs, window), key=str)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_equals_brute_force_on_documents(spark, folder):
    documents = table(spark, f"/root/testdata/{folder}", "documents")
    assert result(documents, 35) == expected(documents, 35)


@pytest.mark.parametrize("window", [2, 5, 8])
def test_equals_brute_force_on_few_words(spark, window):
    rng = random.Random(window)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 40))) for _ in range(30)]
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 200))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(rows, window) == expected(rows, window)


def test_parts_hold_every_window_once(monkeypatch):
    import numpy as np

    monkeypatch.setattr(substring_dedup, "PART", 16)
    codes = np.arange(100)
    found = [
        tuple(part[i : i + 5])
        for _, part in substring_dedup.parts_of(codes, 5)
        for i in range(len(part) - 4)
    ]
    assert found == [tuple(range(i, i + 5)) for i in range(96)]


def test_nulls_repeated_rows_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    passage = " ".join(f"p{i}" for i in range(10))
    rows = [
        (1, None, 1, "a"), (2, "", 1, "a"), (3, passage, 2, "b"), (3, passage, 2, "b"),
        (None, passage + " tail", 2, "b"), (None, None, None, None), (4, long, 2, "b"),
        (5, "x " + long + " y", 2, "b"), (6, "la " * 30, 1, "c"), (3, "other text", 0, "d"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, who_ int, doc string")
    assert result(frame, 8) == expected(frame, 8)


def test_passage_shared_by_most_documents(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for number in range(200):
        own = [f"o{number}_{i}" for i in range(rng.randint(0, 30))]
        cut = rng.randint(20, 60) if number % 2 else 60
        texts.append(" ".join(own + passage[:cut] + own[:5]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(rows, 35) == expected(rows, 35)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string"), 35) == []
