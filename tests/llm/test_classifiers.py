from __future__ import annotations

import random
import zlib
from dataclasses import replace

import numpy as np
import pytest

from evotrail.llm import quality, toxicity
from evotrail.llm.batches import table
from evotrail.llm.queries import op6_toxicity, op7_quality

FOLDER = "/root/testdata/sf0.1"


def held_out(key) -> bool:
    return zlib.crc32(str(key).encode()) % 5 == 0


def quality_of(rows, labels, threshold):
    """(accuracy on both classes' mean, Brier score) over the held-out rows."""
    some = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) in (0, 1)]
    sides = [
        np.mean([(score >= threshold) == side for score, label in some if label == side])
        for side in (0, 1)
    ]
    return np.mean(sides), np.mean([(score - label) ** 2 for score, label in some])


@pytest.mark.parametrize(
    ("query", "label", "threshold"), [(op6_toxicity, "toxic", 0.5), (op7_quality, "quality", 0.3)]
)
def test_held_out_rows(spark, query, label, threshold):
    rows = query(spark, FOLDER).collect()
    labels = {r.doc_id: r[label] for r in table(spark, FOLDER, "labels").collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= threshold) for r in rows)
    balanced, brier = quality_of(rows, labels, threshold)
    print(label, balanced, brier)
    assert balanced > 0.95 and brier < 0.05


def test_nearest_is_exact():
    rng = random.Random(3)
    examples = [
        (k, k % 2, {t: rng.randint(1, 9) for t in rng.sample(range(200), rng.randint(0, 30))})
        for k in range(700)
    ]
    index = toxicity.build(
        [f"t{i}" for i in range(200)], np.arange(200.0), 1000, examples, (1.0, 1.0)
    )
    dense = np.zeros((700, 200))
    for row, key in enumerate(index.keys):
        terms, weights = toxicity.vector(examples[key][2], index.idf)
        dense[row, terms] = weights
    for _ in range(100):
        query = {t: rng.randint(1, 9) for t in rng.sample(range(200), rng.randint(1, 40))}
        terms, weights = toxicity.vector(query, index.idf)
        cosines = dense[:, terms] @ weights
        best = np.lexsort((np.arange(700), -cosines.round(12)))[: toxicity.NEAREST]
        numbers, found = index.nearest(query)
        assert np.allclose(found, cosines[best])
        assert (np.diff(found) <= 1e-12).all() and np.allclose(cosines[numbers], found)


def test_alike_examples_share_blocks_and_most_blocks_are_skipped():
    rng = random.Random(4)
    # 40 topics of 25 terms, 50 examples each, in mixed order.
    examples = [
        (k, k % 2, {25 * (k % 40) + t: 1 for t in rng.sample(range(25), 8)}) for k in range(2_000)
    ]
    index = toxicity.build(
        [f"t{i}" for i in range(1_000)], np.full(1_000, 5.0), 9_000, examples, (1.0, 1.0)
    )
    assert sorted(index.keys) == list(range(2_000))
    topics = [{index.keys[n] % 40 for n in range(b, b + 16)} for b in range(0, 2_000, 16)]
    assert np.mean([len(t) for t in topics]) < 4
    met = [(index.largest[25 * topic : 25 * topic + 25].max(0) > 0).mean() for topic in range(40)]
    assert np.mean(met) < 0.2


def test_postings_are_read_as_whole_tiles_in_bounded_looks():
    rng = random.Random(5)
    examples = [
        (k, k % 2, {t: rng.randint(1, 9) for t in rng.sample(range(400), 40)}) for k in range(1_500)
    ]
    index = toxicity.build(
        [f"t{i}" for i in range(400)], np.full(400, 5.0), 9_000, examples, (1.0, 1.0)
    )
    assert np.count_nonzero(index.tiles) == 1_500 * 40 and not index.tiles[0].any()
    looks = []

    class Tiles:
        def take(self, numbers, axis):
            looks.append(numbers.size)
            return index.tiles.take(numbers, axis)

    query = dict.fromkeys(range(400), 1)
    numbers, cosines = replace(index, tiles=Tiles()).nearest(query)
    # A query of every term and equal weights: no bound can skip many blocks.
    assert len(looks) > 2 and max(looks) <= toxicity.MOST_TILES < 400 * 94
    _, weights = toxicity.vector(query, index.idf)
    exact = np.array([
        weights[at] @ of
        for at, of in (toxicity.vector(examples[key][2], index.idf) for key in index.keys)
    ])
    best = np.lexsort((np.arange(1_500), -exact.round(12)))[: toxicity.NEAREST]
    assert np.allclose(cosines, exact[best]) and np.allclose(exact[numbers], cosines)


def test_rising_map_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    votes, weights = rng.random(500).round(2), rng.random(500) + 0.1
    labels = (rng.random(500) < votes).astype(int)
    limits, chances = toxicity.rising(votes, labels, weights)
    assert (np.diff(limits) > 0).all() and (np.diff(chances) > 0).all()
    mapped = chances[np.searchsorted(limits, votes, side="right") - 1]
    assert np.isclose((mapped * weights).sum(), (labels * weights).sum())


def test_trees_traverse_as_single_walks():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(800, 6))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    trees = quality.grow(rows, labels)
    found = trees.scores(rows)
    for row, score in zip(rows[:50], found):
        margin = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            margin += value[node]
        assert np.isclose(score, 1 / (1 + np.exp(-margin)))
    assert ((found > 0.5) == labels).mean() > 0.97


ROWS = [
    (1, None, "x"), (2, "", "x"), (None, "some text", "x"), (4, "tie of words", "x"),
    (5, "tie of words", "x"), (6, "long " * 200_000, "x"), (7, "\n \t", "x"),
]


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_odd_texts_and_labels(spark, score):
    documents = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    labels = [(k, k % 2, "y") for k in range(1, 6)] + [(6, None, "y"), (None, 1, "y"), (9, 1, "y")]
    for some in (labels, labels[1:2], []):
        frame = spark.createDataFrame(some, "doc_id long, toxic int, held_out string")
        rows = score(documents, frame, "doc_id", "text", "toxic", 0.5).collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
        scores = {r.doc_id: r.score for r in rows}
        assert scores[4] == scores[5] and scores[1] == scores[2]
        assert not next(r for r in rows if r.doc_id is None).held_out
    nothing = score(documents.where("false"), frame, "doc_id", "text", "toxic", 0.5)
    assert nothing.collect() == []


def test_weak_and_rare_terms_are_kept_at_any_sample_size(spark):
    rows = [(1, [f"t{i:03}" for i in range(300)])] * 4 + [(0, ["other"])] * 4
    sample = spark.createDataFrame(rows, "label_ int, terms array<string>")
    kept = toxicity.telling_terms(sample, 3_000, 3_000, toxicity.MAX_TERMS)
    assert len(kept) == 301
