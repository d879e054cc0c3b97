from __future__ import annotations

import math

import numpy as np
import pytest

from evotrail.llm import vector_join
from evotrail.llm.batches import table
from evotrail.llm.vector_join import link_vectors
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, code long, links string"


def result(rows, threshold=0.95):
    found = link_vectors(rows, "vec_id", "embedding", threshold).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    return {r.vec_id: (r.n_links, r.component_id) for r in found}


def test_equals_brute_force_on_embeddings(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert result(rows) == brute.vectors([(r.vec_id, r.embedding) for r in rows.collect()], 0.95)


@pytest.mark.parametrize("threshold", [0.8, 0.95])
def test_dense_clusters(spark, threshold):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 12))
    rows = [
        (i, (centres[i % 6] + rng.normal(scale=0.05 * (1 + i % 9), size=12)).tolist())
        for i in range(700)
    ]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 700, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(frame, threshold) == brute.vectors(rows, threshold)


def test_unusable_vectors_link_with_nothing(spark):
    rows = [
        (1, None, 1, "a"), (2, [], 1, "a"), (3, [0.0, 0.0], 1, "a"), (4, [1.0, None], 1, "a"),
        (5, [1.0, math.nan], 1, "a"), (6, [math.inf, 1.0], 1, "a"), (7, [1.0, 2.0], None, None),
        (8, [2.0, 4.0], 1, "a"), (9, [1e300, 2e300], 1, "a"), (10, [1e-300, 2e-300], 1, "a"),
        (11, [1.0, 2.0, 0.0], 1, "a"), (12, [-1.0, -2.0], 1, "a"), (13, [1.0], 1, "a"),
    ]
    found = result(spark.createDataFrame(rows, SCHEMA))
    assert all(found[i] == (0, i) for i in (1, 2, 3, 4, 5, 6, 11, 12, 13))
    assert all(found[i] == (3, 7) for i in (7, 8, 9, 10))


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (None, [1.0, 0.0], 0, "")]
    found = link_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 0.95)
    assert sorted((r.n_links, r.component_id) for r in found.collect()) == [(2, 1)] * 3


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == {}


def test_distant_blocks_are_skipped():
    compared = []

    class Watched(vector_join.PairJoin):
        def compare(self, *place):
            compared.append(place)
            super().compare(*place)

    n = vector_join.BLOCK
    angles = np.linspace(0, 2 * np.pi, n)
    rows = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    side = {
        "block": 0, "length": 2, "codes": list(range(n)), "times": [1] * n, "vectors": rows.tobytes()
    }
    pair = Watched(side, side, 0.999, math.sqrt(0.002), {2: np.eye(2)})
    pair.join(0, n, 0, n)
    leaves = n // vector_join.LEAF
    assert len(compared) < leaves * (leaves + 1) / 2
    hits = rows @ rows.T >= 0.999
    assert (pair.sides[0][4] == hits.sum(axis=1) - 1).all()
