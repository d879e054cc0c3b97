from __future__ import annotations

import hashlib
import math
import zlib

import pytest

from evotrail.llm.batches import table
from evotrail.llm.sharding import assign_shards, in_order


def plain_shard(key, weights):
    best = None
    for shard, weight in enumerate(weights):
        digits = hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13]
        score = math.log((int(digits, 16) + 0.5) / 16**13) / weight
        if best is None or score > best[0]:
            best = (score, shard)
    return best[1]


@pytest.mark.parametrize("weights", [[1.0] * 40, [1.0, 2.0, 0.5, 4.0]])
def test_equals_plain_draws(spark, weights):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    found = {r.doc_id: r for r in assign_shards(documents, "doc_id", "text", weights).collect()}
    grown = [*weights, weights[-1]]
    for row in documents.collect():
        one, data = found[row.doc_id], row.text.encode()
        assert (one.size, one.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert one.shard == plain_shard(row.doc_id, weights)
        assert one.grown_shard == plain_shard(row.doc_id, grown)
        assert one.grown_shard in (one.shard, len(weights)) and one.law == "key"
    for shard in range(len(weights)):
        slots = sorted(r.slot for r in found.values() if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weights_decide_the_shares(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    counts = dict(
        assign_shards(rows, "doc_id", "text", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    )
    assert set(counts) == {0, 1} and abs(counts[1] / 20_000 - 0.75) < 0.02


def test_slots_do_not_depend_on_the_order_of_rows(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    one = assign_shards(documents, "doc_id", "text", [1.0] * 5)
    other = assign_shards(documents.repartition(7).orderBy("text"), "doc_id", "text", [1.0] * 5)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [(None, None, 1), (None, "a", 1), (1, "", 1), (2, "é", 1), (2, "é", 1), (3, "x" * 10**6, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    found = assign_shards(frame, "doc_id", "text", [1.0] * 3).collect()
    assert len(found) == 6
    sizes = sorted((r.doc_id or 0, r.size, r.text_crc32) for r in found)
    e = zlib.crc32("é".encode())
    assert sizes[:5] == [(0, 16, 0), (0, 17, zlib.crc32(b"a")), (1, 16, 0), (2, 18, e), (2, 18, e)]
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert assign_shards(frame.where("false"), "doc_id", "text", [1.0]).collect() == []


@pytest.mark.parametrize("weights", [[], [0.0], [1.0, -1.0]])
def test_bad_weights_are_refused(spark, weights):
    rows = spark.createDataFrame([(1, "")], "doc_id long, text string")
    with pytest.raises(ValueError):
        assign_shards(rows, "doc_id", "text", weights)


@pytest.mark.parametrize("text", ["'same'", "cast(id AS string)"])
def test_rows_of_one_key_are_numbered_in_parts(spark, text):
    rows = spark.range(20_000).selectExpr("7L AS doc_id", f"{text} AS text")
    found = assign_shards(rows, "doc_id", "text", [1.0] * 3)
    slots = found.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert len(slots) == 1 and slots[0]["max(slot)"] == 19_999
    assert found.select("slot").distinct().count() == 20_000
    keyed = rows.selectExpr(
        "1 AS shard", "md5('7') AS slot_order", "crc32(text) AS text_crc32", "9L AS size", "text"
    ).selectExpr("*", "monotonically_increasing_id() AS stored")
    parts = [r["count"] for r in in_order(keyed).groupBy("part").count().collect()]
    assert len(parts) > 1 and max(parts) < 10_000
