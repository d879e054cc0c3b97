from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evotrail.operators import key_filters as kf
from evotrail.schemas import STATE
from evotrail.sources import state_files

BUCKETS = 8


def keys(spark, *ranges):
    found = [f"subject-{i}:m:{i % 7}" for r in ranges for i in r]
    return spark.createDataFrame([(key,) for key in found], "dedup_key string")


def test_admits_every_key_and_few_others(spark):
    known = keys(spark, range(6000))
    blocks = kf.blocks_for(6000, 2)
    filters = kf.key_filter(known, "dedup_key", 2, blocks)
    assert {(r.bucket, r.block) for r in filters.collect()} == {(0, 0), (1, 0)}
    assert kf.may_hold(known.union(known), "dedup_key", filters, 2, blocks).count() == 6000
    others = keys(spark, range(10_000, 20_000)).union(spark.sql("SELECT CAST(null AS string)"))
    assert kf.may_hold(others, "dedup_key", filters, 2, blocks).count() < 300


def test_merged_filters_admit_both_key_sets(spark):
    one, two = keys(spark, range(500)), keys(spark, range(500, 900))
    parts = [kf.key_filter(part, "dedup_key", 4, 3) for part in (one, two)]
    both = kf.merged(parts[0].union(parts[1]))
    whole = kf.key_filter(one.union(two), "dedup_key", 4, 3)
    assert sorted(both.collect()) == sorted(whole.collect())


def test_buckets_are_those_of_bucketed_tables(spark, tmp_path):
    state_files.seed(keys(spark, range(300)), str(tmp_path), BUCKETS)
    base, _ = state_files.load(spark, str(tmp_path), 0, 50, BUCKETS)
    placed = base.select(F.input_file_name().alias("file"), kf.bucket_of("dedup_key", BUCKETS).alias("b"))
    assert all(state_files._bucket_number(r.file) == r.b for r in placed.distinct().collect())


@pytest.mark.parametrize("opened", [0, 1, 3])
def test_a_batch_opens_the_buckets_of_its_keys(spark, tmp_path, opened):
    path = str(tmp_path)
    known = keys(spark, range(400))
    state_files.seed(known, path, BUCKETS)
    by_bucket = known.select("dedup_key", kf.bucket_of("dedup_key", BUCKETS).alias("b"))
    batch = by_bucket.where(F.col("b") < opened).select("dedup_key")
    base, added = state_files.load(spark, path, 0, 50, BUCKETS, batch)
    assert len(base.inputFiles()) == opened
    assert base.join(batch, "dedup_key").count() == batch.count()
    assert added.count() == 0 and base.columns == STATE.names


def test_large_batches_and_old_folders_read_the_base_in_place(spark, tmp_path):
    path, known = str(tmp_path), keys(spark, range(400))
    old = state_files._base_path(path, 0, BUCKETS)
    state_files._write_buckets(spark.createDataFrame([("k", None, 0, 1)], STATE), old, BUCKETS)
    assert state_files.buckets_met(spark, path, 0, BUCKETS, known) is None
    assert state_files.load(spark, path, 0, 50, BUCKETS, known)[0].count() == 1
    state_files.seed(known, path, BUCKETS)
    whole, _ = state_files.load(spark, path, 0, 50, BUCKETS, known)
    assert len(whole.inputFiles()) == BUCKETS and whole.count() == 400


def test_an_empty_base_opens_nothing(spark, tmp_path):
    state_files.seed(keys(spark), str(tmp_path), BUCKETS)
    base, _ = state_files.load(spark, str(tmp_path), 0, 50, BUCKETS, keys(spark, range(5)))
    assert base.count() == 0
    assert state_files.load(spark, str(tmp_path / "new"), 0, 50, BUCKETS, keys(spark))[0].count() == 0
