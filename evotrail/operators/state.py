"""The remembered deduplication keys as a table (``schemas.STATE``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail import fixed_values as fv
from evotrail.operators.dedup import drop_known
from evotrail.schemas import POSITION
from evotrail.staging import staged


def state_rows(sent: DataFrame) -> DataFrame:
    """State rows for sent events: one per key, with the event's position."""
    return sent.select("dedup_key", *POSITION)


def add_to_state(state: DataFrame, sent: DataFrame) -> DataFrame:
    """The state after a run; keys it already holds keep their first position."""
    return state.unionByName(drop_known(state_rows(sent), state))


def kept_after_pruning(keys: int, max_keys: int, share: float = fv.PRUNE_SHARE) -> int:
    """How many keys remain when ``keys`` arrive one by one.

    Whenever a key arrives at a full state, the oldest ``share`` of the limit
    leaves first, so the size swings between the limit and that share below it.
    """
    if keys <= max_keys:
        return keys
    dropped = int(max_keys * share)
    if dropped == 0:
        return keys
    return max_keys - dropped + 1 + (keys - max_keys - 1) % dropped


def drop_old(state: DataFrame, ttl_days: int) -> DataFrame:
    """Without the keys first seen more than ``ttl_days`` before the newest one.

    Keys without a time came from outside the log and stay.
    """
    newest = state.agg(F.max("timestamp").alias("_newest"))
    age = F.expr(f"_newest - INTERVAL {int(ttl_days)} DAYS")
    kept = F.col("timestamp").isNull() | (F.col("timestamp") >= age)
    return state.join(F.broadcast(newest)).filter(kept).drop("_newest")


def prune_state(
    state: DataFrame, max_keys: int, share: float = fv.PRUNE_SHARE
) -> DataFrame:
    """The newest keys that fit the limit, oldest ones dropped.

    The rows are range-partitioned from new to old and stored. Row counts per
    partition then tell which partitions are kept as a whole and how many rows
    of the next one, so no task sorts more than its own range.
    """
    # Keys without a position are told apart by a hash, so that they fill many ranges.
    newest_first = [*[F.desc_nulls_last(name) for name in POSITION], F.xxhash64("dedup_key")]
    ranges = staged(
        state.repartitionByRange(*newest_first).withColumn("_range", F.spark_partition_id())
    )
    sizes = ranges.groupBy("_range").count().orderBy("_range").collect()
    keep = kept_after_pruning(sum(rows for _, rows in sizes), max_keys, share)
    whole, rest = [], None
    for number, rows in sizes:
        if rows > keep:
            rest = ranges.filter(F.col("_range") == number).orderBy(*newest_first).limit(keep)
            break
        whole.append(number)
        keep -= rows
    kept = ranges.filter(F.col("_range").isin(whole))
    return (kept if rest is None else kept.unionByName(rest)).drop("_range")
