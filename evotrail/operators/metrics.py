"""Counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters in the order the run reports them.
COUNTERS = (
    "events_consumed",
    "events_processed",
    "notifications_produced",
    "duplicates_skipped",
)


def run_counters(consumed: Column, sent: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row with the counters.

    Every notification built is also produced: a failed write fails the job.
    """
    tagged = sent.select(F.lit(True).alias("is_sent")).unionByName(
        duplicates.select(F.lit(False).alias("is_sent"))
    )
    produced = F.count(F.when(F.col("is_sent"), 1))
    return tagged.agg(
        consumed.alias("events_consumed"),
        produced.alias("events_processed"),
        produced.alias("notifications_produced"),
        F.count(F.when(~F.col("is_sent"), 1)).alias("duplicates_skipped"),
    ).select(*[F.col(name).cast("long").alias(name) for name in COUNTERS])
