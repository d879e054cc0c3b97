"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Run-time re-planning: coalesces small shuffle partitions, splits skewed
    # join partitions, and turns a join into a broadcast one once the real
    # size of a side is known to be small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Stored intermediate rows are deleted once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Streaming state lives in RocksDB, off the executor heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "evotrail", master: str | None = None, **settings: str):
    """A session with ``SETTINGS``; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    named = {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in {**SETTINGS, **named}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
