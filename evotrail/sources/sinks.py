"""Writing notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.functions.render import message_key
from evotrail.sources import commits

_IN_LOG_ORDER = ("log_timestamp", "log_partition", "log_offset")


def in_key_order(notifications: DataFrame) -> DataFrame:
    """All notifications of a subject in one partition, in log order.

    Order per key needs one sender per key, so the notifications of a subject stay
    together. Those without a subject share a message key but have no order to keep,
    and are spread.
    """
    key = message_key(F.col("subject"))
    spread = F.when(F.col("subject").isNull(), F.xxhash64(*_IN_LOG_ORDER))
    return (
        notifications.withColumn("_key", key)
        .repartition("_key", spread)
        .sortWithinPartitions("_key", *_IN_LOG_ORDER)
        .drop("_key")
    )


def write_table(rows: DataFrame, path: str, name: str, partition_by: Sequence[str] = ()) -> dict:
    """Store rows in a folder of their own below ``path``; readers see them once a commit
    record holds the entry that is returned."""
    folder = commits.new_folder(name)
    rows.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    return commits.entry(folder, rows)
