"""Stretches of a stored log, as the read modes define them.

The Kafka source takes these bounds as options; on a stored log they are
filters on the envelope columns. Offsets per partition are one row per
partition of the log's topic, a count fixed by the topic and not by the data,
so those tables are broadcast.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evotrail.options import ReadMode, ReadOptions, parse_instant


def _instant(log: DataFrame, text: str) -> Column:
    """The instant as a literal of the log's own timestamp type.

    A literal of the same type lets Spark push the comparison to the files.
    """
    moment: datetime = parse_instant(text)
    if isinstance(log.schema["timestamp"].dataType, T.TimestampNTZType):
        return F.lit(moment.replace(tzinfo=None).isoformat()).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(round(moment.timestamp() * 1_000_000)))


def start_offsets(log: DataFrame, start: str) -> DataFrame:
    """Per partition, the lowest offset with a record at or after the time."""
    return (
        log.filter(F.col("timestamp") >= _instant(log, start))
        .groupBy("partition")
        .agg(F.min("offset").alias("start_offset"))
    )


def from_timestamp(log: DataFrame, start: str, positions: DataFrame | None = None) -> DataFrame:
    """Records from the start offset of their partition on.

    This positions, it does not filter: an older record at a later offset is
    kept. A partition without any record at or after the time gives nothing.
    ``positions`` may hold the partition, offset and timestamp of all records, where
    reading them from the log would also work out its text.
    """
    starts = F.broadcast(start_offsets(log if positions is None else positions, start))
    return (
        log.join(starts, "partition")
        .filter(F.col("offset") >= F.col("start_offset"))
        .drop("start_offset")
    )


def until_timestamp(log: DataFrame, end: str) -> DataFrame:
    """Records up to the time, inclusive, in every partition."""
    return log.filter(F.col("timestamp") <= _instant(log, end))


def end_offsets(log: DataFrame) -> DataFrame:
    """Per partition, the offset after its last record: where the log ends now."""
    return log.groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))


def until_offsets(log: DataFrame, ends: DataFrame) -> DataFrame:
    """Records before the end offset of their partition; later ones are left out."""
    return (
        log.join(F.broadcast(ends), "partition")
        .filter(F.col("offset") < F.col("end_offset"))
        .drop("end_offset")
    )


def select_range(log: DataFrame, options: ReadOptions, ends: DataFrame | None = None) -> DataFrame:
    """The stretch of a stored log that the read options name.

    STREAM and RESUME have no meaning for a stored table, since both start at a
    position that only a running query's checkpoint knows. ``stop_at_current`` needs
    ``ends``, taken by ``end_offsets`` when the run starts.
    """
    if options.mode in (ReadMode.STREAM, ReadMode.RESUME):
        raise ValueError(f"{options.mode.name} needs a streaming query and its checkpoint")
    if options.mode is ReadMode.TIMESTAMP:
        log = from_timestamp(log, options.start_timestamp)
    if options.stop_at_current:
        if ends is None:
            raise ValueError("stop_at_current needs the end offsets of the log")
        log = until_offsets(log, ends)
    if options.end_timestamp:
        log = until_timestamp(log, options.end_timestamp)
    return log
