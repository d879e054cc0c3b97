"""Options of Spark's Kafka source and sink for each read mode.

The Kafka connector is a separate Spark package; these functions only need it
when a returned reader is loaded or a writer saved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from evotrail.operators.log_ranges import until_timestamp
from evotrail.options import ReadMode, ReadOptions, parse_instant

# Delivery settings that keep every message once and in order per key.
SINK_OPTIONS = {
    "kafka.acks": "all",
    "kafka.enable.idempotence": "true",
    "kafka.compression.type": "snappy",
}


def _millis(text: str) -> int:
    return int(parse_instant(text).timestamp() * 1000)


def start_options(read: ReadOptions) -> dict[str, str]:
    """Where a new query starts; a query with a checkpoint resumes from that instead.

    A partition without a record at or after the start time starts at its end.
    """
    if read.mode is ReadMode.STREAM:
        return {"startingOffsets": "latest"}
    if read.mode is ReadMode.TIMESTAMP:
        return {
            "startingTimestamp": str(_millis(read.start_timestamp)),
            "startingOffsetsByTimestampStrategy": "latest",
        }
    return {"startingOffsets": "earliest"}


def end_options(read: ReadOptions) -> dict[str, str]:
    """Where a bounded read ends. Kafka's end time is exclusive, ours inclusive."""
    if read.end_timestamp and not read.stop_at_current:
        return {"endingTimestamp": str(_millis(read.end_timestamp) + 1)}
    return {"endingOffsets": "latest"}


def _envelope(records: DataFrame, read: ReadOptions) -> DataFrame:
    log = records.selectExpr(
        "CAST(key AS string) AS key",
        "CAST(value AS string) AS value",
        "topic",
        "partition",
        "offset",
        "timestamp",
    )
    # Offsets found by time leave records with earlier times in the range.
    return until_timestamp(log, read.end_timestamp) if read.end_timestamp else log


def stream_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    read: ReadOptions,
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
    client: Mapping[str, str] | None = None,
) -> DataFrame:
    """A topic as a stream. ``client`` passes on ``kafka.*`` settings such as security.

    A bounded read is this stream with an ``availableNow`` trigger, which stops
    at the offsets that exist when the query starts.
    """
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, **start_options(read)}
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    reader = spark.readStream.format("kafka").options(**options, **(client or {}))
    return _envelope(reader.load(), read)


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    read: ReadOptions,
    min_partitions: int | None = None,
    client: Mapping[str, str] | None = None,
) -> DataFrame:
    """A stretch of a topic as a table, from its start to where it ends now."""
    if read.mode in (ReadMode.STREAM, ReadMode.RESUME):
        raise ValueError(f"{read.mode.name} needs stream_topic")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        **start_options(read),
        **end_options(read),
    }
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    reader = spark.read.format("kafka").options(**options, **(client or {}))
    return _envelope(reader.load(), read)


def write_topic(
    rows: DataFrame, servers: str, topic: str, client: Mapping[str, str] | None = None
) -> None:
    """Send ``key`` and ``value`` columns to a topic.

    Rows are sorted by key inside their partitions upstream where order matters
    (see ``sinks.in_key_order``).
    """
    options = {"kafka.bootstrap.servers": servers, "topic": topic, **SINK_OPTIONS}
    rows.write.format("kafka").options(**options, **(client or {})).save()
