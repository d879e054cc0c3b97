"""The change feed with Spark's own streaming deduplication.

Keys live in Spark's state store, so a batch touches only the keys it meets,
however many are remembered. The price is a looser order: among the events of a
key within one micro-batch any may win, where ``streaming.feed`` takes the
first by log position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.operators import parse
from evotrail.options import FeedOptions
from evotrail.plans.change_feed import notify, sendable_events


def stateful_feed(
    log: DataFrame,
    snapshot: DataFrame,
    options: FeedOptions,
    remember: str | None = None,
    salts: int = 32,
) -> DataFrame:
    """Notifications of a streaming log as a streaming table.

    The snapshot's file list is the one at the start of the query; restart it to
    see later files. (``streaming.feed`` reads the snapshot anew for every batch.)

    ``remember`` bounds the state: a key counts as seen for at least that long
    after its event's log time (e.g. ``"7 days"``), until the watermark of later
    batches has passed it; None remembers keys for ever. A key is first deduplicated
    in ``salts`` parts, so that a key with very many events is spread over several
    tasks; 1 leaves that step out.
    """
    events = parse.change_candidates(log, options)
    events = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    sendable = sendable_events(events, snapshot, options)
    if options.deduplicate:
        if remember is not None:
            sendable = sendable.withWatermark("timestamp", remember)
        if salts > 1:
            part = F.pmod(F.xxhash64("partition", "offset"), F.lit(salts))
            sendable = sendable.withColumn("_part", part)
            sendable = _distinct(sendable, ["dedup_key", "_part"], remember)
        sendable = _distinct(sendable, ["dedup_key"], remember)
    return notify(sendable.drop("_part"), snapshot)


def _distinct(events: DataFrame, keys: list[str], remember: str | None) -> DataFrame:
    if remember is None:
        return events.dropDuplicates(keys)
    return events.dropDuplicatesWithinWatermark(keys)
