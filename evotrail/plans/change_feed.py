"""The change feed: audit log in, deduplicated notifications out.

The order of the steps is chosen for size. Failed lookups leave by a narrow
anti join, duplicates leave by a map-side reduced first-per-key, known keys
leave in the same partitioning, and only what remains meets the registry
snapshot with its long schema texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail import fixed_values as fv
from evotrail.functions.globs import check_globs
from evotrail.operators import dedup, notifications, parse, registry, relevance
from evotrail.options import FeedOptions
from evotrail.staging import staged_table


def sendable_events(events: DataFrame, snapshot: DataFrame, options: FeedOptions) -> DataFrame:
    """Relevant events of a known method whose lookup did not fail."""
    relevant = relevance.relevant_events(events, options)
    known = relevant.filter(F.col("method_name").isin(*fv.EVENT_TYPE_OF_METHOD))
    return registry.drop_failed_lookups(known, snapshot)


def sent_events(
    events: DataFrame,
    snapshot: DataFrame,
    options: FeedOptions,
    state: DataFrame | None = None,
) -> DataFrame:
    """The events that lead to a notification, after removal of duplicates."""
    sendable = sendable_events(events, snapshot, options)
    if not options.deduplicate:
        return sendable
    firsts = dedup.first_per_key(sendable)
    return firsts if state is None else dedup.drop_known(firsts, state)


def notify(sent: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Notifications for events that are to be sent.

    A streaming table is read once, so all its events pass the join; else only the
    events that look something up do.
    """
    look_up = registry.with_registered if sent.isStreaming else registry.with_registered_apart
    return notifications.to_notifications(look_up(sent, snapshot))


def change_feed(
    log: DataFrame,
    snapshot: DataFrame,
    options: FeedOptions,
    state: DataFrame | None = None,
) -> DataFrame:
    """Deduplicated notifications of a log, with their log positions and keys."""
    check_globs(log.sparkSession, options.subject_filters)
    if not options.deduplicate:
        return all_notifications(log, snapshot, options)
    events = parse.change_candidates(log, options)
    return notify(sent_events(events, snapshot, options, state), snapshot)


def all_notifications(log: DataFrame, snapshot: DataFrame, options: FeedOptions) -> DataFrame:
    """One notification per sendable event, duplicates included.

    The relevant events are stored, so that the log is parsed once and only the events
    that look something up are moved to the snapshot. That join also tells which
    lookups failed.
    """
    check_globs(log.sparkSession, options.subject_filters)
    events = staged_table(
        relevance.relevant_events(parse.change_candidates(log, options), options)
    )
    enriched = registry.with_registered_apart(events, snapshot)
    failed = F.col("lookup_outcome") == registry.FAILED
    return notifications.to_notifications(
        enriched.filter(~F.coalesce(failed, F.lit(False)))
    )
