"""A bounded run over a stretch of the log, with everything the run reports.

The raw log is read and parsed once. The records that can matter, a narrow and
filtered part of it, are stored as Parquet, and so are the events to be sent and the
marks of their keys; duplicates, notifications, state and counters are computed from
there, each reading only its columns. Events that cannot be sent are stored with their
id, key and position alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from evotrail import fixed_values as fv
from evotrail.functions.globs import check_globs
from evotrail.operators import dedup, metrics, parse, registry, relevance
from evotrail.operators import state as state_ops
from evotrail.options import FeedOptions
from evotrail.plans.change_feed import notify
from evotrail.schemas import POSITION
from evotrail.staging import staged_table


@dataclass(frozen=True)
class BatchRun:
    """The results of a run; tables are lazy and read from stored rows."""

    events_consumed: int
    records_rejected: int
    sent: DataFrame
    duplicates: DataFrame
    notifications: DataFrame
    failed_lookups: DataFrame
    rejected: DataFrame
    waiting: DataFrame

    def counters(self) -> DataFrame:
        return metrics.run_counters(F.lit(self.events_consumed), self.sent, self.duplicates)

    def new_state(self) -> DataFrame:
        """The keys this run marked, to be added to the state."""
        return state_ops.state_rows(self.sent)


#: The columns of every candidate that later steps read.
_REPEAT = (*POSITION, "event_id", "dedup_key")

#: The columns that are read of candidates that may be sent; null in the others.
_RELEVANT = (
    "type",
    "event_time",
    "has_data",
    "method_name",
    "status",
    "environment_id",
    "event_subject",
    "notification_subject",
    "request_version",
    "request_schema_type",
    "compatibility",
    "mode",
    "schema_id",
)
_CANDIDATE = (*_REPEAT, *_RELEVANT)


def run_batch(
    log: DataFrame,
    snapshot: DataFrame,
    options: FeedOptions,
    state: DataFrame | Sequence[DataFrame] | Callable[[DataFrame], Sequence[DataFrame]] | None = None,
    waiting: DataFrame | None = None,
) -> BatchRun:
    """Process a stretch of the log after the runs that ``state`` remembers.

    ``state`` must hold each key once; it may come in several tables, or as a function that
    gets the run's keys (dedup_key) and gives the tables that may hold them. The log is
    read and parsed once: candidates and unreadable records are stored by one pass, in one
    table.

    ``waiting`` holds registrations whose lookup failed in the run before (its ``waiting``).
    They are tried again at their old place in the log, before the new events of their
    keys. One leaves when its lookup is answered, or when its key has been sent by another
    event; the others wait on. They are not counted as consumed again.
    """
    check_globs(log.sparkSession, options.subject_filters)
    # Only keys of these methods are ever sent, in this run or an earlier one.
    repeatable = dedup.is_repeatable(tuple(fv.EVENT_TYPE_OF_METHOD))
    envelope = [name for name in log.columns if name not in POSITION]
    rejected = F.col("reject_reason").isNotNull()
    # Only unreadable records keep their text.
    parsed = parse.with_event(log).withColumns(
        {name: F.when(rejected, F.col(name)) for name in envelope}
    )
    counted = Observation("run")
    counts = parsed.observe(
        counted,
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(~rejected, 1)).alias("events"),
    )
    kept = parse.derive_fields(counts, options).where(rejected | repeatable)
    kept = kept.withColumn("_relevant", relevance.is_relevant(options))
    stored = staged_table(
        kept.select(
            *_REPEAT,
            *[F.when(F.col("_relevant"), F.col(name)).alias(name) for name in _RELEVANT],
            "reject_reason",
            *envelope,
        )
    )
    rejects = stored.where(rejected).select(*log.columns, "reject_reason")
    candidates = stored.where(~rejected).select(*_CANDIDATE)
    if waiting is not None:
        candidates = candidates.unionByName(waiting)

    relevant = relevance.relevant_events(candidates, options)
    known_method = F.col("method_name").isin(*fv.EVENT_TYPE_OF_METHOD)
    judged = registry.with_failed_status(relevant.where(known_method), snapshot)
    sendable = judged.where("failed_status IS NULL").drop("failed_status")
    failed = judged.where("failed_status IS NOT NULL")
    if options.deduplicate:
        if callable(state):
            state = state(candidates.select("dedup_key"))
        tables = [state] if isinstance(state, DataFrame) else list(state or ())
        sent = staged_table(reduce(dedup.drop_known, tables, dedup.first_per_key(sendable)))
        marks = dedup.marks(sent, [dedup.known_keys(candidates, table) for table in tables])
        marks = staged_table(marks.withColumn("_marked", F.lit(True)))
        repeats = candidates.join(marks, "dedup_key").filter(dedup.IS_AFTER_MARK)
        # A duplicate is skipped before its schema is looked up.
        failed = failed.join(marks, "dedup_key", "left")
        failed = failed.filter(f"_marked IS NULL OR NOT ({dedup.IS_AFTER_MARK})")
        unanswered = failed.where("_marked IS NULL")
    else:
        sent = staged_table(sendable)
        unanswered = failed
        repeats = candidates.limit(0)
    return BatchRun(
        events_consumed=counted.get["events"],
        records_rejected=counted.get["records"] - counted.get["events"],
        sent=sent,
        duplicates=repeats.select("event_id", "dedup_key", *POSITION),
        notifications=notify(sent, snapshot),
        failed_lookups=registry.failed_lookups(failed),
        rejected=rejects,
        waiting=unanswered.select(*_CANDIDATE),
    )
