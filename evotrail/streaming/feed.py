"""The change feed as a running query with exact first-wins deduplication.

Each micro-batch is a bounded run (``plans.batch_run``) against the state that
earlier batches left. The first event of a key wins: by arrival between batches, by
log position (time, partition, offset) within one. A source hands out each log
partition in its order, so cuts cannot change the winner among the events of one
partition; among partitions an event with an earlier time loses if a later batch
brings it.

A batch writes its tables to folders of their own and ends by publishing one commit
record that names them (``sources.commits``). ``read_table`` follows the records, so a
batch is seen whole or not at all; one that runs again after a crash replaces its record,
and a failed write fails the batch. The last batch of an era also merges the small files
of the era's batches into few large ones, under a record of the era; the merged folders
are deleted when the next era ends, which leaves running readers that long.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evotrail.functions.globs import check_globs
from evotrail.operators.metrics import COUNTERS
from evotrail.options import FeedOptions
from evotrail.plans.batch_run import run_batch
from evotrail.sources import commits, sinks, state_files
from evotrail.streaming.bounded import EndMarks, positions_of

#: Batches between two compactions of state and output; must not change for a folder.
ERA_LENGTH = 50

#: Tables that grow with every batch, and the columns their files are split by.
MERGED = {
    "notifications": ("event_type",),
    "failed_lookups": (),
    "duplicates": (),
    "rejected": (),
    "counters": (),
    "positions": (),
}
TABLES = (*MERGED, "waiting")

_POSITIONS = "partition int, last_offset long"


class NothingCommitted(ValueError):
    """No batch has written the table asked for."""


@dataclass(frozen=True)
class FeedFolders:
    """Where a feed keeps its files; all belong to one checkpoint."""

    root: str

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    @property
    def state(self) -> str:
        return f"{self.root}/state"

    @property
    def commits(self) -> str:
        return f"{self.root}/commits"

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"


def process_batch(
    records: DataFrame,
    batch_id: int,
    snapshot: DataFrame,
    options: FeedOptions,
    folders: FeedFolders,
    publish: Callable[[DataFrame], None] | None = None,
    dry_run: bool = False,
    era_length: int = ERA_LENGTH,
    buckets: int = state_files.BUCKETS,
    retry_lookups: bool = False,
    marks: EndMarks | None = None,
) -> dict[str, int]:
    """Run one batch and write what it yields: output, state and counters, then the record.

    Side tables keep what the feed leaves out: registrations whose lookup
    failed, duplicates, and unreadable records, from the same pass over the batch.
    Returns the counters.

    With ``retry_lookups`` registrations whose lookup failed are tried again in every later
    batch, with its snapshot, until they are answered or another event of their key is sent.
    They wait in a table of each batch.

    ``publish`` sends notifications on, e.g. to a topic; it may see a batch
    again after a crash. A dry run writes no output but still marks its keys.

    With ``marks`` records behind the ends are left out, and the last offsets met are
    stored with the batch.
    """
    spark = records.sparkSession
    if marks is not None:
        records, seen = marks.watch(records)
    state = None
    if options.deduplicate:
        state = partial(
            state_files.load, spark, folders.state, batch_id, era_length, buckets
        )
    waiting = None
    if retry_lookups:
        before = commits.read(spark, folders.commits, [_batch_name(batch_id - 1)])
        kept = [record["waiting"] for record in before.values() if "waiting" in record]
        if kept:
            stored = commits.read_entries(spark, folders.table("waiting"), kept)
            waiting = stored.drop("batch_id")
    run = run_batch(records, snapshot, options, state, waiting)
    entries: dict[str, dict] = {}

    def store(table: str, rows: DataFrame) -> None:
        numbered = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        name, split = _batch_name(batch_id), MERGED.get(table, ())
        entries[table] = sinks.write_table(numbered, folders.table(table), name, split)

    if not dry_run:
        store("notifications", run.notifications)
        if publish is not None:
            publish(sinks.in_key_order(run.notifications))
    store("failed_lookups", run.failed_lookups)
    if retry_lookups:
        store("waiting", run.waiting)
    if options.deduplicate:
        store("duplicates", run.duplicates)
    if run.records_rejected:
        store("rejected", run.rejected)
    if options.deduplicate:
        state_files.add(run.new_state(), folders.state, batch_id, era_length)
        state_files.end_era(
            spark,
            folders.state,
            batch_id,
            era_length,
            options.max_state_keys,
            options.state_ttl_days,
            buckets,
        )
    rejected = F.lit(run.records_rejected).cast("long")
    store("counters", run.counters().withColumn("records_rejected", rejected))
    if marks is not None:
        positions = positions_of(seen)
        store("positions", spark.createDataFrame(list(positions.items()), _POSITIONS))
    commits.publish(spark, folders.commits, _batch_name(batch_id), entries)
    era, place = divmod(batch_id, era_length)
    if place == era_length - 1:
        merge_era(spark, folders, era, era_length)
        drop_merged(spark, folders, era - 1, era_length)
    if marks is not None:
        marks.advance(positions, batch_id)
    counters = commits.read_entries(spark, folders.table("counters"), [entries["counters"]])
    return counters.drop("batch_id").first().asDict()


def _batch_name(batch_id: int) -> str:
    return f"batch-{batch_id}"


def _era_name(era: int, era_length: int) -> str:
    """An era is named by its first and last batch, so that records tell what they cover."""
    return f"era-{era * era_length}-{(era + 1) * era_length - 1}"


def _batches_of(name: str) -> tuple[int, int]:
    """The first and the last batch of a record or folder."""
    kind, *numbers = commits.folder_title(name).split("-")
    return int(numbers[0]), int(numbers[1] if kind == "era" else numbers[0])


def merge_era(spark: SparkSession, folders: FeedFolders, era: int, era_length: int) -> None:
    """Merge what the batches of an era wrote into few files, under one record.

    Spark's rebalance joins small partitions and splits large ones by their size.
    """
    first = era * era_length
    found = commits.read(
        spark, folders.commits, [_batch_name(first + i) for i in range(era_length)]
    )
    records = sorted(found.items(), key=lambda item: _batches_of(item[0]))
    name, entries = _era_name(era, era_length), {}
    for table, split in MERGED.items():
        parts = [record[table] for _, record in records if table in record]
        if parts:
            rows = commits.read_entries(spark, folders.table(table), parts)
            rows = rows.hint("rebalance", *split)
            entries[table] = sinks.write_table(rows, folders.table(table), name, split)
    commits.publish(spark, folders.commits, name, entries)


def drop_merged(spark: SparkSession, folders: FeedFolders, era: int, era_length: int) -> None:
    """Delete the batches up to an era's end that are merged, and what crashes left of them."""
    end = (era + 1) * era_length
    names = commits.record_names(spark, folders.commits)
    eras = [name for name in names if name.startswith("era-")]
    commits.forget(
        spark,
        folders.commits,
        [name for name in names if name not in eras and _is_covered(name, eras, end)],
    )
    merged = commits.read(spark, folders.commits, eras).values()
    kept = {entry["folder"] for record in merged for entry in record.values()}
    for table in TABLES:
        for folder in commits.names_in(spark, folders.table(table)):
            if folder not in kept and _is_covered(folder, eras, end):
                commits.delete(spark, f"{folders.table(table)}/{folder}")


def _is_covered(name: str, eras: list[str], end: int) -> bool:
    """Whether a record or folder holds only batches before ``end`` that an era record holds."""
    first, last = _batches_of(name)
    spans = [_batches_of(era) for era in eras]
    return last < end and any(low <= first and last <= high for low, high in spans)


def read_table(
    spark: SparkSession, folders: FeedFolders, table: str, batch_id: int | None = None
) -> DataFrame:
    """The committed rows of one of ``TABLES``, with their batch_id; of one batch if named.

    Batches that an era's record covers are read from there. ``waiting`` has the rows of
    the last batches only.
    """
    names = commits.record_names(spark, folders.commits)
    eras = [name for name in names if name.startswith("era-") and table in MERGED]
    spans = [_batches_of(name) for name in eras]
    batches = [
        name
        for name in names
        if name.startswith("batch-")
        and not any(low <= _batches_of(name)[0] <= high for low, high in spans)
    ]
    wanted = [*eras, *batches]
    if batch_id is not None:
        low_high = [(name, _batches_of(name)) for name in wanted]
        wanted = [name for name, (low, high) in low_high if low <= batch_id <= high]
    found = commits.read(spark, folders.commits, wanted)
    in_order = sorted(found, key=_batches_of)
    entries = [found[name][table] for name in in_order if table in found[name]]
    if not entries:
        raise NothingCommitted(f"{folders.root} has no committed {table}")
    rows = commits.read_entries(spark, folders.table(table), entries)
    return rows if batch_id is None else rows.where(F.col("batch_id") == batch_id)


def start_feed(
    log: DataFrame,
    read_snapshot: Callable[[], DataFrame],
    options: FeedOptions,
    folders: FeedFolders,
    trigger: Mapping[str, object],
    publish: Callable[[DataFrame], None] | None = None,
    dry_run: bool = False,
    era_length: int = ERA_LENGTH,
    batch_done: Callable[[Mapping[str, int]], None] | None = None,
    buckets: int = state_files.BUCKETS,
    retry_lookups: bool = False,
    marks: EndMarks | None = None,
) -> StreamingQuery:
    """Start the feed on a streaming log.

    ``read_snapshot`` is called for every batch, so that schemas registered
    since the start are found. ``trigger`` holds the arguments of Spark's
    trigger: ``{"availableNow": True}`` stops at the current end of the log,
    ``{"processingTime": "1 second"}`` keeps running. ``batch_done`` gets the
    counters of every finished batch. ``marks`` bounds the feed; ``bounded.stop_at_ends``
    then waits for its end and stops it.
    """
    if marks is not None:
        for row in last_positions(log.sparkSession, folders).collect():
            marks.passed[row.partition] = row.last_offset
    check_globs(log.sparkSession, options.subject_filters)

    def handle(records: DataFrame, batch_id: int) -> None:
        counters = process_batch(
            records,
            batch_id,
            read_snapshot(),
            options,
            folders,
            publish,
            dry_run,
            era_length,
            buckets,
            retry_lookups,
            marks,
        )
        if batch_done is not None:
            batch_done(counters)

    return (
        log.writeStream.foreachBatch(handle)
        .option("checkpointLocation", folders.checkpoint)
        .trigger(**trigger)
        .start()
    )


def last_positions(spark: SparkSession, folders: FeedFolders) -> DataFrame:
    """Per log partition, the last offset that a feed with marks has met; none before it ran."""
    try:
        stored = read_table(spark, folders, "positions")
    except NothingCommitted:
        return spark.createDataFrame([], _POSITIONS)
    return stored.groupBy("partition").agg(F.max("last_offset").alias("last_offset"))


def total_counters(spark: SparkSession, folders: FeedFolders) -> DataFrame:
    """Counters summed over all batches so far."""
    names = (*COUNTERS, "records_rejected")
    stored = read_table(spark, folders, "counters")
    return stored.agg(*[F.sum(name).alias(name) for name in names])
