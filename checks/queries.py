"""One query per operator, over the log and snapshot derived from the test tables.

Results are flat columns of text, integers and booleans; struct columns appear
only where the operator is about rendering them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evotrail import FeedOptions, ReadMode, ReadOptions
from evotrail import fixed_values as fv
from evotrail.functions import event_fields as ef
from evotrail.functions.globs import matches_any
from evotrail.operators import (
    dedup,
    filter_table,
    key_filters,
    log_ranges,
    notifications as notes,
    parse,
    registry,
    relevance,
    state as state_ops,
)
from evotrail.plans import change_feed as feed
from evotrail.plans.batch_run import run_batch
from evotrail.staging import staged
from checks import derived_tables as dt

SCHEMA_CHANGES = FeedOptions(environments=dt.MONITORED)
ALL_CHANGES = FeedOptions(environments=dt.MONITORED, include_config_changes=True)
GLOBS = ("orders-*", "payments.1*", "users-[0-4]*-value")
EXACT = ("users-7-value",)
RANGE_START, RANGE_END = "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z"
SPLIT = "2024-01-15T00:00:00Z"
PRUNE_LIMIT = 500
FILTER_BUCKETS = 16


def _as_text(column: str) -> Column:
    """A log timestamp as text, the same in every session time zone."""
    return F.col(column).cast("string")


def _events(spark: SparkSession, sf_dir: str, options: FeedOptions = ALL_CHANGES) -> DataFrame:
    return parse.audit_events(dt.audit_log(spark, sf_dir), options)


def _candidates(spark: SparkSession, sf_dir: str, options: FeedOptions = ALL_CHANGES) -> DataFrame:
    return parse.change_candidates(dt.audit_log(spark, sf_dir), options)


def _flat(notifications: DataFrame) -> DataFrame:
    """Notifications with payload members as plain columns."""
    return notifications.select(
        "event_type",
        "environment_id",
        "subject",
        "schema_id",
        "version",
        "schema_type",
        F.col("timestamp").alias("event_time"),
        "audit_log_event_id",
        F.col("data_contract_registered").isNotNull().alias("has_registered"),
        F.col("data_contract_registered.schema").alias("schema_text"),
        F.col("data_contract_registered.references").alias("schema_references"),
        F.coalesce(
            "data_contract_deleted.permanent", "subject_deleted.permanent"
        ).alias("permanent"),
        F.col("subject_deleted.versions_deleted").alias("versions_deleted"),
        F.col("compatibility_updated.new_compatibility").alias("new_compatibility"),
        F.col("mode_updated.new_mode").alias("new_mode"),
    )


# Sources -------------------------------------------------------------------


def scan_audit_log(spark, sf_dir):
    return dt.audit_log(spark, sf_dir).select(
        "partition", "offset", _as_text("timestamp").alias("log_time"), "value"
    )


def _range(spark, sf_dir, options: ReadOptions, ends: DataFrame | None = None) -> DataFrame:
    log = dt.audit_log(spark, sf_dir, to_parse=False)
    chosen = log_ranges.select_range(log, options, ends)
    return chosen.select("partition", "offset", _as_text("timestamp").alias("log_time"))


def mode_backfill(spark, sf_dir):
    return _range(spark, sf_dir, ReadOptions(ReadMode.BACKFILL))


def mode_backfill_bounded(spark, sf_dir):
    """Backfill up to where the log ended at a past moment."""
    log = dt.audit_log(spark, sf_dir, to_parse=False)
    ends = log_ranges.end_offsets(log_ranges.until_timestamp(log, RANGE_END))
    return _range(spark, sf_dir, ReadOptions(ReadMode.BACKFILL, stop_at_current=True), ends)


def mode_timestamp_start(spark, sf_dir):
    return _range(spark, sf_dir, ReadOptions(ReadMode.TIMESTAMP, start_timestamp=RANGE_START))


def mode_timestamp_range(spark, sf_dir):
    options = ReadOptions(
        ReadMode.TIMESTAMP, start_timestamp=RANGE_START, end_timestamp=RANGE_END
    )
    return _range(spark, sf_dir, options)


def registry_by_id(spark, sf_dir):
    """Every schema the log's registrations name, monitored environment or not."""
    requests = _events(spark, sf_dir).filter(registry.NEEDS_LOOKUP)
    return registry.by_id(requests, dt.registry_snapshot(spark, sf_dir)).select(
        "environment_id",
        "schema_id",
        "outcome",
        "subject",
        "version",
        F.col("schema").alias("schema_text"),
        "schema_type",
        F.col("references").alias("schema_references"),
    )


def registry_first_version(spark, sf_dir):
    return dt.registry_snapshot(spark, sf_dir).selectExpr(
        "environment_id",
        "schema_id",
        f"{registry.FIRST_VERSION}.subject AS subject",
        f"{registry.FIRST_VERSION}.version AS version",
    )


def registry_by_subject_version(spark, sf_dir):
    """The schema behind each (subject, version) that a deletion names."""
    requests = (
        _events(spark, sf_dir)
        .filter(F.col("method_name") == fv.DELETE_SCHEMA)
        .filter(F.col("environment_id").isNotNull() & F.col("request_version").isNotNull())
        .select(
            "environment_id",
            F.col("event_subject").alias("subject"),
            F.col("request_version").alias("version"),
        )
    )
    answers = registry.by_subject_version(requests, dt.registry_snapshot(spark, sf_dir))
    return answers.select(
        "environment_id",
        "subject",
        "version",
        "outcome",
        "schema_id",
        F.col("schema").alias("schema_text"),
        "schema_type",
    )


# Parsing and derived columns -------------------------------------------------


def parse_events(spark, sf_dir):
    return parse.parse_events(dt.audit_log(spark, sf_dir)).selectExpr(
        "event.id AS event_id",
        "event.specversion AS specversion",
        "event.type AS type",
        "event.time AS event_time",
        "event.subject AS envelope_subject",
        "event.data.methodName AS method_name",
        "event.data.resourceName AS resource_name",
        "event.data.request.accessType AS access_type",
        "event.data.request.subject AS request_top_subject",
        "event.data.request.data.subject AS request_data_subject",
        "event.data.request.data.schemaType AS request_schema_type",
        "event.data.request.compatibility AS compatibility",
        "event.data.request.mode AS mode",
        "event.data.result.status AS status",
    )


def malformed_events(spark, sf_dir):
    return parse.malformed_events(dt.audit_log(spark, sf_dir)).select(
        "partition", "offset", "value", "reject_reason"
    )


def coerce_numeric_fields(spark, sf_dir):
    return parse.parse_events(dt.audit_log(spark, sf_dir)).selectExpr(
        "event.id AS event_id",
        f"{ef.int_of('event.data.request.version')} AS request_version",
        f"CAST({ef.double_of('event.data.result.data.id')} AS bigint) AS result_id",
    )


def resolve_subject(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "event_id", "request_subject", "event_subject", "notification_subject"
    )


def extract_environment(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "environment_id")


def extract_schema_id(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "schema_id")


def event_type_mapping(spark, sf_dir):
    return _events(spark, sf_dir).selectExpr(
        "event_id", "method_name", f"{ef.event_type('method_name')} AS event_type"
    )


def dedup_key(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "dedup_key")


# Filters -----------------------------------------------------------------------


def _filtered(spark, sf_dir, condition: Column) -> DataFrame:
    return _events(spark, sf_dir).filter(condition).select("event_id")


def filter_event_type(spark, sf_dir):
    return _filtered(spark, sf_dir, relevance.is_schema_event() & F.col("has_data"))


def filter_methods(spark, sf_dir):
    return _filtered(spark, sf_dir, relevance.has_allowed_method(SCHEMA_CHANGES))


def filter_methods_with_config(spark, sf_dir):
    return _filtered(spark, sf_dir, relevance.has_allowed_method(ALL_CHANGES))


def filter_environment(spark, sf_dir):
    environments = dt.monitored_environments(spark)
    return relevance.in_environments(_events(spark, sf_dir), environments).select(
        "event_id", "environment_id"
    )


def filter_status(spark, sf_dir):
    return _filtered(spark, sf_dir, relevance.is_successful())


def _subject_filtered(spark, sf_dir, filters) -> DataFrame:
    events = _events(spark, sf_dir).filter(matches_any(F.col("event_subject"), filters))
    return events.select("event_id", "event_subject")


def filter_subject(spark, sf_dir):
    return _subject_filtered(spark, sf_dir, GLOBS + EXACT)


def filter_subject_glob(spark, sf_dir):
    return _subject_filtered(spark, sf_dir, GLOBS)


def filter_subject_exact(spark, sf_dir):
    return _subject_filtered(spark, sf_dir, EXACT)


def filter_subject_table(spark, sf_dir):
    """Filters from a table: a name, or a pattern of one of three kinds, for each small part."""
    part = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 4
    filters = dt.table(spark, sf_dir, "part").where("p_size <= 20").select(
        F.when(kind == 0, F.concat(F.lit("orders-"), part, F.lit("-value")))
        .when(kind == 1, F.concat(F.lit("payments."), part, F.lit("*")))
        .when(kind == 2, F.concat(F.lit("*-"), part, F.lit("-value")))
        .otherwise(F.concat(F.lit("*s-"), part, F.lit("-v*")))
        .alias("filter")
    )
    events = filter_table.in_filter_table(_events(spark, sf_dir), filters)
    return events.select("event_id", "event_subject")


def relevant_events(spark, sf_dir):
    relevant = relevance.relevant_events(_candidates(spark, sf_dir), ALL_CHANGES)
    return relevant.select("event_id", "method_name", "environment_id", "event_subject")


def skip_reasons(spark, sf_dir):
    options = FeedOptions(
        environments=dt.MONITORED, include_config_changes=True, subject_filters=GLOBS + EXACT
    )
    return relevance.skip_reasons(_events(spark, sf_dir, options), options)


def unmonitored_registrations(spark, sf_dir):
    return relevance.unmonitored_registrations(
        _candidates(spark, sf_dir), dt.monitored_environments(spark), ALL_CHANGES
    )


# Enrichment --------------------------------------------------------------------


def _enriched(spark, sf_dir) -> DataFrame:
    relevant = relevance.relevant_events(_candidates(spark, sf_dir), ALL_CHANGES)
    return registry.with_registered(relevant, dt.registry_snapshot(spark, sf_dir))


def enrich_registrations(spark, sf_dir):
    return (
        _enriched(spark, sf_dir)
        .filter(F.col("method_name") == fv.REGISTER_SCHEMA)
        .select(
            "event_id",
            "environment_id",
            "schema_id",
            "lookup_outcome",
            F.col("registered.subject").alias("registered_subject"),
            F.col("registered.version").alias("version"),
            F.col("registered.schema").alias("schema_text"),
            F.col("registered.schema_type").alias("registered_type"),
        )
    )


def enrich_outcomes(spark, sf_dir):
    registrations = _enriched(spark, sf_dir).filter(F.col("lookup_outcome").isNotNull())
    return registrations.groupBy("lookup_outcome").agg(F.count("*").alias("events"))


def schema_type_default(spark, sf_dir):
    found = f"registered.http_status = {registry.FOUND}"
    kind = ef.schema_type("registered.schema_type", found, "request_schema_type")
    return (
        _enriched(spark, sf_dir)
        .filter(F.col("method_name") == fv.REGISTER_SCHEMA)
        .selectExpr("event_id", f"{kind} AS schema_type")
    )


# Notifications ------------------------------------------------------------------


def _all_notifications(spark, sf_dir) -> DataFrame:
    log, snapshot = dt.audit_log(spark, sf_dir), dt.registry_snapshot(spark, sf_dir)
    return feed.all_notifications(log, snapshot, ALL_CHANGES)


def _feed(spark, sf_dir, options: FeedOptions = ALL_CHANGES) -> DataFrame:
    log, snapshot = dt.audit_log(spark, sf_dir), dt.registry_snapshot(spark, sf_dir)
    return feed.change_feed(log, snapshot, options)


def process_events(spark, sf_dir):
    return _flat(_all_notifications(spark, sf_dir))


def _of_method(method: str) -> Callable[[SparkSession, str], DataFrame]:
    """Notifications of one method only; no other method is even parsed."""
    options = FeedOptions(environments=dt.MONITORED, methods=(method,))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log, snapshot = dt.audit_log(spark, sf_dir), dt.registry_snapshot(spark, sf_dir)
        return _flat(feed.all_notifications(log, snapshot, options))

    return query


def notifications(spark, sf_dir):
    """The flagship: the deduplicated feed of all five kinds of change."""
    return _flat(_feed(spark, sf_dir))


def notifications_schema_changes(spark, sf_dir):
    return _flat(_feed(spark, sf_dir, SCHEMA_CHANGES))


def notifications_filtered(spark, sf_dir):
    options = FeedOptions(
        environments=dt.MONITORED, include_config_changes=True, subject_filters=GLOBS + EXACT
    )
    return _flat(_feed(spark, sf_dir, options))


def notifications_per_environment(spark, sf_dir):
    """Deduplication by keys that keep environments apart."""
    options = FeedOptions(
        environments=dt.MONITORED, include_config_changes=True, key_scope="environment"
    )
    return _flat(_feed(spark, sf_dir, options))


def sink_key_value(spark, sf_dir):
    rows = notes.keyed_rows(_feed(spark, sf_dir))
    return rows.select(
        "key",
        F.col("value.event_type").alias("event_type"),
        F.col("value.audit_log_event_id").alias("audit_log_event_id"),
        F.col("value.data_contract_registered.references").alias("schema_references"),
    )


def notification_json(spark, sf_dir):
    return notes.json_rows(_feed(spark, sf_dir))


# Deduplication, state and counters ------------------------------------------------


def dedup_first_wins(spark, sf_dir):
    log, snapshot = dt.audit_log(spark, sf_dir), dt.registry_snapshot(spark, sf_dir)
    events = parse.change_candidates(log, ALL_CHANGES)
    sent = feed.sent_events(events, snapshot, ALL_CHANGES)
    return sent.select("dedup_key", "event_id", "partition", "offset")


def _earlier_state(spark, sf_dir) -> DataFrame:
    """The state a first run up to the split time leaves behind."""
    log = log_ranges.until_timestamp(dt.audit_log(spark, sf_dir), SPLIT)
    events = parse.change_candidates(log, ALL_CHANGES)
    snapshot = dt.registry_snapshot(spark, sf_dir)
    return state_ops.state_rows(feed.sent_events(events, snapshot, ALL_CHANGES))


def _later_log(spark, sf_dir) -> DataFrame:
    """The log from the split time on; no text is rendered to find its start."""
    positions = dt.audit_log(spark, sf_dir, to_parse=False)
    return log_ranges.from_timestamp(dt.audit_log(spark, sf_dir), SPLIT, positions)


def _second_run(spark, sf_dir):
    state = _earlier_state(spark, sf_dir)
    log = _later_log(spark, sf_dir)
    snapshot = dt.registry_snapshot(spark, sf_dir)
    events = parse.change_candidates(log, ALL_CHANGES)
    return state, feed.sent_events(events, snapshot, ALL_CHANGES, state)


def dedup_with_state(spark, sf_dir):
    _, sent = _second_run(spark, sf_dir)
    return sent.select("dedup_key", "event_id", "partition", "offset")


def known_keys_by_filter(spark, sf_dir):
    """The keys of a later run that the state holds: a Bloom filter of the state's buckets
    admits them, and those admitted meet the state itself."""
    state = staged(_earlier_state(spark, sf_dir))
    events = parse.audit_events(_later_log(spark, sf_dir), ALL_CHANGES)
    blocks = key_filters.blocks_for(state.count(), FILTER_BUCKETS)
    filters = key_filters.key_filter(state, "dedup_key", FILTER_BUCKETS, blocks)
    admitted = key_filters.may_hold(events, "dedup_key", filters, FILTER_BUCKETS, blocks)
    return dedup.known_keys(admitted, state)


def state_after_run(spark, sf_dir):
    state, sent = _second_run(spark, sf_dir)
    return state_ops.add_to_state(state, sent).select(
        "dedup_key", _as_text("timestamp").alias("first_seen"), "partition", "offset"
    )


def _whole_state(spark, sf_dir) -> DataFrame:
    events = _candidates(spark, sf_dir)
    snapshot = dt.registry_snapshot(spark, sf_dir)
    return state_ops.state_rows(feed.sent_events(events, snapshot, ALL_CHANGES))


def state_pruned(spark, sf_dir):
    """What an oldest-first limit keeps; the limit is the operator itself."""
    return state_ops.prune_state(_whole_state(spark, sf_dir), PRUNE_LIMIT).select(
        "dedup_key", _as_text("timestamp").alias("first_seen")
    )


def state_size(spark, sf_dir):
    """Remembered keys, and schemas that were fetched for them."""
    sent = feed.sent_events(
        _candidates(spark, sf_dir), dt.registry_snapshot(spark, sf_dir), ALL_CHANGES
    )
    fetched = registry.with_registered(sent, dt.registry_snapshot(spark, sf_dir))
    hit = F.col("lookup_outcome") == registry.HIT
    return fetched.agg(
        F.count("*").alias("state_keys"),
        F.count_distinct(
            F.when(hit, F.col("environment_id")), F.when(hit, F.col("schema_id"))
        ).alias("cached_schemas"),
    )


def duplicates_skipped(spark, sf_dir):
    log, snapshot = dt.audit_log(spark, sf_dir), dt.registry_snapshot(spark, sf_dir)
    run = run_batch(log, snapshot, ALL_CHANGES)
    return run.duplicates.select("event_id", "dedup_key", "partition", "offset")


def _metrics(options: FeedOptions) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        log, snapshot = dt.audit_log(spark, sf_dir), dt.registry_snapshot(spark, sf_dir)
        return run_batch(log, snapshot, options).counters()

    return query


def run_metrics_with_state(spark, sf_dir):
    """Counters of a second run that starts from the first one's state."""
    state = staged(_earlier_state(spark, sf_dir))
    log = _later_log(spark, sf_dir)
    snapshot = dt.registry_snapshot(spark, sf_dir)
    return run_batch(log, snapshot, ALL_CHANGES, state).counters()


def failed_lookups(spark, sf_dir):
    """Relevant registrations left out because the registry did not answer."""
    relevant = relevance.relevant_events(_candidates(spark, sf_dir), ALL_CHANGES)
    snapshot = dt.registry_snapshot(spark, sf_dir)
    return registry.failed_lookups(registry.with_failed_status(relevant, snapshot))


def late_lookups(spark, sf_dir):
    """What a second run sends when the registry answers all, lookups that failed in the
    first run included."""
    log, snapshot = dt.audit_log(spark, sf_dir), dt.registry_snapshot(spark, sf_dir)
    first = run_batch(log_ranges.until_timestamp(log, SPLIT), snapshot, ALL_CHANGES)
    status = F.when(F.col("http_status") == registry.NOT_FOUND, registry.NOT_FOUND)
    answered = snapshot.withColumn("http_status", status.otherwise(registry.FOUND))
    second = run_batch(_later_log(spark, sf_dir), answered, ALL_CHANGES, first.new_state(), first.waiting)
    return second.sent.select("dedup_key", "event_id", "partition", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        scan_audit_log,
        mode_backfill,
        mode_backfill_bounded,
        mode_timestamp_start,
        mode_timestamp_range,
        registry_by_id,
        registry_first_version,
        registry_by_subject_version,
        parse_events,
        malformed_events,
        coerce_numeric_fields,
        resolve_subject,
        extract_environment,
        extract_schema_id,
        event_type_mapping,
        dedup_key,
        filter_event_type,
        filter_methods,
        filter_methods_with_config,
        filter_environment,
        filter_status,
        filter_subject,
        filter_subject_glob,
        filter_subject_exact,
        filter_subject_table,
        relevant_events,
        skip_reasons,
        unmonitored_registrations,
        enrich_registrations,
        enrich_outcomes,
        schema_type_default,
        failed_lookups,
        late_lookups,
        process_events,
        notifications,
        notifications_schema_changes,
        notifications_filtered,
        notifications_per_environment,
        sink_key_value,
        notification_json,
        dedup_first_wins,
        dedup_with_state,
        known_keys_by_filter,
        state_after_run,
        state_pruned,
        state_size,
        duplicates_skipped,
        run_metrics_with_state,
    )
}
QUERIES["register_notifications"] = _of_method(fv.REGISTER_SCHEMA)
QUERIES["delete_schema_notifications"] = _of_method(fv.DELETE_SCHEMA)
QUERIES["delete_subject_notifications"] = _of_method(fv.DELETE_SUBJECT)
QUERIES["compatibility_notifications"] = _of_method(fv.UPDATE_COMPATIBILITY)
QUERIES["mode_notifications"] = _of_method(fv.UPDATE_MODE)
QUERIES["run_metrics"] = _metrics(ALL_CHANGES)
QUERIES["run_metrics_schema_changes"] = _metrics(SCHEMA_CHANGES)
