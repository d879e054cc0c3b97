"""Which events describe a change worth a notification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evotrail import fixed_values as fv
from evotrail.functions.globs import matches_any
from evotrail.options import FeedOptions

RELEVANT = "relevant"


def is_schema_event() -> Column:
    return F.col("type") == fv.SCHEMA_EVENT_TYPE


def has_allowed_method(options: FeedOptions) -> Column:
    return F.col("method_name").isin(*options.allowed_methods)


def is_monitored(options: FeedOptions) -> Column:
    return F.col("environment_id").isin(*options.environments)


def is_successful() -> Column:
    """Status equals SUCCESS in any case; the length test keeps out 'ß'-like letters."""
    status = F.col("status")
    return (F.length(status) == len(fv.STATUS_SUCCESS)) & (F.upper(status) == fv.STATUS_SUCCESS)


def _status_passes(options: FeedOptions) -> Column:
    return is_successful() if options.only_successful else F.lit(True)


def is_relevant(options: FeedOptions) -> Column:
    """All conditions at once, the cheap ones first; null counts as false."""
    conditions = (
        is_schema_event()
        & F.col("has_data")
        & has_allowed_method(options)
        & is_monitored(options)
        & _status_passes(options)
    )
    if options.subject_filters:
        conditions = conditions & matches_any(F.col("event_subject"), options.subject_filters)
    return F.coalesce(conditions, F.lit(False))


def relevant_events(events: DataFrame, options: FeedOptions) -> DataFrame:
    """The events that pass every condition, in the order of ``skip_reason``."""
    kept = events.filter(is_schema_event() & F.col("has_data"))
    kept = kept.filter(has_allowed_method(options)).filter(is_monitored(options))
    if options.only_successful:
        kept = kept.filter(is_successful())
    if options.subject_filters:
        kept = kept.filter(matches_any(F.col("event_subject"), options.subject_filters))
    return kept


def skip_reason(options: FeedOptions) -> Column:
    """The first condition an event fails, or ``relevant``."""

    def fails(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    reason = (
        F.when(fails(is_schema_event()), F.lit("event_type"))
        .when(~F.col("has_data"), F.lit("no_data"))
        .when(fails(has_allowed_method(options)), F.lit("method"))
        .when(F.col("environment_id").isNull(), F.lit("no_environment"))
        .when(fails(is_monitored(options)), F.lit("unmonitored_environment"))
    )
    if options.only_successful:
        reason = reason.when(fails(is_successful()), F.lit("not_successful"))
    if options.subject_filters:
        matched = matches_any(F.col("event_subject"), options.subject_filters)
        reason = reason.when(fails(matched), F.lit("subject"))
    return reason.otherwise(F.lit(RELEVANT))


def in_environments(events: DataFrame, environments: DataFrame) -> DataFrame:
    """Events of the environments listed in a table.

    No hint: Spark broadcasts the table if its size allows, and otherwise
    shuffles, with skewed partitions split at run time.
    """
    return events.join(environments.select("environment_id"), "environment_id", "left_semi")


def unmonitored_registrations(
    events: DataFrame, environments: DataFrame, options: FeedOptions
) -> DataFrame:
    """Registrations seen in environments that are not monitored."""
    registrations = events.filter(
        is_schema_event()
        & F.col("has_data")
        & has_allowed_method(options)
        & (F.col("method_name") == fv.REGISTER_SCHEMA)
        & F.col("environment_id").isNotNull()
    )
    return registrations.join(
        environments.select("environment_id"), "environment_id", "left_anti"
    ).select(
        "event_id",
        "environment_id",
        "resource_name",
        "request_subject",
        "status",
        "schema_id",
    )


def skip_reasons(events: DataFrame, options: FeedOptions) -> DataFrame:
    """How many events stopped at each condition."""
    return events.groupBy(skip_reason(options).alias("reason")).agg(F.count("*").alias("events"))
