"""From relevant, enriched events to typed change notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail import fixed_values as fv
from evotrail import schemas
from evotrail.functions import event_fields as ef
from evotrail.functions.render import message_key, notification_json
from evotrail.operators.registry import FOUND
from evotrail.schemas import POSITION

_REGISTERED = f"event_type = '{fv.SCHEMA_REGISTERED}'"
_FOUND = f"registered.http_status = {FOUND}"

# The published columns, each in terms of an enriched event. A payload is null
# for all types but its own; a registration has one even if nothing was found.
_COLUMNS = {
    "event_type": "event_type",
    "environment_id": "environment_id",
    "subject": "notification_subject",
    "schema_id": f"CASE WHEN {_REGISTERED} THEN schema_id END",
    "version": f"""CASE WHEN {_REGISTERED} THEN registered.version
      WHEN event_type = '{fv.SCHEMA_DELETED}' THEN request_version END""",
    "schema_type": f"""CASE WHEN {_REGISTERED} THEN
      {ef.schema_type("registered.schema_type", _FOUND, "request_schema_type")} END""",
    "timestamp": "event_time",
    "audit_log_event_id": "event_id",
    "data_contract_registered": f"""CASE WHEN {_REGISTERED} THEN named_struct(
      'schema', registered.schema, 'references', registered.references) END""",
    "data_contract_deleted": f"""CASE WHEN event_type = '{fv.SCHEMA_DELETED}'
      THEN named_struct('permanent', false) END""",
    "subject_deleted": f"""CASE WHEN event_type = '{fv.SUBJECT_DELETED}'
      THEN named_struct('permanent', false, 'versions_deleted', CAST(null AS int)) END""",
    "compatibility_updated": f"""CASE WHEN event_type = '{fv.COMPATIBILITY_UPDATED}'
      THEN named_struct('new_compatibility', compatibility) END""",
    "mode_updated": f"""CASE WHEN event_type = '{fv.MODE_UPDATED}'
      THEN named_struct('new_mode', mode) END""",
}


def to_notifications(enriched: DataFrame) -> DataFrame:
    """One notification per event of a known method, in one pass over the events.

    Input is the result of ``registry.with_registered`` without failed lookups.
    The position columns are kept in front under ``log_*`` names, because a
    notification has its own ``timestamp``: the event's time as text.
    """
    typed = enriched.selectExpr("*", f"{ef.event_type('method_name')} AS event_type")
    return typed.filter("event_type IS NOT NULL").selectExpr(
        *[f"`{name}` AS log_{name}" for name in POSITION],
        "dedup_key",
        *[f"{value} AS {name}" for name, value in _COLUMNS.items()],
    )


def published(notifications: DataFrame) -> DataFrame:
    """Only the published columns, in their published order."""
    return notifications.select(*schemas.NOTIFICATION.fieldNames())


def keyed_rows(notifications: DataFrame) -> DataFrame:
    """Message key and the notification as one struct column ``value``."""
    return notifications.select(
        message_key(F.col("subject")).alias("key"),
        F.struct(*schemas.NOTIFICATION.fieldNames()).alias("value"),
    )


def json_rows(notifications: DataFrame, pretty: bool = False) -> DataFrame:
    """Message key and the notification as JSON text without null members."""
    return notifications.select(
        message_key(F.col("subject")).alias("key"), notification_json(pretty).alias("value")
    )


def avro_rows(notifications: DataFrame, namespace: str) -> DataFrame:
    """Message key and the notification as Avro bytes; needs Spark's Avro package."""
    from pyspark.sql.avro.functions import to_avro

    return keyed_rows(notifications).select(
        "key", to_avro("value", schemas.notification_avro_schema(namespace)).alias("value")
    )
