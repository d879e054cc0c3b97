"""Text renderings of notifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evotrail import fixed_values as fv

# The member order of the JSON form.
JSON_MEMBERS = (
    "event_type",
    "schema_id",
    "subject",
    "version",
    "schema_type",
    "timestamp",
    "data_contract_registered",
    "data_contract_deleted",
    "subject_deleted",
    "compatibility_updated",
    "mode_updated",
    "audit_log_event_id",
    "environment_id",
)


def message_key(subject: Column) -> Column:
    """The key that keeps the changes of one subject in order."""
    return F.coalesce(subject, F.lit(fv.UNKNOWN))


def notification_json(pretty: bool = False) -> Column:
    """The notification columns as JSON without null members.

    Schema references are kept as text in the columns and become real JSON here.
    """
    registered = F.col("data_contract_registered")
    with_references = F.when(
        registered.isNotNull(),
        F.struct(
            registered["schema"].alias("schema"),
            F.try_parse_json(registered["references"]).alias("references"),
        ),
    ).alias("data_contract_registered")
    members = [
        with_references if name == "data_contract_registered" else F.col(name)
        for name in JSON_MEMBERS
    ]
    return F.to_json(F.struct(*members), {"pretty": "true"} if pretty else None)
