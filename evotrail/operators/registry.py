"""Lookups in a snapshot of the schema registry.

A snapshot holds one row per environment and schema id (``schemas.REGISTRY``).
``http_status`` keeps the three answers of a registry apart: 200 found, 404 not
found, anything else a failed fetch. An id without a row is not found.

No join here carries a broadcast hint. Spark broadcasts a snapshot whose size
is known to be small; a large one is joined by shuffle, and adaptive execution
splits the partitions of schema ids that very many events share.

Spark judges that size by the snapshot's compressed files, which its rows outgrow many
times. Lookups of distinct requests therefore never broadcast it (``_answers``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail import fixed_values as fv
from evotrail.schemas import POSITION
from evotrail.staging import staged_table

FOUND, NOT_FOUND = 200, 404

HIT = "hit"
MISSING = "not_found"
FAILED = "error"
NO_ID = "no_schema_id"


# The first (subject, version) pair of an id; null for an empty or absent list.
FIRST_VERSION = "get(versions, 0)"


def _if_found(value: str) -> str:
    return f"CASE WHEN http_status = {FOUND} THEN {value} END"


_DETAILS = {
    "schema": _if_found("schema"),
    "schema_type": _if_found(f"coalesce(schema_type, '{fv.DEFAULT_SCHEMA_TYPE}')"),
    "references": _if_found("references"),
}


def schema_info(snapshot: DataFrame) -> DataFrame:
    """The answer to a lookup by id: text, type (AVRO by default), first subject and version."""
    return snapshot.selectExpr(
        "environment_id",
        "schema_id",
        "http_status",
        f"{_if_found(FIRST_VERSION + '.subject')} AS subject",
        f"{_if_found(FIRST_VERSION + '.version')} AS version",
        *[f"{value} AS {name}" for name, value in _DETAILS.items()],
    )


# Only registrations with a schema id and an environment ask the registry.
NEEDS_LOOKUP = (
    f"method_name = '{fv.REGISTER_SCHEMA}' AND schema_id IS NOT NULL"
    " AND environment_id IS NOT NULL"
)

# The join key of an event: its schema id, or a number no schema can have.
# Events that ask nothing match nothing. Were their key null, a shuffle join
# would send all of them to one task, so they get numbers below the int range
# that differ from event to event.
_LOOKUP_ID = f"""CASE WHEN {NEEDS_LOOKUP} THEN CAST(schema_id AS bigint)
  ELSE -8589934592 - pmod(xxhash64({", ".join(f"`{p}`" for p in POSITION)}), 1048576) END"""

# The result of a lookup from the status of the matched row, if any.
OUTCOME = f"""CASE WHEN http_status = {FOUND} THEN '{HIT}'
  WHEN http_status IS NULL OR http_status = {NOT_FOUND} THEN '{MISSING}'
  ELSE '{FAILED}' END"""


def _failing(snapshot: DataFrame) -> DataFrame:
    """The snapshot's failed rows, two narrow columns and the status."""
    return snapshot.filter(~F.col("http_status").isin(FOUND, NOT_FOUND)).select(
        "environment_id",
        F.col("schema_id").cast("long").alias("lookup_id"),
        F.col("http_status").alias("failed_status"),
    )


def drop_failed_lookups(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Without the registrations whose schema could not be fetched.

    Reads two narrow columns of the failed rows only, so the other side of this
    join stays small even for a large snapshot.
    """
    return (
        events.selectExpr("*", f"{_LOOKUP_ID} AS lookup_id")
        .join(_failing(snapshot), ["environment_id", "lookup_id"], "left_anti")
        .drop("lookup_id")
    )


def with_failed_status(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Add ``failed_status``: the status of a failed lookup, null for all other events."""
    return (
        events.selectExpr("*", f"{_LOOKUP_ID} AS lookup_id")
        .join(_failing(snapshot), ["environment_id", "lookup_id"], "left")
        .drop("lookup_id")
    )


def with_registered(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Add ``registered`` (the found schema) and ``lookup_outcome``.

    ``lookup_outcome`` is null for events that are not registrations.
    """
    info = schema_info(snapshot).selectExpr(
        "environment_id",
        "CAST(schema_id AS bigint) AS lookup_id",
        "struct(http_status, subject, version, schema, schema_type, references) AS registered",
    )
    joined = events.selectExpr("*", f"{_LOOKUP_ID} AS lookup_id").join(
        info, ["environment_id", "lookup_id"], "left"
    )
    asked = OUTCOME.replace("http_status", "registered.http_status")
    result = f"""CASE WHEN {NEEDS_LOOKUP} THEN {asked}
      WHEN method_name = '{fv.REGISTER_SCHEMA}' THEN '{NO_ID}' END"""
    return joined.selectExpr("*", f"{result} AS lookup_outcome").drop("lookup_id")


def with_registered_apart(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Like ``with_registered``, for stored or shuffled events that may be read twice.

    Only the events that look something up meet the snapshot; the others pass by.
    """
    asks = F.coalesce(F.expr(NEEDS_LOOKUP), F.lit(False))
    asking = with_registered(events.filter(asks), snapshot)
    none = F.lit(None).cast(asking.schema["registered"].dataType)
    outcome = F.when(F.col("method_name") == fv.REGISTER_SCHEMA, F.lit(NO_ID))
    passing = events.filter(~asks).select(
        *[c for c in asking.columns if c not in ("registered", "lookup_outcome")],
        none.alias("registered"),
        outcome.alias("lookup_outcome"),
    )
    return asking.unionByName(passing)


def failed_lookups(events: DataFrame) -> DataFrame:
    """Registrations left out of the feed because the registry did not answer.

    Input holds ``failed_status`` (``with_failed_status``).
    """
    return events.filter("failed_status IS NOT NULL").select(
        "event_id", "environment_id", "schema_id", F.col("failed_status").alias("http_status")
    )


def _answers(requests: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct request with its answer, if any.

    The requests are stored, so their size is known. They choose the answers that are
    asked for; only those are moved, and sorted rather than held whole by a task.
    """
    distinct = staged_table(requests.select(*keys).distinct())
    asked = answers.join(distinct, keys, "left_semi").hint("merge")
    joined = distinct.join(asked, keys, "left")
    return joined.withColumn("outcome", F.expr(OUTCOME)).drop("http_status")


def by_id(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Answer (environment_id, schema_id) requests, each distinct one once."""
    return _answers(requests, schema_info(snapshot), ["environment_id", "schema_id"])


def by_subject_version(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Answer (environment_id, subject, version) requests, each distinct one once."""
    versions = snapshot.selectExpr(
        "environment_id",
        "schema_id",
        "http_status",
        *[f"{value} AS {name}" for name, value in _DETAILS.items()],
        "inline(array_distinct(versions))",
    )
    return _answers(requests, versions, ["environment_id", "subject", "version"])
