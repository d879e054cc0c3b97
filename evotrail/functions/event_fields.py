"""SQL expressions over a parsed audit event in the struct column ``event``.

Struct access is null-safe, so absent ``data``, ``request`` or ``result``
members simply give null. The expressions come in two steps: ``BASE_FIELDS``
read the struct, ``COMBINED_FIELDS`` combine the results, so that nothing is
worked out twice and the generated code stays small enough to be compiled.
"""

from __future__ import annotations


from evotrail import fixed_values as fv


def int_of(text: str) -> str:
    """An int from number text; fractions are cut off, unreadable text is null."""
    return f"try_cast(try_cast({text} AS double) AS int)"


def double_of(text: str) -> str:
    """A double from number text; unreadable text is null."""
    return f"try_cast({text} AS double)"


def is_bad_number(text: str, converted: str) -> str:
    """Text that is neither a number nor one of the spellings of an absent one."""
    return f"({text} IS NOT NULL AND {converted} IS NULL AND trim({text}) NOT IN ('', 'null'))"


def saturating_int(number: str) -> str:
    """A double cut to an int: out-of-range values stop at the int limits, NaN is 0."""
    return (
        f"coalesce(try_cast({number} AS int), CASE WHEN isnan({number}) THEN 0"
        f" WHEN {number} > 0 THEN 2147483647 WHEN {number} < 0 THEN -2147483648 END)"
    )


def _first_environment(text: str) -> str:
    return f"get(regexp_extract_all({text}, '{fv.ENVIRONMENT_PATTERN}', 1), 0)"


_REQUEST = "event.data.request"

#: Columns read straight from the event.
BASE_FIELDS = {
    "event_id": "event.id",
    "type": "event.type",
    "event_time": "event.time",
    "has_data": "event.data IS NOT NULL",
    "has_request": f"{_REQUEST} IS NOT NULL",
    "method_name": "event.data.methodName",
    "resource_name": "event.data.resourceName",
    "status": "event.data.result.status",
    # The environment named in the resource name, else in the envelope's subject.
    "environment_id": (
        f"coalesce({_first_environment('event.data.resourceName')},"
        f" {_first_environment('event.subject')})"
    ),
    # The subject the request names: in its inner data, else at its top level.
    "request_subject": f"coalesce({_REQUEST}.data.subject, {_REQUEST}.subject)",
    # The log writes the id of a registered schema as a double.
    "result_id": double_of("event.data.result.data.id"),
    "request_version": int_of(f"{_REQUEST}.version"),
    "request_schema_type": f"{_REQUEST}.data.schemaType",
    "compatibility": f"{_REQUEST}.compatibility",
    "mode": f"{_REQUEST}.mode",
}

#: Columns that combine base columns. ``event_subject`` is what filters and keys
#: use. A registration's notification shows the requested subject, which may be
#: null, and falls back to the resource name only if there is no request at all;
#: all other changes show the resource name even if the request has a subject.
COMBINED_FIELDS = {
    "event_subject": "coalesce(request_subject, resource_name)",
    "notification_subject": (
        f"CASE WHEN method_name = '{fv.REGISTER_SCHEMA}' AND has_request"
        " THEN request_subject ELSE resource_name END"
    ),
    "schema_id": saturating_int("result_id"),
}


def dedup_key(scope: str = "subject") -> str:
    """``subject:method:schema id``, with absent parts printed as ``null``.

    The key holds no environment, version or time unless ``scope`` is
    ``"environment"``: equal subjects and ids of two environments share a key,
    and so do repeated deletions or updates of one subject. The scope ``"event"``
    adds the event id, which tells repeated changes apart.
    """
    key = (
        "CASE WHEN has_data THEN concat(coalesce(event_subject, 'null'), ':',"
        " coalesce(method_name, 'null'), ':', coalesce(CAST(schema_id AS string), 'null'))"
        f" ELSE '{fv.UNKNOWN}:{fv.UNKNOWN}:null' END"
    )
    if scope in ("environment", "event"):
        key = f"concat(coalesce(environment_id, 'null'), ':', {key})"
    if scope == "event":
        # In front, so that the key still ends in ``:method:id``.
        key = f"concat(coalesce(event_id, 'null'), ':', {key})"
    return key


def event_type(method: str) -> str:
    """The notification type for a method name; null for unknown methods."""
    types = fv.EVENT_TYPE_OF_METHOD.items()
    cases = " ".join(f"WHEN '{name}' THEN '{kind}'" for name, kind in types)
    return f"CASE {method} {cases} END"


def schema_type(registered_type: str, found: str, requested_type: str) -> str:
    """The registry's type if the schema was found, else the requested one, else AVRO."""
    return (
        f"coalesce(CASE WHEN {found} THEN {registered_type} ELSE {requested_type} END,"
        f" '{fv.DEFAULT_SCHEMA_TYPE}')"
    )


