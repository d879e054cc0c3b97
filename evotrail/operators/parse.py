"""From JSON text to events, with the unreadable records kept apart."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evotrail import schemas
from evotrail.functions import event_fields as ef
from evotrail.options import FeedOptions

_JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": schemas.CORRUPT,
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def _bad_numbers(event: str) -> str:
    ints = [(f"{event}.{m}", ef.int_of(f"{event}.{m}")) for m in schemas.INT_MEMBERS]
    doubles = [(f"{event}.{m}", ef.double_of(f"{event}.{m}")) for m in schemas.DOUBLE_MEMBERS]
    return " OR ".join(ef.is_bad_number(text, number) for text, number in ints + doubles)


def _type_fault(event: str) -> str:
    """Why the JSON types of a record's members are wrong; null where they are right.

    ``from_json`` reads any value as text. Text members must not hold an object or an
    array, and a quoted int must be a whole number. Few records can be wrong, and the
    parsed members tell which, by their first character or by a character that is no
    digit: only those are parsed again, and only such members are looked up there, with
    their types.
    """
    nests = {
        path: f"(startswith({event}.{path}, '{{') OR startswith({event}.{path}, '['))"
        for path in schemas.TEXT_MEMBERS
    }
    odd = {path: f"{event}.{path} RLIKE '[^0-9]'" for path in schemas.INT_MEMBERS}

    def kind(path: str) -> str:
        return f"schema_of_variant(try_variant_get(v, '$.{path}', 'variant'))"

    nested = " OR ".join(
        f"({suspect} AND {kind(p)} RLIKE '^(OBJECT|ARRAY)')" for p, suspect in nests.items()
    )
    quoted = " OR ".join(
        f"({suspect} AND {kind(p)} = 'STRING'"
        f" AND trim(try_variant_get(v, '$.{p}', 'string')) NOT RLIKE '^([+-]?[0-9]+|null|)$')"
        for p, suspect in odd.items()
    )
    found = f"CASE WHEN {nested} THEN 'wrong_type' WHEN {quoted} THEN 'bad_number' END"
    return (
        f"CASE WHEN {' OR '.join([*nests.values(), *odd.values()])}"
        f" THEN get(transform(array(try_parse_json(value)), v -> {found}), 0) END"
    )


# Why a record holds no event; null where it does.
_REJECT_REASON = f"""CASE
  WHEN value IS NULL OR value = '' THEN 'empty'
  WHEN event IS NULL THEN 'no_content'
  WHEN event.{schemas.CORRUPT} IS NOT NULL THEN 'malformed'
  WHEN {_bad_numbers("event")} THEN 'bad_number'
  ELSE {_type_fault("event")} END"""

# The same test for one parsed event.
_READABLE = (
    f"e IS NOT NULL AND e.{schemas.CORRUPT} IS NULL AND NOT ({_bad_numbers('e')})"
    f" AND ({_type_fault('e')}) IS NULL"
)


def _parsed(schema: T.StructType) -> str:
    fields = T.StructType([*schema.fields, T.StructField(schemas.CORRUPT, T.StringType())])
    options = ", ".join(f"'{name}', '{value}'" for name, value in _JSON_OPTIONS.items())
    return f"from_json(value, '{fields.simpleString()}', map({options}))"


def with_event(log: DataFrame) -> DataFrame:
    """Add the parsed ``event`` and, for unreadable records, a ``reject_reason``.

    The parsed struct goes through a one-element ``explode``. Filters are then
    not pushed below the parse, where each predicate would parse the text anew.
    """
    parsed = _parsed(schemas.EVENT)
    return log.selectExpr("*", f"explode(array({parsed})) AS event").selectExpr(
        "*", f"{_REJECT_REASON} AS reject_reason"
    )


def parse_events(log: DataFrame) -> DataFrame:
    """The readable records, one ``event`` struct each; the raw text is dropped."""
    return log.selectExpr(
        "*", f"explode(filter(array({_parsed(schemas.EVENT)}), e -> {_READABLE})) AS event"
    ).drop("value")


def malformed_events(log: DataFrame) -> DataFrame:
    """The records that do not hold an event, with their text and the reason."""
    return with_event(log).filter("reject_reason IS NOT NULL").drop("event")


def may_mention(value: Column, methods: Sequence[str]) -> Column:
    """False only for text that cannot name any of the methods.

    A cheap test on the raw text that spares most records the JSON parse. JSON
    can spell a character of a method name only as itself or as a ``\\u``
    escape, so text with an escape always passes. Method names with characters
    that have short escapes (quotes, slashes) switch the test off.
    """
    if not all(re.fullmatch(r"[A-Za-z0-9._:-]+", m) for m in methods):
        return F.lit(True)
    return reduce(lambda a, b: a | b, [value.contains(m) for m in (*methods, "\\u")])


def derive_fields(events: DataFrame, options: FeedOptions) -> DataFrame:
    """Flatten ``event`` into the columns that the later operators use."""
    kept = [name for name in events.columns if name != "event"]
    base = events.selectExpr(
        *[f"`{name}`" for name in kept],
        *[f"{value} AS {name}" for name, value in ef.BASE_FIELDS.items()],
    )
    combined = base.selectExpr(
        "*", *[f"{value} AS {name}" for name, value in ef.COMBINED_FIELDS.items()]
    )
    return combined.selectExpr("*", f"{ef.dedup_key(options.key_scope)} AS dedup_key")


def audit_events(log: DataFrame, options: FeedOptions) -> DataFrame:
    """Readable records of the log as flat event columns."""
    return derive_fields(parse_events(log), options)


def change_candidates(log: DataFrame, options: FeedOptions) -> DataFrame:
    """Like ``audit_events``, without records that cannot name an allowed method.

    Only for results that depend on relevant events alone; counts of consumed
    or rejected records need ``audit_events``.
    """
    return audit_events(log.filter(may_mention(F.col("value"), options.allowed_methods)), options)
