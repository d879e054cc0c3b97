"""An audit log and a registry snapshot derived from the test tables.

The test tables hold no audit log, so each row of ``events`` becomes one log
record with JSON text, and each row of ``part`` becomes one schema per monitored
environment. Everything is a per-row expression: no shuffle, no
window, no state, whatever the size of the tables. Offsets are event ids, so
they rise within each partition and have gaps, as in a compacted topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evotrail import fixed_values as fv
from evotrail.sources.files import exists

ORGANIZATION = "crn://cloud.example/organization=org1"
OTHER_EVENT_TYPE = "example.other.server/request"
MONITORED = ("env-0", "env-1")
READ_METHOD, FOREIGN_METHOD = "schema-registry.GetSubjects", "kafka.CreateTopics"

# Facts of an event row that the JSON text uses several times.
_FACTS = {
    "n": "event_id",
    "k": "CAST(get_json_object(props, '$.k') AS int)",
    # Two methods no option allows: another one of the registry, and a foreign one.
    "kind": """CASE event_id % 31 WHEN 3 THEN 'read' WHEN 7 THEN 'foreign'
      ELSE event_type END""",
    "partition": "CAST(user_id % 3 AS int)",
    "place": f"concat('{ORGANIZATION}/environment=env-', user_id % 4)",
    "prefix": "elt(CAST(user_id % 3 + 1 AS int), 'orders-', 'payments.', 'users-')",
}

_METHOD = f"""CASE kind
  WHEN 'signup' THEN '{fv.REGISTER_SCHEMA}'
  WHEN 'view' THEN '{fv.DELETE_SCHEMA}'
  WHEN 'click' THEN '{fv.DELETE_SUBJECT}'
  WHEN 'purchase' THEN '{fv.UPDATE_COMPATIBILITY}'
  WHEN 'error' THEN '{fv.UPDATE_MODE}'
  WHEN 'read' THEN '{READ_METHOD}'
  WHEN 'foreign' THEN '{FOREIGN_METHOD}' END"""

# A registered id is written as a whole or fractional double, beyond the int range, or
# quoted.
_RESULT_DATA = """named_struct(
  'id', CASE WHEN n % 43 = 6 THEN null WHEN n % 41 = 5 THEN 1e12D
    WHEN n % 17 = 4 THEN 100000.75D + k ELSE CAST(100000 + k AS double) END,
  'id', CASE WHEN n % 43 = 6 THEN concat(100000 + k, '.5') END)"""

# Versions are written as numbers or as quoted numbers, like the log does.
_REQUEST = """named_struct(
  'accessType', 'MODIFICATION',
  'subject', CASE WHEN n % 5 = 0 THEN named END,
  'data', CASE WHEN n % 5 <> 0 THEN named_struct(
    'subject', CASE WHEN n % 23 <> 0 THEN named END,
    'schemaType', elt(k % 3 + 1, 'AVRO', 'JSON', null)) END,
  'version', CASE WHEN n % 2 = 0 THEN k % 5 + 1 END,
  'version', CASE WHEN n % 2 = 1 THEN CAST(k % 5 + 1 AS string) END,
  'compatibility',
    CASE WHEN kind = 'purchase' THEN elt(k % 4 + 1, 'BACKWARD', 'FORWARD', 'FULL', 'NONE') END,
  'mode', CASE WHEN kind = 'error' THEN elt(k % 3 + 1, 'READWRITE', 'READONLY', 'IMPORT') END)"""

_DATA = f"""named_struct(
  'methodName', {_METHOD},
  'resourceName', CASE WHEN n % 13 = 0 THEN concat('subject=', named)
    ELSE concat(place, '/schema-registry=lsrc-1/subject=', named) END,
  'request', CASE WHEN n % 19 <> 0 THEN {_REQUEST} END,
  'result', CASE WHEN n % 29 <> 0 THEN named_struct(
    'status', CASE n % 7 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'success' WHEN 2 THEN 'sUcCess'
      WHEN 3 THEN 'SUCCESS ' ELSE 'SUCCESS' END,
    'data', CASE WHEN kind = 'signup' AND k % 20 <> 0 THEN {_RESULT_DATA} END) END)"""

_RECORD = f"""to_json(named_struct(
  'id', concat('evt-', n),
  'specversion', '1.0',
  'unknownField', 'extra',
  'type', CASE WHEN n % 11 = 10 THEN '{OTHER_EVENT_TYPE}' ELSE '{fv.SCHEMA_EVENT_TYPE}' END,
  'time', concat(replace(substring(CAST(ts AS string), 1, 19), ' ', 'T'), 'Z'),
  'subject', CASE WHEN n % 13 = 0 AND n % 39 <> 0 THEN place END,
  'data', CASE WHEN n % 101 <> 0 THEN {_DATA} END))"""

#: Unreadable records by event id modulo 97: text and reason.
UNREADABLE = {
    0: ("not json", "malformed"),
    1: ("", "empty"),
    2: ('{"id":"x","data":{"resourceName":{"a":1}}}', "wrong_type"),
    3: ('{"id":["x"]}', "wrong_type"),
    4: ('{"data":{"request":{"version":"3.7"}}}', "bad_number"),
    5: ('{"data":{"request":{"version":"2d"}}}', "bad_number"),
    6: ('{"data":{"request":{"version":true}}}', "bad_number"),
}
_UNREADABLE = " ".join(f"WHEN {n} THEN '{text}'" for n, (text, _) in UNREADABLE.items())

_TEXT = f"CASE n % 97 {_UNREADABLE} ELSE {_RECORD} END"
# Some records spell a letter of a method name as an escape. Only their text is searched.
_VALUE = """CASE WHEN n % 53 = 9
  THEN replace(text, '"schema-registry.Reg', '"schema-registry.\\\\u0052eg') ELSE text END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_log(spark: SparkSession, sf_dir: str, to_parse: bool = True) -> DataFrame:
    """The log: partition, offset, timestamp and JSON text of every event row.

    A folder that holds the log already rendered (``write_fixtures``) gives that. Else,
    with ``to_parse``, a one-element explode keeps filters on the text from rendering it
    twice; without it, the text is a plain column that is not rendered if not used.
    """
    if exists(spark, f"{sf_dir}/audit_log.parquet"):
        return table(spark, sf_dir, "audit_log")
    events = table(spark, sf_dir, "events")
    facts = events.selectExpr(
        "ts", *[f"{value} AS {name}" for name, value in _FACTS.items()]
    )
    named = facts.selectExpr("*", "concat(prefix, k, '-value') AS named")
    text = f"explode(array({_TEXT}))" if to_parse else _TEXT
    return named.selectExpr("partition", "n", "ts", f"{text} AS text").selectExpr(
        "partition", "n AS offset", "ts AS timestamp", f"{_VALUE} AS value"
    )


# An id's versions: under its own prefix, and under a second subject.
_VERSIONS = """array(
  named_struct('subject',
    concat(elt(CAST(p_partkey % 3 + 1 AS int), 'orders-', 'payments.', 'users-'),
      p_partkey, '-value'),
    'version', p_size),
  named_struct('subject', concat('orders-', p_partkey, '-value'),
    'version', CAST(p_partkey % 5 + 1 AS int)))"""


def registry_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's answers: a fifth of the ids not found, a tenth failing."""
    environments = ", ".join(f"'{e}'" for e in MONITORED)
    content = {
        "schema": "p_name",
        "schema_type": "elt(CAST(p_partkey % 4 + 1 AS int), null, 'AVRO', 'JSON', 'PROTOBUF')",
        "references": """CASE WHEN p_partkey % 6 = 1 THEN concat(
            '[{"name":"base","subject":"orders-', p_partkey, '-value","version":1}]') END""",
        "versions": f"CASE WHEN p_partkey % 7 <> 0 THEN {_VERSIONS} END",
    }
    return table(spark, sf_dir, "part").selectExpr(
        f"explode(array({environments})) AS environment_id",
        "CAST(100000 + p_partkey AS int) AS schema_id",
        "CASE WHEN p_partkey % 5 = 4 THEN 404 WHEN p_partkey % 10 = 3 THEN 500 ELSE 200 END"
        " AS http_status",
        *[f"CASE WHEN p_partkey % 5 <> 4 THEN {v} END AS {name}" for name, v in content.items()],
    )


def write_fixtures(spark: SparkSession, sf_dir: str, folder: str, files: int) -> None:
    """Render the log of the tables once, into ``files`` files of another folder."""
    log = audit_log(spark, sf_dir)
    log.repartition(files, "offset").write.mode("overwrite").parquet(f"{folder}/audit_log.parquet")


def monitored_environments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in MONITORED], "environment_id string")
