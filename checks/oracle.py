"""SQL that gives the expected result of each query straight from the tables.

The SQL never builds or parses the JSON log (only ``scan_audit_log`` checks the
text itself): it restates what each record says from the columns of ``events``
and ``part``, so it shares no logic with the Spark side.
"""

from __future__ import annotations

from evotrail import fixed_values as fv
from checks.derived_tables import (
    FOREIGN_METHOD,
    ORGANIZATION,
    OTHER_EVENT_TYPE,
    READ_METHOD,
    UNREADABLE,
)

RANGE_START, RANGE_END = "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"
SPLIT = "TIMESTAMP '2024-01-15 00:00:00'"
PRUNE_LIMIT, PRUNED_AT_ONCE = 500, 100

_KIND = "CASE event_id % 31 WHEN 3 THEN 'read' WHEN 7 THEN 'foreign' ELSE event_type END"
_METHOD = f"""CASE {_KIND} WHEN 'read' THEN '{READ_METHOD}' WHEN 'foreign' THEN '{FOREIGN_METHOD}'
 WHEN 'signup' THEN '{fv.REGISTER_SCHEMA}'
 WHEN 'view' THEN '{fv.DELETE_SCHEMA}' WHEN 'click' THEN '{fv.DELETE_SUBJECT}'
 WHEN 'purchase' THEN '{fv.UPDATE_COMPATIBILITY}' WHEN 'error' THEN '{fv.UPDATE_MODE}' END"""

_BAD = ", ".join(map(str, UNREADABLE))


def _by_bad(place: int) -> str:
    return " ".join(f"WHEN {n} THEN '{pair[place]}'" for n, pair in UNREADABLE.items())


# One row per log record, with what its JSON says.
_RECORDS = f"""
source AS (
  SELECT event_id AS n, ts, {_KIND} AS kind,
    CAST(user_id % 3 AS INTEGER) AS "partition", event_id AS "offset",
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    {_METHOD} AS method, 'env-' || (user_id % 4) AS env,
    CASE user_id % 3 WHEN 0 THEN 'orders-' WHEN 1 THEN 'payments.' ELSE 'users-' END
      || CAST(json_extract_string(props, '$.k') AS INTEGER) || '-value' AS named,
    CASE event_id % 7 WHEN 0 THEN 'FAILURE' WHEN 1 THEN 'success' WHEN 2 THEN 'sUcCess'
      WHEN 3 THEN 'SUCCESS ' ELSE 'SUCCESS' END AS outcome
  FROM events),
facts AS (
  SELECT *,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time,
    '{ORGANIZATION}/environment=' || env AS place,
    n % 101 <> 0 AS has_data,
    n % 101 <> 0 AND n % 19 <> 0 AS has_request,
    n % 101 <> 0 AND n % 29 <> 0 AS has_result
  FROM source),
parsed AS (
  SELECT n, ts, "partition", "offset", k, kind, event_time, has_data, has_request,
    'evt-' || n AS event_id,
    CASE WHEN n % 11 = 10 THEN '{OTHER_EVENT_TYPE}' ELSE '{fv.SCHEMA_EVENT_TYPE}' END AS type,
    CASE WHEN n % 13 = 0 AND n % 39 <> 0 THEN place END AS envelope_subject,
    CASE WHEN has_data THEN method END AS method_name,
    CASE WHEN NOT has_data THEN NULL WHEN n % 13 = 0 THEN 'subject=' || named
      ELSE place || '/schema-registry=lsrc-1/subject=' || named END AS resource_name,
    CASE WHEN has_request AND n % 5 = 0 THEN named END AS request_top_subject,
    CASE WHEN has_request AND n % 5 <> 0 AND n % 23 <> 0 THEN named END AS request_data_subject,
    CASE WHEN has_request AND n % 5 <> 0 THEN
      CASE k % 3 WHEN 0 THEN 'AVRO' WHEN 1 THEN 'JSON' END END AS request_schema_type,
    CASE WHEN has_request THEN k % 5 + 1 END AS request_version,
    CASE WHEN has_request AND kind = 'purchase' THEN
      CASE k % 4 WHEN 0 THEN 'BACKWARD' WHEN 1 THEN 'FORWARD' WHEN 2 THEN 'FULL'
        ELSE 'NONE' END END AS compatibility,
    CASE WHEN has_request AND kind = 'error' THEN
      CASE k % 3 WHEN 0 THEN 'READWRITE' WHEN 1 THEN 'READONLY' ELSE 'IMPORT' END END AS mode,
    CASE WHEN has_result THEN outcome END AS status,
    CASE WHEN has_result AND kind = 'signup' AND k % 20 <> 0 THEN
      CASE WHEN n % 43 <> 6 AND n % 41 = 5 THEN 2147483647 ELSE 100000 + k END END AS schema_id,
    CASE WHEN has_result AND kind = 'signup' AND k % 20 <> 0 THEN
      CASE WHEN n % 43 <> 6 AND n % 41 = 5 THEN 1000000000000 ELSE 100000 + k END END
      AS written_id,
    CASE WHEN has_data AND n % 13 <> 0 THEN env
      WHEN n % 13 = 0 AND n % 39 <> 0 THEN env END AS environment_id
  FROM facts WHERE n % 97 NOT IN ({_BAD})),
subjects AS (
  SELECT *, coalesce(request_data_subject, request_top_subject) AS request_subject,
    coalesce(request_data_subject, request_top_subject, resource_name) AS event_subject
  FROM parsed),
audit AS (
  SELECT *,
    CASE WHEN kind = 'signup' AND has_request THEN request_subject
      ELSE resource_name END AS notification_subject,
    CASE WHEN has_data THEN coalesce(event_subject, 'null') || ':' || method_name || ':'
      || coalesce(CAST(schema_id AS VARCHAR), 'null')
      ELSE 'unknown:unknown:null' END AS dedup_key
  FROM subjects)"""

_REGISTRY = """
answers AS (
  SELECT environment_id, CAST(100000 + p_partkey AS INTEGER) AS schema_id,
    p_partkey % 5 <> 4 AS exists_there, p_partkey % 10 <> 3 AS answered, p_partkey, p_size, p_name
  FROM part, (VALUES ('env-0'), ('env-1')) AS monitored(environment_id)),
registry AS (
  SELECT environment_id, schema_id, exists_there, p_partkey, p_size,
    CASE WHEN exists_there THEN answered END AS found,
    CASE WHEN exists_there THEN p_name END AS schema_text,
    CASE WHEN exists_there THEN
      CASE p_partkey % 4 WHEN 2 THEN 'JSON' WHEN 3 THEN 'PROTOBUF' ELSE 'AVRO' END
      END AS schema_type,
    CASE WHEN exists_there AND p_partkey % 6 = 1 THEN '[{"name":"base","subject":"orders-'
      || p_partkey || '-value","version":1}]' END AS schema_references,
    CASE WHEN exists_there AND p_partkey % 7 <> 0 THEN
      CASE p_partkey % 3 WHEN 0 THEN 'orders-' WHEN 1 THEN 'payments.' ELSE 'users-' END
      || p_partkey || '-value' END AS first_subject,
    CASE WHEN exists_there AND p_partkey % 7 <> 0 THEN p_size END AS first_version
  FROM answers)"""

_ALL_KINDS = "kind IN ('signup', 'view', 'click', 'purchase', 'error')"
_SCHEMA_KINDS = "kind IN ('signup', 'view', 'click')"
_SUBJECTS = (
    "(event_subject LIKE 'orders-%' OR event_subject LIKE 'payments.1%'"
    " OR regexp_full_match(event_subject, 'users-[0-4].*-value')"
    " OR event_subject = 'users-7-value')"
)


def _feed(
    kinds: str = _ALL_KINDS,
    also: str = "TRUE",
    key: str = "dedup_key",
    records: str = _RECORDS,
) -> str:
    """CTEs: relevant events, those with their lookup, and the first of each key."""
    return f"""WITH {records}, {_REGISTRY},
relevant AS (
  SELECT * FROM audit
  WHERE n % 11 <> 10 AND has_data AND {kinds} AND environment_id IN ('env-0', 'env-1')
    AND upper(status) = 'SUCCESS' AND {also}),
enriched AS (
  SELECT e.*, r.found, r.first_subject, r.first_version, r.schema_text,
    r.schema_type AS registered_type, r.schema_references
  FROM relevant e LEFT JOIN registry r
    ON e.kind = 'signup' AND e.environment_id = r.environment_id AND e.schema_id = r.schema_id),
sendable AS (SELECT * FROM enriched WHERE found IS NULL OR found),
sent AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY {key} ORDER BY ts, "partition", "offset") AS nth FROM sendable) AS ranked
  WHERE nth = 1)"""


_NOTIFICATION_TYPE = f"""CASE kind WHEN 'signup' THEN '{fv.SCHEMA_REGISTERED}'
  WHEN 'view' THEN '{fv.SCHEMA_DELETED}' WHEN 'click' THEN '{fv.SUBJECT_DELETED}'
  WHEN 'purchase' THEN '{fv.COMPATIBILITY_UPDATED}' WHEN 'error' THEN '{fv.MODE_UPDATED}' END"""

_FLAT = f"""SELECT {_NOTIFICATION_TYPE} AS event_type, environment_id,
  notification_subject AS subject, schema_id,
  CASE WHEN kind = 'signup' THEN first_version WHEN kind = 'view' THEN request_version END
    AS version,
  CASE WHEN kind = 'signup' THEN coalesce(registered_type, request_schema_type, 'AVRO') END
    AS schema_type,
  event_time, event_id AS audit_log_event_id, kind = 'signup' AS has_registered,
  schema_text, schema_references,
  CASE WHEN kind IN ('view', 'click') THEN FALSE END AS permanent,
  CAST(NULL AS INTEGER) AS versions_deleted,
  compatibility AS new_compatibility, mode AS new_mode"""


def _audit(select: str) -> str:
    return f"WITH {_RECORDS} {select}"


def _kind_query(kind: str) -> str:
    return f"{_feed(kinds=f'kind = {chr(39)}{kind}{chr(39)}')} {_FLAT} FROM sendable"


def _piece(member: str, value: str, condition: str) -> str:
    """A string member of a JSON object with its leading comma, where present."""
    return f"""CASE WHEN {condition} THEN ',"{member}":"' || {value} || '"' ELSE '' END"""


_VERSION = "(CAST(k % 5 + 1 AS VARCHAR))"
_REQUEST_JSON = f"""',"request":{{"accessType":"MODIFICATION"'
  || {_piece("subject", "named", "n % 5 = 0")}
  || CASE WHEN n % 5 <> 0 THEN ',"data":{{' || substr(
       {_piece("subject", "named", "n % 23 <> 0")}
       || {_piece("schemaType", "CASE k % 3 WHEN 0 THEN 'AVRO' ELSE 'JSON' END", "k % 3 <> 2")},
       2) || '}}' ELSE '' END
  || ',"version":' || CASE WHEN n % 2 = 1 THEN '"' || {_VERSION} || '"' ELSE {_VERSION} END
  || {_piece(
      "compatibility",
      "CASE k % 4 WHEN 0 THEN 'BACKWARD' WHEN 1 THEN 'FORWARD' WHEN 2 THEN 'FULL' ELSE 'NONE' END",
      "kind = 'purchase'",
  )}
  || {_piece(
      "mode",
      "CASE k % 3 WHEN 0 THEN 'READWRITE' WHEN 1 THEN 'READONLY' ELSE 'IMPORT' END",
      "kind = 'error'",
  )} || '}}'"""
_RESULT_JSON = """',"result":{"status":"' || outcome || '"'
  || CASE WHEN kind = 'signup' AND k % 20 <> 0
     THEN ',"data":{"id":' || CASE WHEN n % 43 = 6 THEN '"' || (100000 + k) || '.5"'
       WHEN n % 41 = 5 THEN '1.0E12' WHEN n % 17 = 4 THEN (100000 + k) || '.75'
       ELSE (100000 + k) || '.0' END || '}' ELSE '' END || '}'"""
_SCAN = f"""WITH {_RECORDS}
SELECT "partition", "offset", CAST(ts AS VARCHAR) AS log_time,
  CASE n % 97 {_by_bad(0)} ELSE replace(
  '{{"id":"evt-' || n || '","specversion":"1.0","unknownField":"extra"'
  || ',"type":"' || CASE WHEN n % 11 = 10 THEN '{OTHER_EVENT_TYPE}'
      ELSE '{fv.SCHEMA_EVENT_TYPE}' END || '"'
  || ',"time":"' || event_time || '"'
  || {_piece("subject", "place", "n % 13 = 0 AND n % 39 <> 0")}
  || CASE WHEN has_data THEN ',"data":{{"methodName":"' || method || '","resourceName":"'
      || CASE WHEN n % 13 = 0 THEN 'subject=' || named
         ELSE place || '/schema-registry=lsrc-1/subject=' || named END || '"'
      || CASE WHEN has_request THEN {_REQUEST_JSON} ELSE '' END
      || CASE WHEN has_result THEN {_RESULT_JSON} ELSE '' END || '}}' ELSE '' END
  || '}}', '"schema-registry.Reg',
    CASE WHEN n % 53 = 9 THEN '"schema-registry.\\u0052eg' ELSE '"schema-registry.Reg' END)
  END AS value
FROM facts"""

_POSITIONS = 'SELECT "partition", "offset", CAST(ts AS VARCHAR) AS log_time FROM source'
_STARTS = f"""(SELECT "partition" AS p, min("offset") AS lowest FROM source
  WHERE ts >= {{at}} GROUP BY "partition") AS starts"""

_LOOKUP = """CASE WHEN schema_id IS NULL THEN 'no_schema_id'
  WHEN found IS NULL THEN 'not_found' WHEN found THEN 'hit' ELSE 'error' END"""
_DELETED_NAMES = """
requests AS (
  SELECT DISTINCT environment_id, event_subject AS subject, request_version AS version
  FROM audit WHERE kind = 'view' AND method_name IS NOT NULL AND environment_id IS NOT NULL
    AND request_version IS NOT NULL),
named_versions AS (
  SELECT environment_id, first_subject AS subject, p_size AS version, found, schema_id,
    schema_text, schema_type FROM registry WHERE exists_there AND p_partkey % 7 <> 0
  UNION
  SELECT environment_id, 'orders-' || p_partkey || '-value',
    CAST(p_partkey % 5 + 1 AS INTEGER), found, schema_id, schema_text, schema_type
  FROM registry WHERE exists_there AND p_partkey % 7 <> 0)"""

_JSON_OF = {
    "signup": """',"data_contract_registered":{' || substr(
        CASE WHEN schema_text IS NOT NULL THEN ',"schema":"' || schema_text || '"' ELSE '' END
        || CASE WHEN schema_references IS NOT NULL
           THEN ',"references":' || schema_references ELSE '' END, 2) || '}'""",
    "view": """',"data_contract_deleted":{"permanent":false}'""",
    "click": """',"subject_deleted":{"permanent":false}'""",
    "purchase": """',"compatibility_updated":{' || CASE WHEN compatibility IS NOT NULL
        THEN '"new_compatibility":"' || compatibility || '"' ELSE '' END || '}'""",
    "error": """',"mode_updated":{' || CASE WHEN mode IS NOT NULL
        THEN '"new_mode":"' || mode || '"' ELSE '' END || '}'""",
}
_PAYLOAD = " ".join(f"WHEN '{kind}' THEN {text}" for kind, text in _JSON_OF.items())
_JSON = f"""{_feed()}, flat AS ({_FLAT}, kind, compatibility, mode FROM sent)
SELECT coalesce(subject, 'unknown') AS key, '{{"event_type":"' || event_type || '"'
  || CASE WHEN schema_id IS NOT NULL THEN ',"schema_id":' || schema_id ELSE '' END
  || {_piece("subject", "subject", "subject IS NOT NULL")}
  || CASE WHEN version IS NOT NULL THEN ',"version":' || version ELSE '' END
  || {_piece("schema_type", "schema_type", "schema_type IS NOT NULL")}
  || ',"timestamp":"' || event_time || '"'
  || CASE kind {_PAYLOAD} END
  || ',"audit_log_event_id":"' || audit_log_event_id || '"'
  || ',"environment_id":"' || environment_id || '"}}' AS value
FROM flat"""

# A run up to the split, and the run that follows from its start offsets on.
_FROM_SPLIT = f"""JOIN {_STARTS.format(at=SPLIT)} ON a."partition" = starts.p
  AND a."offset" >= starts.lowest"""
_SECOND_RUN = f"""{_feed()},
state AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY dedup_key ORDER BY ts, "partition", "offset") AS place
    FROM sendable WHERE ts <= {SPLIT}) AS early
  WHERE place = 1),
later AS (
  SELECT * FROM (
    SELECT a.*, row_number() OVER (
      PARTITION BY dedup_key ORDER BY ts, "partition", "offset") AS place
    FROM sendable a {_FROM_SPLIT}
    WHERE dedup_key NOT IN (SELECT dedup_key FROM state)) AS late
  WHERE place = 1)"""

_AFTER = "(a.ts, a.\"partition\", a.\"offset\") > (s.ts, s.\"partition\", s.\"offset\")"
_DUPLICATES = f"FROM audit a JOIN sent s ON a.dedup_key = s.dedup_key WHERE {_AFTER}"


def _counters(kinds: str) -> str:
    return f"""{_feed(kinds=kinds)}
SELECT (SELECT count(*) FROM audit) AS events_consumed,
  (SELECT count(*) FROM sent) AS events_processed,
  (SELECT count(*) FROM sent) AS notifications_produced,
  (SELECT count(*) {_DUPLICATES}) AS duplicates_skipped"""


_KEYS = "(SELECT count(*) FROM sent)"
_ORACLE_KEPT = f"""CASE WHEN {_KEYS} <= {PRUNE_LIMIT} THEN {_KEYS}
  ELSE {PRUNE_LIMIT - PRUNED_AT_ONCE + 1}
    + ({_KEYS} - {PRUNE_LIMIT + 1}) % {PRUNED_AT_ONCE} END"""

ORACLE: dict[str, str] = {
    "scan_audit_log": _SCAN,
    "mode_backfill": f"WITH {_RECORDS} {_POSITIONS}",
    "mode_backfill_bounded": f"""WITH {_RECORDS}
      SELECT s."partition", s."offset", CAST(ts AS VARCHAR) AS log_time FROM source s
      JOIN (SELECT "partition" AS p, max("offset") AS last FROM source
            WHERE ts <= {RANGE_END} GROUP BY "partition") AS ends
        ON s."partition" = ends.p AND s."offset" <= ends.last""",
    "mode_timestamp_start": f"""WITH {_RECORDS}
      SELECT a."partition", a."offset", CAST(ts AS VARCHAR) AS log_time FROM source a
      JOIN {_STARTS.format(at=RANGE_START)} ON a."partition" = starts.p
        AND a."offset" >= starts.lowest""",
    "mode_timestamp_range": f"""WITH {_RECORDS}
      SELECT a."partition", a."offset", CAST(ts AS VARCHAR) AS log_time FROM source a
      JOIN {_STARTS.format(at=RANGE_START)} ON a."partition" = starts.p
        AND a."offset" >= starts.lowest
      WHERE ts <= {RANGE_END}""",
    "registry_by_id": f"""WITH {_RECORDS}, {_REGISTRY},
      requests AS (SELECT DISTINCT environment_id, schema_id FROM audit
        WHERE kind = 'signup' AND method_name IS NOT NULL AND schema_id IS NOT NULL
          AND environment_id IS NOT NULL)
      SELECT q.environment_id, q.schema_id,
        CASE WHEN r.found IS NULL THEN 'not_found' WHEN r.found THEN 'hit'
          ELSE 'error' END AS outcome,
        CASE WHEN r.found THEN first_subject END AS subject,
        CASE WHEN r.found THEN first_version END AS version,
        CASE WHEN r.found THEN schema_text END AS schema_text,
        CASE WHEN r.found THEN schema_type END AS schema_type,
        CASE WHEN r.found THEN schema_references END AS schema_references
      FROM requests q LEFT JOIN registry r
        ON q.environment_id = r.environment_id AND q.schema_id = r.schema_id""",
    "registry_first_version": f"""WITH {_REGISTRY}
      SELECT environment_id, schema_id, first_subject AS subject, first_version AS version
      FROM registry""",
    "registry_by_subject_version": f"""WITH {_RECORDS}, {_REGISTRY}, {_DELETED_NAMES}
      SELECT q.environment_id, q.subject, q.version,
        CASE WHEN v.found IS NULL THEN 'not_found' WHEN v.found THEN 'hit'
          ELSE 'error' END AS outcome,
        v.schema_id, CASE WHEN v.found THEN v.schema_text END AS schema_text,
        CASE WHEN v.found THEN v.schema_type END AS schema_type
      FROM requests q LEFT JOIN named_versions v
        ON q.environment_id = v.environment_id AND q.subject = v.subject
          AND q.version = v.version""",
    "parse_events": _audit(
        """SELECT event_id, '1.0' AS specversion, type, event_time, envelope_subject,
        method_name, resource_name,
        CASE WHEN has_request THEN 'MODIFICATION' END AS access_type, request_top_subject,
        request_data_subject, request_schema_type, compatibility, mode, status FROM audit"""
    ),
    "malformed_events": f"""WITH {_RECORDS}
      SELECT "partition", "offset", CASE n % 97 {_by_bad(0)} END AS value,
        CASE n % 97 {_by_bad(1)} END AS reject_reason
      FROM source WHERE n % 97 IN ({_BAD})""",
    "coerce_numeric_fields": _audit(
        "SELECT event_id, request_version, CAST(written_id AS BIGINT) AS result_id FROM audit"
    ),
    "resolve_subject": _audit(
        "SELECT event_id, request_subject, event_subject, notification_subject FROM audit"
    ),
    "extract_environment": _audit("SELECT event_id, environment_id FROM audit"),
    "extract_schema_id": _audit("SELECT event_id, schema_id FROM audit"),
    "event_type_mapping": _audit(
        f"""SELECT event_id, method_name,
        CASE WHEN method_name IS NOT NULL THEN {_NOTIFICATION_TYPE} END AS event_type
        FROM audit"""
    ),
    "dedup_key": _audit("SELECT event_id, dedup_key FROM audit"),
    "filter_event_type": _audit("SELECT event_id FROM audit WHERE n % 11 <> 10 AND has_data"),
    "filter_methods": _audit(f"SELECT event_id FROM audit WHERE has_data AND {_SCHEMA_KINDS}"),
    "filter_methods_with_config": _audit(
        f"SELECT event_id FROM audit WHERE has_data AND {_ALL_KINDS}"
    ),
    "filter_environment": _audit(
        """SELECT event_id, environment_id FROM audit
        WHERE environment_id IN ('env-0', 'env-1')"""
    ),
    "filter_status": _audit("SELECT event_id FROM audit WHERE upper(status) = 'SUCCESS'"),
    "filter_subject": _audit(f"SELECT event_id, event_subject FROM audit WHERE {_SUBJECTS}"),
    "filter_subject_glob": _audit(
        """SELECT event_id, event_subject FROM audit
        WHERE event_subject LIKE 'orders-%' OR event_subject LIKE 'payments.1%'
          OR regexp_full_match(event_subject, 'users-[0-4].*-value')"""
    ),
    "filter_subject_table": _audit(
        """SELECT event_id, event_subject FROM audit WHERE EXISTS (
          SELECT 1 FROM part WHERE p_size <= 20 AND event_subject LIKE
            CASE p_partkey % 4 WHEN 0 THEN 'orders-' || p_partkey || '-value'
              WHEN 1 THEN 'payments.' || p_partkey || '%'
              WHEN 2 THEN '%-' || p_partkey || '-value'
              ELSE '%s-' || p_partkey || '-v%' END)"""
    ),
    "filter_subject_exact": _audit(
        "SELECT event_id, event_subject FROM audit WHERE event_subject = 'users-7-value'"
    ),
    "relevant_events": f"""{_feed()}
      SELECT event_id, method_name, environment_id, event_subject FROM relevant""",
    "skip_reasons": _audit(
        f"""SELECT CASE WHEN n % 11 = 10 THEN 'event_type' WHEN NOT has_data THEN 'no_data'
          WHEN NOT {_ALL_KINDS} THEN 'method'
          WHEN environment_id IS NULL THEN 'no_environment'
          WHEN environment_id NOT IN ('env-0', 'env-1') THEN 'unmonitored_environment'
          WHEN status IS NULL OR upper(status) <> 'SUCCESS' THEN 'not_successful'
          WHEN event_subject IS NULL OR NOT {_SUBJECTS} THEN 'subject'
          ELSE 'relevant' END AS reason, count(*) AS events
        FROM audit GROUP BY 1"""
    ),
    "unmonitored_registrations": _audit(
        """SELECT event_id, environment_id, resource_name, request_subject, status, schema_id
        FROM audit WHERE n % 11 <> 10 AND has_data AND kind = 'signup'
          AND environment_id NOT IN ('env-0', 'env-1')"""
    ),
    "enrich_registrations": f"""{_feed()}
      SELECT event_id, environment_id, schema_id, {_LOOKUP} AS lookup_outcome,
        CASE WHEN found THEN first_subject END AS registered_subject,
        CASE WHEN found THEN first_version END AS version,
        CASE WHEN found THEN schema_text END AS schema_text,
        CASE WHEN found THEN registered_type END AS registered_type
      FROM enriched WHERE kind = 'signup'""",
    "enrich_outcomes": f"""{_feed()}
      SELECT {_LOOKUP} AS lookup_outcome, count(*) AS events FROM enriched
      WHERE kind = 'signup' GROUP BY 1""",
    "schema_type_default": f"""{_feed()}
      SELECT event_id, CASE WHEN found THEN registered_type
        ELSE coalesce(request_schema_type, 'AVRO') END AS schema_type
      FROM enriched WHERE kind = 'signup'""",
    "failed_lookups": f"""{_feed()}
      SELECT event_id, environment_id, schema_id, 500 AS http_status
      FROM enriched WHERE NOT found""",
    "late_lookups": f"""{_SECOND_RUN},
      pool AS (
        SELECT dedup_key, event_id, ts, "partition", "offset" FROM enriched
        WHERE ts <= {SPLIT} AND NOT found
        UNION ALL
        SELECT a.dedup_key, a.event_id, a.ts, a."partition", a."offset"
        FROM enriched a {_FROM_SPLIT})
      SELECT dedup_key, event_id, "partition", "offset" FROM (
        SELECT *, row_number() OVER (
          PARTITION BY dedup_key ORDER BY ts, "partition", "offset") AS place
        FROM pool WHERE dedup_key NOT IN (SELECT dedup_key FROM state)) AS tried
      WHERE place = 1""",
    "process_events": f"{_feed()} {_FLAT} FROM sendable",
    "register_notifications": _kind_query("signup"),
    "delete_schema_notifications": _kind_query("view"),
    "delete_subject_notifications": _kind_query("click"),
    "compatibility_notifications": _kind_query("purchase"),
    "mode_notifications": _kind_query("error"),
    "notifications": f"{_feed()} {_FLAT} FROM sent",
    "notifications_schema_changes": f"{_feed(kinds=_SCHEMA_KINDS)} {_FLAT} FROM sent",
    "notifications_filtered": f"{_feed(also=_SUBJECTS)} {_FLAT} FROM sent",
    "notifications_per_environment": (
        f"{_feed(key='environment_id, dedup_key')} {_FLAT} FROM sent"
    ),
    "sink_key_value": f"""{_feed()}, flat AS ({_FLAT} FROM sent)
      SELECT coalesce(subject, 'unknown') AS key, event_type, audit_log_event_id,
        schema_references FROM flat""",
    "notification_json": _JSON,
    "dedup_first_wins": f"""{_feed()}
      SELECT dedup_key, event_id, "partition", "offset" FROM sent""",
    "dedup_with_state": f"""{_SECOND_RUN}
      SELECT dedup_key, event_id, "partition", "offset" FROM later""",
    "known_keys_by_filter": f"""{_SECOND_RUN}
      SELECT DISTINCT a.dedup_key FROM audit a {_FROM_SPLIT}
      WHERE a.dedup_key IN (SELECT dedup_key FROM state)""",
    "state_after_run": f"""{_SECOND_RUN}
      SELECT dedup_key, CAST(ts AS VARCHAR) AS first_seen, "partition", "offset" FROM state
      UNION ALL
      SELECT dedup_key, CAST(ts AS VARCHAR), "partition", "offset" FROM later""",
    "state_pruned": f"""{_feed()}
      SELECT dedup_key, CAST(ts AS VARCHAR) AS first_seen FROM (
        SELECT *, row_number() OVER (ORDER BY ts DESC, "partition" DESC, "offset" DESC) AS age
        FROM sent) AS aged
      WHERE age <= {_ORACLE_KEPT}""",
    "state_size": f"""{_feed()}
      SELECT (SELECT count(*) FROM sent) AS state_keys,
        (SELECT count(*) FROM (SELECT DISTINCT environment_id, schema_id FROM sent
          WHERE found)) AS cached_schemas""",
    "duplicates_skipped": f"""{_feed()}
      SELECT a.event_id, a.dedup_key, a."partition", a."offset" {_DUPLICATES}""",
    "run_metrics": _counters(_ALL_KINDS),
    "run_metrics_schema_changes": _counters(_SCHEMA_KINDS),
    "run_metrics_with_state": f"""{_SECOND_RUN},
      reread AS (SELECT a.* FROM audit a {_FROM_SPLIT})
      SELECT (SELECT count(*) FROM reread) AS events_consumed,
        (SELECT count(*) FROM later) AS events_processed,
        (SELECT count(*) FROM later) AS notifications_produced,
        (SELECT count(*) FROM reread a JOIN later s ON a.dedup_key = s.dedup_key WHERE {_AFTER})
        + (SELECT count(*) FROM reread WHERE dedup_key IN (SELECT dedup_key FROM state))
          AS duplicates_skipped""",
}
