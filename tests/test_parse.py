from __future__ import annotations

import json

import pytest

from evotrail import FeedOptions
from evotrail import fixed_values as fv
from evotrail.operators import parse
from tests.events import OPTIONS, PLACE, event, log_of


def audit(spark, *values, options=OPTIONS):
    rows = parse.audit_events(log_of(spark, values), options).orderBy("offset").collect()
    return [row.asDict() for row in rows]


def test_every_member_is_read(spark):
    whole = event(
        specversion="1.0",
        source="crn://cloud.example/...",
        data__response={"id": 100001, "version": 3},
        data__authenticationInfo={"principal": {"kind": "user", "id": 7}},
        data__request__data__references=[{"name": "a", "version": 1}],
    )
    row = parse.parse_events(log_of(spark, [whole])).select("event.*").first()
    assert row.id == "change-1" and row.specversion == "1.0"
    assert row.data.serviceName == "registry"
    assert row.data.result.status == "SUCCESS"
    assert row.data.response.id == "100001" and row.data.response.version == "3"
    assert json.loads(row.data.authenticationInfo.principal) == {"kind": "user", "id": 7}
    assert json.loads(row.data.request.data.references) == [{"name": "a", "version": 1}]


def test_unknown_members_are_ignored(spark):
    (row,) = audit(spark, event(extra="x", data__more={"a": 1}))
    assert row["event_id"] == "change-1"


BAD = {
    None: "empty",
    "": "empty",
    "   ": "no_content",
    "not valid json": "malformed",
    "null": "malformed",
    "[]": "malformed",
    '{"id": "x"': "malformed",
    "{'id': 'x'}": "malformed",
    '{"data": "text"}': "malformed",
    '{"data": {"authenticationInfo": "text"}}': "malformed",
    '{"data": {"response": 7}}': "malformed",
    '{"specversion": {"a": tru}}': "malformed",
    '{"data": {"result": {"data": {"id": NaN}}}}': "malformed",
    '{"data": {"request": {"version": "three"}}}': "bad_number",
    '{"data": {"request": {"version": 3000000000}}}': "bad_number",
    '{"data": {"request": {"version": true}}}': "bad_number",
    '{"data": {"response": {"id": "x"}}}': "bad_number",
    '{"data": {"result": {"data": {"id": "x"}}}}': "bad_number",
    '{"data": {"request": {"version": "3.7"}}}': "bad_number",
    '{"data": {"request": {"version": "2d"}}}': "bad_number",
    '{"data": {"response": {"id": " 2e1 "}}}': "bad_number",
    '{"data": {"resourceName": {"a": 1}}}': "wrong_type",
    '{"id": ["x"]}': "wrong_type",
    '{"source" : [ ]}': "wrong_type",
    '{"data": {"request": {"data": {"schema": {}}}}}': "wrong_type",
    '{"\\u0069d": {"a": 1}}': "wrong_type",
}


READABLE = [
    '{"id": "{\\"a\\": 1}", "data": {"resourceName": "[1]"}}',
    '{"id": 7, "type": true, "source": 1.5}',
    '{"data": {"request": {"version": 3.7}}}',
    '{"data": {"request": {"version": " 12 "}}}',
    '{"data": {"request": {"version": "null"}, "result": {"data": {"id": "2.5"}}}}',
    '{"other": {"id": {"a": 1}, "version": "3.7"}, "data": {"request": {"data": {"references": []}}}}',
    '{"data": {"authenticationInfo": {"principal": {"id": "x"}}}}',
]


def test_types_are_checked_where_they_matter_only(spark):
    log = log_of(spark, READABLE)
    assert parse.malformed_events(log).collect() == []
    assert parse.parse_events(log).count() == len(READABLE)


def test_unreadable_records_are_kept_apart(spark):
    log = log_of(spark, [*BAD, event()])
    reasons = {r.value: r.reject_reason for r in parse.malformed_events(log).collect()}
    assert reasons == BAD
    assert [r.offset for r in parse.parse_events(log).collect()] == [len(BAD)]


def test_an_empty_object_is_an_event(spark):
    (row,) = audit(spark, "{}")
    assert row["event_id"] is None and row["dedup_key"] == "unknown:unknown:null"


@pytest.mark.parametrize(
    "written, version",
    [(3, 3), ("3", 3), (" 3 ", 3), (3.7, 3), (-3.7, -3), ("", None), ("null", None)],
)
def test_versions_in_every_spelling(spark, written, version):
    (row,) = audit(spark, event(data__request__version=written))
    assert row["request_version"] == version


@pytest.mark.parametrize(
    "written, schema_id",
    [
        (100264.0, 100264),
        ("5", 5),
        (7, 7),
        (2.9, 2),
        (-2.9, -2),
        (1e12, 2147483647),
        (-1e12, -2147483648),
        ("NaN", 0),
        ("Infinity", 2147483647),
        ("-Infinity", -2147483648),
        (0, 0),
        ("", None),
        (None, None),
    ],
)
def test_schema_ids_are_cut_to_ints(spark, written, schema_id):
    (row,) = audit(spark, event(data__result__data={"id": written}))
    assert row["schema_id"] == schema_id


def test_subjects(spark):
    resource = f"{PLACE}/subject/billing-total"
    delete = fv.DELETE_SCHEMA
    cases = [
        (event(data__request={"data": {"subject": "in"}, "subject": "top"}), "in", "in", "in"),
        (event(data__request={"subject": "top"}), "top", "top", "top"),
        (event(data__request={}), None, resource, None),
        (event(data__request=None), None, resource, resource),
        (event(delete, data__request={"subject": "top"}), "top", "top", resource),
        (event(data__request=None, data__resourceName=None), None, None, None),
    ]
    rows = audit(spark, *[c[0] for c in cases])
    found = [(r["request_subject"], r["event_subject"], r["notification_subject"]) for r in rows]
    assert found == [c[1:] for c in cases]


def test_environment_comes_from_resource_name_then_envelope(spark):
    other = "crn://x/environment=env-b/more"
    cases = [
        (event(subject="s"), "env-blue"),
        (event(data__resourceName="subject=a") | {"subject": other}, "env-b"),
        (event(data=None) | {"subject": other}, "env-b"),
        (event() | {"subject": other}, "env-blue"),
        (event(data__resourceName="environment=/environment=env-c"), "env-c"),
        (event(data__resourceName="a/environment="), None),
        (event(data__resourceName=None), None),
    ]
    rows = audit(spark, *[c[0] for c in cases])
    assert [r["environment_id"] for r in rows] == [c[1] for c in cases]


def test_dedup_keys(spark):
    keyed = event(subject="orders-value", data__result__data={"id": 100001.0})
    cases = [
        (keyed, "orders-value:schema-registry.RegisterSchema:100001"),
        (event(subject="orders-value"), "orders-value:schema-registry.RegisterSchema:null"),
        (
            event(data__request=None, data__resourceName=None, data__methodName=None),
            "null:null:null",
        ),
        (event(data=None), "unknown:unknown:null"),
    ]
    rows = audit(spark, *[c[0] for c in cases])
    assert [r["dedup_key"] for r in rows] == [c[1] for c in cases]
    scoped = FeedOptions(environments=("env-blue",), key_scope="environment")
    (row,) = audit(spark, keyed, options=scoped)
    assert row["dedup_key"] == "env-blue:orders-value:schema-registry.RegisterSchema:100001"


def test_text_test_never_loses_an_allowed_method(spark):
    plain = json.dumps(event())
    escaped = plain.replace("RegisterSchema", "Register\\u0053chema")
    other = json.dumps(event("kafka.CreateTopics"))
    log = log_of(spark, [plain, escaped, other])
    rows = parse.change_candidates(log, OPTIONS).orderBy("offset").collect()
    assert [r.method_name for r in rows] == [fv.REGISTER_SCHEMA, fv.REGISTER_SCHEMA]
    quoted = FeedOptions(environments=("e",), methods=("a/b",))
    assert parse.change_candidates(log, quoted).count() == 3
