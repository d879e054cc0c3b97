from __future__ import annotations

import json

import pytest

from evotrail import FeedOptions
from evotrail import fixed_values as fv
from evotrail.operators import notifications as notes
from evotrail.operators import parse, registry
from evotrail.plans import change_feed as feed
from evotrail.schemas import NOTIFICATION, notification_avro_schema
from tests.events import ALL_CHANGES, OPTIONS, PLACE, event, log_of, schema, snapshot_of

REFERENCES = '[{"name":"base","subject":"base-value","version":1}]'


@pytest.fixture(scope="module")
def snapshot(spark):
    return snapshot_of(
        spark,
        schema(100001),
        schema(100002, schema_type=None, versions=[], references=REFERENCES),
        schema(100003, status=500),
        schema(100004, status=404),
        schema(100005, environment="env-other"),
        schema(100006, versions=None, schema_type="PROTOBUF", schema=None),
        schema(100007, versions=[("first", 9), ("second", 1)], schema_type="JSON"),
    )


def registered(schema_id, **changes):
    return event(subject="orders-value", data__result__data={"id": float(schema_id)}, **changes)


def notified(spark, snapshot, *events, options=ALL_CHANGES):
    rows = feed.all_notifications(log_of(spark, events), snapshot, options)
    return [r.asDict(recursive=True) for r in rows.orderBy("log_offset").collect()]


def test_registration(spark, snapshot):
    (n,) = notified(spark, snapshot, registered(100001), options=OPTIONS)
    assert n["event_type"] == fv.SCHEMA_REGISTERED
    assert (n["schema_id"], n["version"], n["schema_type"]) == (100001, 3, "AVRO")
    assert (n["subject"], n["environment_id"]) == ("orders-value", "env-blue")
    assert (n["timestamp"], n["audit_log_event_id"]) == ("2024-01-15T10:30:00Z", "change-1")
    assert n["data_contract_registered"] == {"schema": '{"type":"string"}', "references": None}
    others = ("data_contract_deleted", "subject_deleted", "compatibility_updated", "mode_updated")
    assert all(n[name] is None for name in others)


def test_every_lookup_outcome(spark, snapshot):
    asked = [
        (registered(100002), ("AVRO", None, REFERENCES)),
        (registered(100004, data__request__data__schemaType="JSON"), ("JSON", None, None)),
        (registered(100005), ("AVRO", None, None)),
        (registered(100006, data__request__data__schemaType="JSON"), ("PROTOBUF", None, None)),
        (registered(100007), ("JSON", 9, None)),
        (registered(42), ("AVRO", None, None)),
        (event(data__request__data__schemaType="PROTOBUF"), ("PROTOBUF", None, None)),
        (event(data__request=None), ("AVRO", None, None)),
    ]
    rows = notified(spark, snapshot, *[a[0] for a in asked])
    found = [
        (n["schema_type"], n["version"], n["data_contract_registered"]["references"])
        for n in rows
    ]
    assert found == [a[1] for a in asked]
    assert notified(spark, snapshot, registered(100003)) == []


def test_failed_lookups_are_reported(spark, snapshot):
    events = parse.audit_events(log_of(spark, [registered(100003), registered(100001)]), OPTIONS)
    judged = registry.with_failed_status(events, snapshot)
    (row,) = registry.failed_lookups(judged).collect()
    assert (row.schema_id, row.http_status) == (100003, 500)
    assert feed.sendable_events(events, snapshot, OPTIONS).count() == 1


def test_other_changes(spark, snapshot):
    resource = f"{PLACE}/subject/billing-total"
    rows = notified(
        spark,
        snapshot,
        event(fv.DELETE_SCHEMA, data__request__version=3),
        event(fv.DELETE_SCHEMA, data__request=None),
        event(fv.DELETE_SUBJECT),
        event(fv.UPDATE_COMPATIBILITY, data__request__compatibility="FULL"),
        event(fv.UPDATE_MODE, data__request__mode="READONLY"),
        event(fv.UPDATE_MODE, data__request=None),
    )
    assert [n["event_type"] for n in rows] == [
        fv.SCHEMA_DELETED,
        fv.SCHEMA_DELETED,
        fv.SUBJECT_DELETED,
        fv.COMPATIBILITY_UPDATED,
        fv.MODE_UPDATED,
        fv.MODE_UPDATED,
    ]
    assert all(n["subject"] == resource and n["schema_id"] is None for n in rows)
    assert [n["version"] for n in rows] == [3, None, None, None, None, None]
    assert rows[0]["data_contract_deleted"] == {"permanent": False}
    assert rows[2]["subject_deleted"] == {"permanent": False, "versions_deleted": None}
    assert rows[3]["compatibility_updated"] == {"new_compatibility": "FULL"}
    assert rows[4]["mode_updated"] == {"new_mode": "READONLY"}
    assert rows[5]["mode_updated"] == {"new_mode": None}
    assert all(n["schema_type"] is None for n in rows)


def test_irrelevant_and_unknown_methods_give_nothing(spark, snapshot):
    assert notified(spark, snapshot, event("kafka.CreateTopics")) == []
    odd = FeedOptions(environments=("env-blue",), methods=("schema-registry.Other",))
    assert notified(spark, snapshot, event("schema-registry.Other"), options=odd) == []


def _json(spark, snapshot, *events, pretty=False):
    log = log_of(spark, events)
    rows = notes.json_rows(
        feed.all_notifications(log, snapshot, ALL_CHANGES).orderBy("log_offset"), pretty
    )
    return [(r.key, r.value) for r in rows.collect()]


def test_json_leaves_out_nulls_and_embeds_references(spark, snapshot):
    (first, second, third) = _json(
        spark,
        snapshot,
        registered(100001),
        registered(100002),
        event(data__request={"accessType": "x"}),
    )
    assert first[0] == "orders-value"
    assert first[1].startswith('{"event_type":"SCHEMA_REGISTERED","schema_id":100001,')
    assert '"version":3' in first[1] and '"schema_type":"AVRO"' in first[1]
    assert list(json.loads(first[1])) == [
        "event_type",
        "schema_id",
        "subject",
        "version",
        "schema_type",
        "timestamp",
        "data_contract_registered",
        "audit_log_event_id",
        "environment_id",
    ]
    payload = json.loads(second[1])["data_contract_registered"]
    assert payload["references"] == json.loads(REFERENCES)
    assert third[0] == "unknown" and '"data_contract_registered":{}' in third[1]


def test_pretty_json(spark, snapshot):
    ((_, text),) = _json(spark, snapshot, registered(100001), pretty=True)
    assert "\n" in text and json.loads(text)["version"] == 3


def test_published_shape(spark, snapshot):
    log = log_of(spark, [registered(100001)])
    rows = notes.published(feed.change_feed(log, snapshot, OPTIONS))
    assert rows.columns == NOTIFICATION.fieldNames()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    assert kinds == {f.name: f.dataType.simpleString() for f in NOTIFICATION.fields}
    keyed = notes.keyed_rows(feed.change_feed(log, snapshot, OPTIONS)).first()
    assert keyed.key == "orders-value" and keyed.value.version == 3


def test_avro_schema_follows_the_published_record():
    avro = json.loads(notification_avro_schema("example.feed"))
    assert [f["name"] for f in avro["fields"]] == NOTIFICATION.fieldNames()
    kinds = {f["name"]: f["type"] for f in avro["fields"]}
    assert kinds["event_type"]["symbols"] == [
        "SCHEMA_REGISTERED",
        "SCHEMA_DELETED",
        "SUBJECT_DELETED",
        "COMPATIBILITY_UPDATED",
        "MODE_UPDATED",
    ]
    assert kinds["version"] == ["null", "int"]
    assert kinds["subject_deleted"][1]["name"] == "SubjectDeleted"
    assert kinds["subject_deleted"][1]["fields"][0]["type"] == ["null", "boolean"]
    assert all(f["default"] is None for f in avro["fields"] if f["name"] != "event_type")


def test_lookups_by_id_and_by_subject_version(spark, snapshot):
    asked = spark.createDataFrame(
        [("env-blue", i) for i in (100001, 100001, 100002, 100003, 100004, 9)]
        + [("env-none", 100001)],
        "environment_id string, schema_id int",
    )
    rows = {
        (r.environment_id, r.schema_id): (r.outcome, r.schema_type, r.subject, r.version)
        for r in registry.by_id(asked, snapshot).collect()
    }
    assert rows == {
        ("env-blue", 100001): ("hit", "AVRO", "orders-value", 3),
        ("env-blue", 100002): ("hit", "AVRO", None, None),
        ("env-blue", 100003): ("error", None, None, None),
        ("env-blue", 100004): ("not_found", None, None, None),
        ("env-blue", 9): ("not_found", None, None, None),
        ("env-none", 100001): ("not_found", None, None, None),
    }
    asked = spark.createDataFrame(
        [("second", 1), ("second", 2), ("first", 9)], "subject string, version int"
    ).selectExpr("'env-blue' AS environment_id", "*")
    found = registry.by_subject_version(asked, snapshot).collect()
    assert {(r.subject, r.version): r.schema_id for r in found} == {
        ("second", 1): 100007,
        ("second", 2): None,
        ("first", 9): 100007,
    }
