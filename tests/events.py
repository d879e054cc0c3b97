"""Small logs and snapshots for tests."""

from __future__ import annotations

import contextlib
import io
import json
from datetime import datetime, timedelta, timezone

from evotrail import FeedOptions
from evotrail import fixed_values as fv
from evotrail.schemas import ENVELOPE, REGISTRY

PLACE = "crn://cloud.example/organization=acme/environment=env-blue/schema-registry=lsrc-9"
OPTIONS = FeedOptions(environments=("env-blue",))
ALL_CHANGES = FeedOptions(environments=("env-blue",), include_config_changes=True)
START = datetime(2024, 1, 15, 10, 30, tzinfo=timezone.utc)


def event(method=fv.REGISTER_SCHEMA, status="SUCCESS", subject="billing-total", **changes) -> dict:
    """An event of a monitored environment; keyword names are dotted paths with ``__``.

    A path set to None is left out.
    """
    result = {
        "id": "change-1",
        "type": fv.SCHEMA_EVENT_TYPE,
        "time": "2024-01-15T10:30:00Z",
        "data": {
            "serviceName": "registry",
            "methodName": method,
            "resourceName": f"{PLACE}/subject/billing-total",
            "request": {"data": {"subject": subject}},
            "result": {"status": status},
        },
    }
    for path, value in changes.items():
        *parents, last = path.split("__")
        inner = result
        for name in parents:
            inner = inner.setdefault(name, {})
        if value is None:
            inner.pop(last, None)
        else:
            inner[last] = value
    return result


def record(value, offset=0, partition=0, seconds=None):
    """One log record; dicts become JSON text."""
    text = json.dumps(value) if isinstance(value, dict) else value
    when = START + timedelta(seconds=offset if seconds is None else seconds)
    return (None, text, "audit", partition, offset, when)


def log_of(spark, values):
    """A log with one record per value, in order."""
    return spark.createDataFrame([record(v, i) for i, v in enumerate(values)], ENVELOPE)


def schema(schema_id, environment="env-blue", status=200, **fields):
    row = {
        "schema": '{"type":"string"}',
        "schema_type": "AVRO",
        "references": None,
        "versions": [("orders-value", 3)],
        **fields,
    }
    return (
        environment,
        schema_id,
        status,
        row["schema"],
        row["schema_type"],
        row["references"],
        row["versions"],
    )


def snapshot_of(spark, *rows):
    return spark.createDataFrame(list(rows), REGISTRY)


def plan_text(df, mode="extended"):
    """What ``explain`` prints."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()
