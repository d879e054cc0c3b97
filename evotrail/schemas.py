"""Input, output and state schemas."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from evotrail import fixed_values as fv

#: Name of the column that ``from_json`` fills with text it could not read.
CORRUPT = "_corrupt"

#: The log's total order: positions compare by time, then partition, then offset.
POSITION = ("timestamp", "partition", "offset")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_string = T.StringType()

#: The columns of the Kafka source that the operators use.
ENVELOPE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# Member names as the audit log writes them.
#: One audit event. Number members are read as text and converted afterwards,
#: because the log writes some of them as quoted strings.
EVENT = _struct(
    id=_string,
    specversion=_string,
    type=_string,
    source=_string,
    subject=_string,
    time=_string,
    data=_struct(
        serviceName=_string,
        methodName=_string,
        resourceName=_string,
        authenticationInfo=_struct(principal=_string),
        request=_struct(
            accessType=_string,
            data=_struct(
                subject=_string, schema=_string, schemaType=_string, references=_string
            ),
            subject=_string,
            version=_string,
            compatibility=_string,
            mode=_string,
        ),
        response=_struct(id=_string, version=_string),
        result=_struct(
            status=_string,
            message=_string,
            data=_struct(id=_string, version=_string),
        ),
    ),
)

#: Members of ``EVENT`` that must hold an int / a double.
INT_MEMBERS = (
    "data.request.version",
    "data.response.id",
    "data.response.version",
    "data.result.data.version",
)
DOUBLE_MEMBERS = ("data.result.data.id",)

#: Members of ``EVENT`` that must not hold an object or an array.
TEXT_MEMBERS = (
    "id",
    "specversion",
    "type",
    "source",
    "subject",
    "time",
    "data.serviceName",
    "data.methodName",
    "data.resourceName",
    "data.request.accessType",
    "data.request.data.subject",
    "data.request.data.schema",
    "data.request.data.schemaType",
    "data.request.subject",
    "data.request.compatibility",
    "data.request.mode",
    "data.result.status",
    "data.result.message",
)

# Names and order of the published record's fields.
#: One notification; the field order is that of the published record.
NOTIFICATION = T.StructType(
    [
        T.StructField("event_type", T.StringType(), False),
        T.StructField("environment_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("schema_id", T.IntegerType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("schema_type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("audit_log_event_id", T.StringType()),
        T.StructField(
            "data_contract_registered", _struct(schema=_string, references=_string)
        ),
        T.StructField("data_contract_deleted", _struct(permanent=T.BooleanType())),
        T.StructField(
            "subject_deleted",
            _struct(permanent=T.BooleanType(), versions_deleted=T.IntegerType()),
        ),
        T.StructField("compatibility_updated", _struct(new_compatibility=_string)),
        T.StructField("mode_updated", _struct(new_mode=_string)),
    ]
)

#: One schema as the registry would answer for it.
REGISTRY = T.StructType(
    [
        T.StructField("environment_id", T.StringType(), False),
        T.StructField("schema_id", T.IntegerType(), False),
        T.StructField("http_status", T.IntegerType(), False),
        T.StructField("schema", T.StringType()),
        T.StructField("schema_type", T.StringType()),
        T.StructField("references", T.StringType()),
        T.StructField(
            "versions", T.ArrayType(_struct(subject=_string, version=T.IntegerType()))
        ),
    ]
)

#: A remembered deduplication key and the position of the event it was sent for.
STATE = T.StructType(
    [
        T.StructField("dedup_key", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

_AVRO_NAMES = {
    T.StringType: "string",
    T.IntegerType: "int",
    T.BooleanType: "boolean",
}


# Fixed value: the published record's name.
RECORD_NAME = "SchemaChangeNotification"


def notification_avro_schema(namespace: str, name: str = RECORD_NAME) -> str:
    """Avro schema of ``NOTIFICATION``, for ``to_avro``.

    Payload records are named after their field in camel case, ``event_type``
    is an enum, and every other field is nullable with a null default.
    """

    def nullable(field: T.StructField) -> dict:
        if isinstance(field.dataType, T.StructType):
            kind: object = {
                "type": "record",
                "name": "".join(part.capitalize() for part in field.name.split("_")),
                "fields": [nullable(inner) for inner in field.dataType.fields],
            }
        else:
            kind = _AVRO_NAMES[type(field.dataType)]
        return {"name": field.name, "type": ["null", kind], "default": None}

    event_type = {
        "name": "event_type",
        "type": {
            "type": "enum",
            "name": "EventType",
            "symbols": list(fv.EVENT_TYPE_OF_METHOD.values()),
        },
    }
    rest = [nullable(f) for f in NOTIFICATION.fields if f.name != "event_type"]
    return json.dumps(
        {"type": "record", "name": name, "namespace": namespace, "fields": [event_type, *rest]}
    )
