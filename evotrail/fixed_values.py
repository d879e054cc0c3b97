"""Names and limits that the audit log and the feed's consumers rely on."""

# These must be spelled exactly as the audit log writes them.
SCHEMA_EVENT_TYPE = "io.confluent.sg.server/request"

REGISTER_SCHEMA = "schema-registry.RegisterSchema"
DELETE_SCHEMA = "schema-registry.DeleteSchema"
DELETE_SUBJECT = "schema-registry.DeleteSubject"
UPDATE_COMPATIBILITY = "schema-registry.UpdateCompatibility"
UPDATE_MODE = "schema-registry.UpdateMode"

ENVIRONMENT_PATTERN = "environment=([^/]+)"
STATUS_SUCCESS = "SUCCESS"

# These must be spelled exactly as consumers of the feed read them.
SCHEMA_REGISTERED = "SCHEMA_REGISTERED"
SCHEMA_DELETED = "SCHEMA_DELETED"
SUBJECT_DELETED = "SUBJECT_DELETED"
COMPATIBILITY_UPDATED = "COMPATIBILITY_UPDATED"
MODE_UPDATED = "MODE_UPDATED"

DEFAULT_SCHEMA_TYPE = "AVRO"
UNKNOWN = "unknown"

# The share of the limit that leaves when a limited state is full.
PRUNE_SHARE = 0.2

SCHEMA_METHODS = (REGISTER_SCHEMA, DELETE_SCHEMA, DELETE_SUBJECT)
CONFIG_METHODS = (UPDATE_COMPATIBILITY, UPDATE_MODE)

EVENT_TYPE_OF_METHOD = {
    REGISTER_SCHEMA: SCHEMA_REGISTERED,
    DELETE_SCHEMA: SCHEMA_DELETED,
    DELETE_SUBJECT: SUBJECT_DELETED,
    UPDATE_COMPATIBILITY: COMPATIBILITY_UPDATED,
    UPDATE_MODE: MODE_UPDATED,
}
