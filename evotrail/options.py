"""User-facing options, checked when they are built."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from enum import Enum

from evotrail import fixed_values as fv


class ReadMode(Enum):
    """Where reading the audit log starts."""

    STREAM = "stream"
    BACKFILL = "backfill"
    TIMESTAMP = "timestamp"
    RESUME = "resume"


def _as_tuple(name: str, value) -> tuple[str, ...]:
    if isinstance(value, str):
        raise ValueError(f"{name} must be a collection of strings, not one string")
    return tuple(value)


@dataclass(frozen=True)
class FeedOptions:
    """What the change feed keeps and how it removes duplicates.

    ``methods`` replaces the default allow-list; left as None it is the three
    schema methods, plus the two configuration methods when
    ``include_config_changes`` is set. ``key_scope="environment"`` puts the
    environment in front of the deduplication key, so that equal subjects and
    ids of two environments no longer collide; ``"event"`` also adds the
    event id, so that repeated changes of a subject are all sent and only copies of
    an event are removed. ``max_state_keys`` and ``state_ttl_days`` forget old keys,
    which may then be sent again; by default no key is forgotten.
    """

    environments: tuple[str, ...]
    include_config_changes: bool = False
    methods: tuple[str, ...] | None = None
    only_successful: bool = True
    subject_filters: tuple[str, ...] = ()
    deduplicate: bool = True
    key_scope: str = "subject"
    max_state_keys: int | None = None
    state_ttl_days: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "environments", _as_tuple("environments", self.environments))
        object.__setattr__(
            self, "subject_filters", _as_tuple("subject_filters", self.subject_filters)
        )
        if self.methods is not None:
            object.__setattr__(self, "methods", _as_tuple("methods", self.methods))
        problems = []
        if not self.environments:
            problems.append("at least one environment must be monitored")
        if any(not e or "/" in e for e in self.environments):
            problems.append("environment ids must be non-empty and hold no '/'")
        if self.methods is not None and not self.methods:
            problems.append("methods must not be empty")
        if self.key_scope not in ("subject", "environment", "event"):
            problems.append("key_scope must be 'subject', 'environment' or 'event'")
        if self.max_state_keys is not None and self.max_state_keys < 1:
            problems.append("max_state_keys must be positive")
        if self.state_ttl_days is not None and self.state_ttl_days < 1:
            problems.append("state_ttl_days must be positive")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def allowed_methods(self) -> tuple[str, ...]:
        base = self.methods if self.methods is not None else fv.SCHEMA_METHODS
        extra = fv.CONFIG_METHODS if self.include_config_changes else ()
        return tuple(dict.fromkeys((*base, *extra)))


def parse_instant(text: str) -> datetime:
    """An ISO-8601 instant as an aware UTC datetime; the zone is required."""
    moment = datetime.fromisoformat(text)
    if moment.tzinfo is None:
        raise ValueError(f"timestamp {text!r} needs a zone, e.g. a trailing Z")
    return moment.astimezone(timezone.utc)


@dataclass(frozen=True)
class ReadOptions:
    """Which stretch of the audit log to read.

    ``start_timestamp`` positions each log partition at its first record at or
    after that time; ``end_timestamp`` is inclusive and applies in every mode;
    ``stop_at_current`` bounds a backfill by the end of the log as it is now.
    """

    mode: ReadMode = ReadMode.STREAM
    start_timestamp: str | None = None
    end_timestamp: str | None = None
    stop_at_current: bool = False

    def __post_init__(self):
        if self.mode is ReadMode.TIMESTAMP and not self.start_timestamp:
            raise ValueError("start_timestamp is required for TIMESTAMP mode")
        start = parse_instant(self.start_timestamp) if self.start_timestamp else None
        end = parse_instant(self.end_timestamp) if self.end_timestamp else None
        if self.mode is ReadMode.TIMESTAMP and end is not None and end < start:
            raise ValueError("end_timestamp lies before start_timestamp")

    @property
    def bounded(self) -> bool:
        return self.stop_at_current or self.end_timestamp is not None
