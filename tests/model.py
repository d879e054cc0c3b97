"""The feed as a plain loop over a small log, to check the Spark jobs against.

It follows the written rules one record at a time; it shares no code with the
package beyond names.
"""

from __future__ import annotations

import json
import re

from evotrail import fixed_values as fv


def get(value, *path):
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def subject_of(e):
    named = get(e, "data", "request", "data", "subject")
    named = get(e, "data", "request", "subject") if named is None else named
    return get(e, "data", "resourceName") if named is None else named


def schema_id_of(e):
    number = get(e, "data", "result", "data", "id")
    return None if number is None else int(float(number))


def environment_of(e):
    for text in (get(e, "data", "resourceName"), get(e, "subject")):
        found = re.search(fv.ENVIRONMENT_PATTERN, text or "")
        if found:
            return found[1]
    return None


def key_of(e):
    if get(e, "data") is None:
        return "unknown:unknown:null"
    parts = (subject_of(e), get(e, "data", "methodName"), schema_id_of(e))
    return ":".join("null" if p is None else str(p) for p in parts)


def relevant(e, environments, methods):
    return (
        get(e, "type") == fv.SCHEMA_EVENT_TYPE
        and get(e, "data") is not None
        and get(e, "data", "methodName") in methods
        and environment_of(e) in environments
        and (get(e, "data", "result", "status") or "").upper() == "SUCCESS"
    )


def run(records, environments, methods, statuses, known=()):
    """Process (position, text) pairs; ``statuses`` maps (environment, id) to an answer.

    Returns consumed, ids of sent events, of duplicates and of failed lookups, and the state.
    """
    state, sent, duplicates, failed, consumed = set(known), [], [], [], 0
    for _, text in sorted(records):
        try:
            e = json.loads(text)
        except ValueError:
            continue
        consumed += 1
        key = key_of(e)
        if key in state:
            duplicates.append(e["id"])
            continue
        if not relevant(e, environments, methods):
            continue
        if get(e, "data", "methodName") == fv.REGISTER_SCHEMA and schema_id_of(e) is not None:
            if statuses.get((environment_of(e), schema_id_of(e)), 404) not in (200, 404):
                failed.append(e["id"])
                continue
        sent.append(e["id"])
        state.add(key)
    return consumed, sent, duplicates, failed, state
