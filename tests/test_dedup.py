from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evotrail import FeedOptions
from evotrail import fixed_values as fv
from evotrail.operators import dedup, parse
from evotrail.operators import state as state_ops
from evotrail.plans import change_feed as feed
from evotrail.plans.batch_run import run_batch
from evotrail.staging import staged_table
from evotrail.schemas import ENVELOPE, STATE
from tests import model
from tests.events import ALL_CHANGES, event, log_of, plan_text, record, schema, snapshot_of

PLACES = [
    "crn://x/environment=env-blue/subject=a",
    "crn://x/environment=env-2/subject=a",
    "crn://x/environment=env-other/subject=a",
    "plain",
    None,
]
TWO = FeedOptions(environments=("env-blue", "env-2"), include_config_changes=True)
STATUSES = {("env-blue", 1): 200, ("env-blue", 2): 500, ("env-2", 1): 500, ("env-2", 3): 200}

METHODS = [*fv.EVENT_TYPE_OF_METHOD, "kafka.CreateTopics", "x:schema-registry.DeleteSubject", None]
small_events = st.builds(
    lambda method, status, subject, place, number, data: event(
        method,
        status,
        subject,
        data__resourceName=place,
        data__result__data=None if number is None else {"id": number},
    )
    | ({} if data else {"data": None}),
    st.sampled_from(METHODS),
    st.sampled_from(["SUCCESS", "success", "FAILURE"]),
    st.sampled_from(["a", "b", "a:x", None]),
    st.sampled_from(PLACES),
    st.sampled_from([1.0, 2.0, 3.0, 4.0, None]),
    st.sampled_from([True, True, True, False]),
)
records = st.lists(
    st.tuples(small_events, st.integers(0, 3), st.integers(0, 1)), min_size=20, max_size=80
)


def build(spark, drawn):
    """A log with equal times and two partitions, and the same records for the model."""
    rows, plain = [], []
    for offset, (e, seconds, partition) in enumerate(drawn):
        e = {**e, "id": f"e{offset}"}
        text = json.dumps(e) if offset % 11 != 10 else "{broken"
        row = record(text, offset, partition, seconds)
        rows.append(row)
        plain.append(((row[5], partition, offset), text))
    return spark.createDataFrame(rows, ENVELOPE), plain


def snapshot(spark):
    return snapshot_of(
        spark, *[schema(i, env, status) for (env, i), status in STATUSES.items()]
    )


@settings(
    max_examples=6,
    deadline=None,
    derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(first=records, second=records)
def test_two_runs_match_the_loop(spark, first, second):
    answers = snapshot(spark)
    log, plain = build(spark, first)
    run = run_batch(log, answers, TWO)
    consumed, sent, repeated, failed, state = model.run(
        plain, TWO.environments, TWO.allowed_methods, STATUSES
    )
    assert run.events_consumed == consumed
    assert run.records_rejected == len(plain) - consumed
    assert sorted(r.event_id for r in run.sent.collect()) == sorted(sent)
    assert sorted(r.event_id for r in run.duplicates.collect()) == sorted(repeated)
    assert sorted(r.audit_log_event_id for r in run.notifications.collect()) == sorted(sent)
    assert sorted(r.event_id for r in run.failed_lookups.collect()) == sorted(failed)

    stored = spark.createDataFrame(run.new_state().collect(), STATE)
    assert {r.dedup_key for r in stored.collect()} == state
    log, plain = build(spark, second)
    run = run_batch(log, answers, TWO, [stored.where('dedup_key < "m"'), stored.where('dedup_key >= "m"')])
    consumed, sent, repeated, failed, after = model.run(
        plain, TWO.environments, TWO.allowed_methods, STATUSES, state
    )
    counters = run.counters().first()
    assert counters.events_consumed == consumed
    assert counters.notifications_produced == counters.events_processed == len(sent)
    assert counters.duplicates_skipped == len(repeated)
    assert sorted(r.event_id for r in run.duplicates.collect()) == sorted(repeated)
    assert sorted(r.event_id for r in run.failed_lookups.collect()) == sorted(failed)
    lazily = feed.change_feed(log, answers, TWO, stored)
    assert sorted(r.audit_log_event_id for r in lazily.collect()) == sorted(sent)
    whole = state_ops.add_to_state(stored, run.new_state())
    assert sorted(r.dedup_key for r in whole.collect()) == sorted(after)


def test_the_earliest_position_wins(spark):
    same = event(fv.DELETE_SUBJECT)
    rows = [
        record({**same, "id": "late"}, 0, 0, seconds=9),
        record({**same, "id": "tie"}, 2, 1, seconds=5),
        record({**same, "id": "first"}, 7, 0, seconds=5),
    ]
    log = spark.createDataFrame(rows, ENVELOPE)
    sent = dedup.first_per_key(parse.audit_events(log, ALL_CHANGES))
    assert [r.event_id for r in sent.collect()] == ["first"]


def test_irrelevant_repeats_count_and_irrelevant_firsts_do_not_mark(spark):
    failed, good = event(fv.DELETE_SUBJECT, "FAILURE"), event(fv.DELETE_SUBJECT)
    log = log_of(spark, [failed, good, failed, good])
    run = run_batch(log, snapshot(spark), ALL_CHANGES)
    assert [r.offset for r in run.sent.collect()] == [1]
    assert sorted(r.offset for r in run.duplicates.collect()) == [2, 3]


def test_environments_share_keys_unless_scoped(spark):
    a = event(fv.DELETE_SUBJECT, data__resourceName=PLACES[0])
    b = event(fv.DELETE_SUBJECT, data__resourceName=PLACES[1])
    log = log_of(spark, [a, b])
    apart = FeedOptions(environments=TWO.environments, key_scope="environment")
    for options, expected in ((TWO, 1), (apart, 2)):
        assert feed.change_feed(log, snapshot(spark), options).count() == expected


def test_without_deduplication_everything_is_sent(spark):
    log = log_of(spark, [event(fv.DELETE_SUBJECT)] * 3)
    options = FeedOptions(environments=("env-blue",), deduplicate=False)
    known = spark.createDataFrame(
        [("billing-total:schema-registry.DeleteSubject:null", None, 0, 0)], STATE
    )
    run = run_batch(log, snapshot(spark), options, known)
    assert (run.notifications.count(), run.duplicates.count()) == (3, 0)
    assert feed.change_feed(log, snapshot(spark), options, known).count() == 3


def test_one_key_with_most_rows(spark):
    """A hot key, a hot schema id and many events that look nothing up."""
    hot = event(subject="hot", data__result__data={"id": 1.0})
    values = [hot if i % 3 else event(fv.DELETE_SUBJECT, subject=f"s{i}") for i in range(3000)]
    run = run_batch(log_of(spark, values), snapshot(spark), ALL_CHANGES)
    assert run.sent.count() == 1001
    assert run.duplicates.count() == 1999


def test_a_hot_key_is_split_where_events_meet_marks(spark):
    """One key with most rows: adaptive execution cuts its partition."""
    events = spark.range(400_000).selectExpr(
        "CASE WHEN id % 4 > 0 THEN 'hot' ELSE concat('k', id % 1000) END AS dedup_key",
        "timestamp_seconds(id) AS timestamp",
        "CAST(id % 3 AS int) AS partition",
        "id AS offset",
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        marks = dedup.marks(dedup.first_per_key(events)).withColumn("_marked", F.lit(True))
        marks = staged_table(marks)
        repeats = events.join(marks, "dedup_key").filter(dedup.IS_AFTER_MARK)
        keys = events.select("dedup_key").distinct().count()
        assert len(repeats.collect()) == 400_000 - keys
        assert "skew=true" in repeats._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_event_scope_sends_every_change_once(spark):
    one, other = (event(fv.DELETE_SUBJECT) | {"id": name} for name in ("e1", "e2"))
    log = log_of(spark, [one, other, one])
    scoped = FeedOptions(environments=("env-blue",), key_scope="event")
    run = run_batch(log, snapshot(spark), scoped)
    assert sorted(r.event_id for r in run.sent.collect()) == ["e1", "e2"]
    assert [r.offset for r in run.duplicates.collect()] == [2]


def test_equal_times_are_ordered_by_partition_and_offset(spark):
    same = event(fv.DELETE_SUBJECT)
    places = [(1, 5), (0, 9), (2, 0), (0, 4)]
    rows = [record(same | {"id": f"{p}-{o}"}, o, p, seconds=7) for p, o in places]
    run = run_batch(spark.createDataFrame(rows, ENVELOPE), snapshot(spark), ALL_CHANGES)
    assert [r.event_id for r in run.sent.collect()] == ["0-4"]
    assert sorted(r.event_id for r in run.duplicates.collect()) == ["0-9", "1-5", "2-0"]


def test_the_log_is_read_and_parsed_once(spark, tmp_path):
    """Rejects, candidates and counts come from one pass over the source."""
    values = [event(fv.DELETE_SUBJECT, subject=f"s{i}") for i in range(20)] + ["broken", ""]
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        reads.add(1)
        return value

    log = log_of(spark, values).withColumn("value", counted("value"))
    run = run_batch(log, snapshot(spark), ALL_CHANGES)
    assert run.rejected.count() == run.records_rejected == 2
    assert (run.notifications.count(), run.duplicates.count()) == (20, 0)
    assert run.failed_lookups.count() == 0
    assert reads.value == len(values)


def test_run_plans(spark):
    """Later steps read only their columns of stored tables, and no snapshot for rejects."""
    values = [event(subject=f"s{i}", data__result__data={"id": 1.0}) for i in range(20)]
    run = run_batch(log_of(spark, values), snapshot(spark), ALL_CHANGES)
    for table in (run.duplicates, run.failed_lookups, run.notifications):
        text = plan_text(table, "formatted")
        assert "Scan parquet" in text and "from_json" not in text
    text = plan_text(run.duplicates, "formatted")
    assert "Scan ExistingRDD" not in text
    assert "event_time" not in text and "compatibility" not in text
    # The only snapshot rows that judge a lookup are the failing ones.
    text = plan_text(run.failed_lookups, "formatted")
    assert "NOT http_status" in text and "http_status#" in text


def test_only_registrations_meet_the_snapshot(spark):
    values = [event(fv.DELETE_SUBJECT), event(data__result__data={"id": 1.0})]
    notified = feed.all_notifications(log_of(spark, values), snapshot(spark), ALL_CHANGES)
    assert notified.count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = notified._jdf.queryExecution().toString()
        optimized = tree.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        join = optimized[optimized.index("Join LeftOuter") :]
        assert "RegisterSchema" in join.split("Relation")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def fifo(keys, limit, share):
    """Keys arriving one by one at a limited state, oldest dropped first."""
    state = []
    for key in keys:
        if len(state) >= limit:
            del state[: int(limit * share)]
        state.append(key)
    return state


@pytest.mark.parametrize("limit, share", [(10, 0.2), (10, 0.5), (7, 0.3), (5, 1.0)])
def test_pruning_matches_one_by_one_arrival(spark, limit, share):
    for keys in (0, 1, limit - 1, limit, limit + 1, limit + 2, 3 * limit, 3 * limit + 1, 101):
        kept = state_ops.kept_after_pruning(keys, limit, share)
        assert kept == len(fifo(range(keys), limit, share))
    keys = [f"k{i:03}" for i in range(37)]
    rows = [(k, record("", i)[5], 0, i) for i, k in enumerate(keys)]
    state = spark.createDataFrame(rows[::-1], STATE)
    pruned = state_ops.prune_state(state, limit, share)
    assert sorted(r.dedup_key for r in pruned.collect()) == fifo(keys, limit, share)


def test_independent_keys(spark):
    keys = ["s1:RegisterSchema:100001", "s2:RegisterSchema:100002", "s1:DeleteSchema:100003"]
    state = spark.createDataFrame([(k, None, 0, 0) for k in keys], STATE)
    asked = spark.createDataFrame(
        [(k,) for k in [*keys, "s1:RegisterSchema:100002"]], "dedup_key string"
    )
    assert [r.dedup_key for r in dedup.drop_known(asked, state).collect()] == [
        "s1:RegisterSchema:100002"
    ]
