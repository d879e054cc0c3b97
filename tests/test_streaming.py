from __future__ import annotations

import shutil
import time

import pytest
from pyspark.sql import functions as F

from evotrail import FeedOptions
from evotrail import fixed_values as fv
from evotrail.operators import dedup
from evotrail.plans import change_feed as feed
from evotrail.schemas import ENVELOPE, STATE
from evotrail.sources import commits, files, sinks, state_files
from evotrail.streaming.bounded import EndMarks, stop_at_ends
from evotrail.streaming.feed import (
    FeedFolders,
    last_positions,
    process_batch,
    read_table,
    start_feed,
    total_counters,
)
from evotrail.streaming.stateful import stateful_feed
from evotrail.streaming.status import StatusLog
from tests.events import ALL_CHANGES, event, plan_text, record, schema, snapshot_of

NOW = {"availableNow": True}


def value(i):
    """Registrations and deletions over few subjects, some failed, some broken."""
    if i % 13 == 12:
        return "broken"
    method = (fv.REGISTER_SCHEMA, fv.DELETE_SUBJECT, fv.UPDATE_MODE)[i % 3]
    status = "FAILURE" if i % 7 == 0 else "SUCCESS"
    changes = {"data__result__data": {"id": float(i % 4)}} if i % 3 == 0 else {}
    return event(method, status, f"s{i % 5}", **changes) | {"id": f"e{i}"}


def rows(start, stop):
    return [record(value(i), i) for i in range(start, stop)]


def append(spark, path, start, stop):
    one_file = spark.createDataFrame(rows(start, stop), ENVELOPE).coalesce(1)
    one_file.write.mode("append").parquet(path)


@pytest.fixture()
def place(tmp_path):
    return str(tmp_path / "log"), FeedFolders(str(tmp_path / "feed"))


def loaded(spark, path, batch_id, era_length):
    base, added = state_files.load(spark, path, batch_id, era_length, 8)
    return base.unionByName(added)


def snapshot(spark):
    return snapshot_of(spark, schema(0), schema(1, status=500), schema(2, status=404))


def run_to_end(spark, log_path, folders, options=ALL_CHANGES, **more):
    stream = files.stream_log(spark, log_path, max_files_per_trigger=1)
    query = start_feed(stream, lambda: snapshot(spark), options, folders, NOW, buckets=8, **more)
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def sent_ids(spark, folders):
    stored = read_table(spark, folders, "notifications")
    return sorted(r.audit_log_event_id for r in stored.collect())


def expected_ids(spark, stop, options=ALL_CHANGES):
    log = spark.createDataFrame(rows(0, stop), ENVELOPE)
    result = feed.change_feed(log, snapshot(spark), options)
    return sorted(r.audit_log_event_id for r in result.collect())


def test_stream_equals_batch_over_restarts(spark, place):
    log_path, folders = place
    for start, stop in ((0, 20), (20, 40), (40, 41)):
        append(spark, log_path, start, stop)
    run_to_end(spark, log_path, folders, era_length=2)
    assert sent_ids(spark, folders) == expected_ids(spark, 41)

    run_to_end(spark, log_path, folders, era_length=2)
    assert sent_ids(spark, folders) == expected_ids(spark, 41)

    append(spark, log_path, 41, 90)
    run_to_end(spark, log_path, folders, era_length=2)
    assert sent_ids(spark, folders) == expected_ids(spark, 90)
    totals = total_counters(spark, folders).first()
    broken = sum(1 for i in range(90) if value(i) == "broken")
    assert totals.events_consumed == 90 - broken
    assert totals.records_rejected == broken
    assert totals.notifications_produced == len(expected_ids(spark, 90))
    kinds = read_table(spark, folders, "notifications").select("event_type").distinct().count()
    assert kinds == 3
    assert read_table(spark, folders, "failed_lookups").count() > 0
    rejected = read_table(spark, folders, "rejected")
    assert sorted(r.offset for r in rejected.collect()) == list(range(12, 90, 13))


def test_a_batch_run_again_changes_nothing(spark, place):
    _, folders = place
    batches = [spark.createDataFrame(rows(a, b), ENVELOPE) for a, b in ((0, 25), (25, 50))]
    for batch_id, records in enumerate(batches):
        process_batch(records, batch_id, snapshot(spark), ALL_CHANGES, folders, buckets=8, era_length=1)
    before = sent_ids(spark, folders), total_counters(spark, folders).first()
    process_batch(batches[1], 1, snapshot(spark), ALL_CHANGES, folders, buckets=8, era_length=1)
    assert (sent_ids(spark, folders), total_counters(spark, folders).first()) == before
    assert before[0] == expected_ids(spark, 50)


def registered(i, subject, schema_id, version):
    """A registration whose request names ``subject``."""
    changes = {"data__result__data": {"id": float(schema_id)}}
    made = event(fv.REGISTER_SCHEMA, "SUCCESS", subject, **changes) | {"id": f"e{i}"}
    return record(made, i)


def test_failed_lookups_are_tried_again_until_answered(spark, place):
    _, folders = place
    down, up = snapshot_of(spark, schema(1, status=500)), snapshot_of(spark, schema(1))
    later = [value(i) for i in range(100, 112) if i % 3]
    batches = [
        ([registered(0, "late", 1, 1), registered(1, "late", 1, 1)], down),
        ([record(v, 100 + n) for n, v in enumerate(later)], down),
        ([registered(200, "late", 1, 1)], up),
        ([registered(201, "late", 1, 1)], up),
    ]
    counts, waiting = [], []
    for batch_id, (records, answers) in enumerate(batches):
        # The third batch runs twice, as after a crash.
        for _ in range(1 + (batch_id == 2)):
            counters = process_batch(
                spark.createDataFrame(records, ENVELOPE),
                batch_id,
                answers,
                ALL_CHANGES,
                folders,
                buckets=8,
                era_length=2,
                retry_lookups=True,
            )
        counts.append(counters)
        stored = read_table(spark, folders, "waiting", batch_id)
        waiting.append(sorted(r.event_id for r in stored.collect()))
    assert waiting == [["e0", "e1"], ["e0", "e1"], [], []]
    sent = read_table(spark, folders, "notifications").where("schema_id = 1")
    assert [r.audit_log_event_id for r in sent.collect()] == ["e0"]
    duplicates = read_table(spark, folders, "duplicates", 2).collect()
    assert sorted(r.event_id for r in duplicates) == ["e1", "e200"]
    assert counts[2]["events_consumed"] == 1 and counts[2]["notifications_produced"] == 1


def test_a_failed_send_fails_the_batch_and_marks_nothing(spark, place):
    _, folders = place
    records = spark.createDataFrame(rows(0, 25), ENVELOPE)

    def broken(_):
        raise OSError("no broker")

    with pytest.raises(OSError):
        process_batch(records, 0, snapshot(spark), ALL_CHANGES, folders, buckets=8, publish=broken)
    assert loaded(spark, folders.state, 1, 50).count() == 0
    seen = []
    process_batch(
        records,
        0,
        snapshot(spark),
        ALL_CHANGES,
        folders,
        buckets=8,
        publish=lambda sent: seen.extend(sent.collect()),
    )
    assert sorted(n.audit_log_event_id for n in seen) == expected_ids(spark, 25)
    assert loaded(spark, folders.state, 1, 50).count() == len(seen)


def test_published_rows_keep_the_order_of_a_key(spark, place):
    _, folders = place
    options = FeedOptions(environments=("env-blue",), deduplicate=False)
    records = spark.createDataFrame(rows(0, 60)[::-1], ENVELOPE)
    parts = []

    def collect(notifications):
        numbered = notifications.withColumn("part", F.spark_partition_id())
        parts.extend(numbered.collect())

    process_batch(records, 0, snapshot(spark), options, folders, buckets=8, publish=collect)
    for subject in {n.subject for n in parts}:
        mine = [n for n in parts if n.subject == subject]
        assert len({n.part for n in mine}) == 1
        assert [n.log_offset for n in mine] == sorted(n.log_offset for n in mine)


def test_dry_run_marks_but_does_not_write(spark, place):
    log_path, folders = place
    append(spark, log_path, 0, 30)
    run_to_end(spark, log_path, folders, dry_run=True)
    assert total_counters(spark, folders).first().notifications_produced > 0
    append(spark, log_path, 0, 30)
    run_to_end(spark, log_path, folders)
    assert read_table(spark, folders, "counters", 1).first().notifications_produced == 0


def test_state_is_pruned_oldest_first(spark, place):
    _, folders = place
    options = FeedOptions(
        environments=("env-blue",), include_config_changes=True, max_state_keys=5
    )
    records = spark.createDataFrame(rows(0, 50), ENVELOPE)
    process_batch(records, 0, snapshot(spark), options, folders, buckets=8, era_length=1)
    state = loaded(spark, folders.state, 1, 1)
    sent = read_table(spark, folders, "notifications").orderBy(F.desc("log_offset"))
    newest = [r.dedup_key for r in sent.collect()]
    kept = {r.dedup_key for r in state.collect()}
    assert 0 < len(kept) <= 5 and kept == set(newest[: len(kept)])


def test_missing_state_is_empty_and_nested_folders_are_made(spark, tmp_path):
    path = str(tmp_path / "a" / "b" / "state")
    assert loaded(spark, path, 0, 2).count() == 0
    state_files.add(spark.createDataFrame([("k", None, 0, 1)], STATE), path, 0, 2)
    assert loaded(spark, path, 0, 2).count() == 0
    assert [r.dedup_key for r in loaded(spark, path, 1, 2).collect()] == ["k"]
    state_files.end_era(spark, path, 0, 2, buckets=8)
    with pytest.raises(ValueError, match="era length"):
        loaded(spark, path, 2, 2)
    state_files.end_era(spark, path, 1, 2, buckets=8)
    assert [r.dedup_key for r in loaded(spark, path, 2, 2).collect()] == ["k"]


def test_no_key_is_forgotten_by_default(spark, place):
    """More keys than any limit a state once had, sent again after an era."""
    _, folders = place
    keys = spark.range(120_000).selectExpr("concat('s', id, ':m:null') AS dedup_key")
    state_files.seed(keys, folders.state, buckets=8)
    batch = [record(event(fv.DELETE_SUBJECT, subject=f"s{i}"), i) for i in range(8)]
    records = spark.createDataFrame(batch, ENVELOPE)
    for batch_id in range(3):
        counters = process_batch(
            records, batch_id, snapshot(spark), ALL_CHANGES, folders, era_length=1, buckets=8
        )
        assert counters["notifications_produced"] == (8 if batch_id == 0 else 0)
    assert loaded(spark, folders.state, 3, 1).count() == 120_008


def test_the_state_is_not_moved(spark, place):
    """A batch is moved to the buckets of the state; the state has no exchange."""
    _, folders = place
    keys = spark.range(1000).selectExpr("concat('s', id, ':m:null') AS dedup_key")
    state_files.seed(keys, folders.state, buckets=8)
    base, _ = state_files.load(spark, folders.state, 0, 50, 8)
    events = spark.createDataFrame(rows(0, 30), ENVELOPE).selectExpr("value AS dedup_key", "*")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (
            dedup.drop_known(dedup.first_per_key(events), base),
            dedup.known_keys(events, base),
        ):
            tree = plan_text(joined, "simple")
            assert state_side(tree).count("Exchange") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def state_side(tree: str) -> str:
    """The lines of a plan between the join's second child and the scan of the state."""
    lines = tree.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    depth = lines[scan].index("FileScan")
    found = []
    for line in reversed(lines[:scan]):
        start = len(line) - len(line.lstrip(" :+-"))
        if "Join" in line and start < depth:
            break
        if start < depth:
            found.append(line)
            depth = start
    return "\n".join(found)


def test_old_keys_are_forgotten_only_on_request(spark, tmp_path):
    path = str(tmp_path / "state")
    old, new = (record("", 0, seconds=s)[5] for s in (0, 3 * 86_400))
    added = [("old", old, 0, 1), ("new", new, 0, 2), ("seeded", None, None, None)]
    state_files.add(spark.createDataFrame(added, STATE), path, 0, 1)
    for ttl, kept in ((None, {"old", "new", "seeded"}), (2, {"new", "seeded"})):
        state_files.end_era(spark, path, 0, 1, ttl_days=ttl, buckets=8)
        assert {r.dedup_key for r in loaded(spark, path, 1, 1).collect()} == kept


def test_an_earlier_time_in_a_later_batch_loses(spark, place):
    """Two log partitions: arrival decides between batches, position within one."""
    _, folders = place
    same = event(fv.DELETE_SUBJECT)
    late, early = (
        [record(same | {"id": name}, 0, partition, seconds=seconds)]
        for name, partition, seconds in (("late", 0, 9), ("early", 1, 5))
    )
    for batch_id, batch in enumerate((late, early)):
        records = spark.createDataFrame(batch, ENVELOPE)
        process_batch(records, batch_id, snapshot(spark), ALL_CHANGES, folders, buckets=8)
    assert sent_ids(spark, folders) == ["late"]
    whole = feed.change_feed(
        spark.createDataFrame(late + early, ENVELOPE), snapshot(spark), ALL_CHANGES
    )
    assert [r.audit_log_event_id for r in whole.collect()] == ["early"]


def test_rows_without_a_subject_are_spread(spark):
    sent = spark.range(4000).selectExpr(
        "CASE WHEN id % 4 = 0 THEN 'one' END AS subject",
        "timestamp_seconds(id) AS log_timestamp",
        "CAST(0 AS int) AS log_partition",
        "id AS log_offset",
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = sinks.in_key_order(sent).groupBy(F.spark_partition_id(), "subject").count()
        largest = {r.subject: r["count"] for r in sizes.orderBy("count").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert largest["one"] == 1000 and largest[None] < 1000


def test_keys_of_lines(spark, tmp_path):
    (tmp_path / "keys").write_text('"a:m:1"\n"b, \\"c\\":m:null"\n"a:m:1"\nbroken\n')
    found = state_files.keys_from_lines(spark, str(tmp_path / "keys"))
    assert sorted(r.dedup_key for r in found.collect()) == ["a:m:1", 'b, "c":m:null']


@pytest.mark.parametrize(
    "text, keys",
    [
        ('["a:m:1", "b:m:null", "a:m:1"]', ["a:m:1", "b:m:null"]),
        ("[]", []),
        ("not json", []),
        ('{"a": 1}', []),
        (None, []),
    ],
)
def test_keys_of_a_json_file(spark, tmp_path, text, keys):
    path = tmp_path / "state.json"
    if text is not None:
        path.write_text(text)
    found = state_files.keys_from_json(spark, str(path))
    assert sorted(r.dedup_key for r in found.collect()) == keys


def test_a_seeded_state_marks_its_keys_and_is_pruned_first(spark, place):
    _, folders = place
    records = spark.createDataFrame(rows(0, 50), ENVELOPE)
    known = feed.change_feed(records, snapshot(spark), ALL_CHANGES).orderBy("log_offset")
    keys = [r.dedup_key for r in known.limit(3).collect()]
    seeds = spark.createDataFrame([(k,) for k in keys], "dedup_key string")
    state_files.seed(seeds, folders.state, buckets=8)
    total = known.count()
    options = FeedOptions(
        environments=("env-blue",), include_config_changes=True, max_state_keys=total - 1
    )
    process_batch(records, 0, snapshot(spark), options, folders, buckets=8, era_length=1)
    assert len(sent_ids(spark, folders)) == total - 3
    kept = {r.dedup_key for r in loaded(spark, folders.state, 1, 1).collect()}
    assert kept and not kept & set(keys)


def stateful_ids(spark, log_path, out, **more):
    stream = files.stream_log(spark, log_path, max_files_per_trigger=1)
    result = stateful_feed(stream, snapshot(spark), ALL_CHANGES, **more)
    query = (
        result.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(**NOW)
        .start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return [r.dedup_key for r in spark.read.parquet(f"{out}/rows").collect()]


@pytest.mark.parametrize(
    "more", [{}, {"remember": "1 day"}, {"remember": "1 day", "salts": 4}, {"salts": 4}]
)
def test_stateful_feed_sends_each_key_once(spark, tmp_path, place, more):
    log_path, _ = place
    append(spark, log_path, 0, 25)
    append(spark, log_path, 25, 50)
    keys = stateful_ids(spark, log_path, str(tmp_path), **more)
    append(spark, log_path, 50, 90)
    keys = stateful_ids(spark, log_path, str(tmp_path), **more)
    log = spark.createDataFrame(rows(0, 90), ENVELOPE)
    expected = feed.change_feed(log, snapshot(spark), ALL_CHANGES).collect()
    assert sorted(keys) == sorted(r.dedup_key for r in expected)


def test_a_forgotten_key_is_sent_again(spark, tmp_path, place):
    """A key is dropped once the watermark, set by earlier batches, has passed it.

    The third event comes more than an hour later, but it is itself what moves
    the watermark, so only the fourth finds the key forgotten.
    """
    log_path, _ = place
    again = event(fv.DELETE_SUBJECT)
    sent = []
    for offset, seconds in enumerate((0, 10, 10_000, 20_000)):
        one = [record(again, offset, 0, seconds)]
        spark.createDataFrame(one, ENVELOPE).coalesce(1).write.mode("append").parquet(log_path)
        sent.append(len(stateful_ids(spark, log_path, str(tmp_path), remember="1 hour")))
    assert sent == [1, 1, 1, 2]


def test_status_lines(spark, place):
    log_path, folders = place
    append(spark, log_path, 0, 10)
    append(spark, log_path, 10, 20)
    lines = []
    status = StatusLog(lines.append, interval_seconds=0.0)
    spark.streams.addListener(status)
    try:
        run_to_end(spark, log_path, folders, batch_done=status.batch_done)
        for _ in range(100):
            if any("stopped" in line for line in lines):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(status)
    totals = total_counters(spark, folders).first().asDict()
    assert status.totals.items() <= totals.items()
    assert lines[0] == "feed started" and sum(line.startswith("status") for line in lines) == 2
    assert lines[-1].startswith("feed stopped: events_consumed 19, ")


def test_status_lines_are_limited_in_time():
    lines, now = [], [0.0]
    status = StatusLog(lines.append, interval_seconds=60.0, clock=lambda: now[0])
    for seconds in (10.0, 59.0, 61.0, 70.0, 125.0):
        now[0] = seconds
        status.batch_done(dict.fromkeys(status.totals, 1))
    assert [line.split(",")[0] for line in lines] == [
        "status: events_consumed 3",
        "status: events_consumed 5",
    ]


class Crash(Exception):
    pass


def crash_at(monkeypatch, place, after):
    """Let the ``place``-th of a batch's writes fail, after it was done or instead of it."""
    seen = []

    def failing(write):
        def step(*args, **more):
            seen.append(write.__name__)
            if len(seen) == place and not after:
                raise Crash
            result = write(*args, **more)
            if len(seen) == place:
                raise Crash
            return result

        return step

    for module, name in (
        (sinks, "write_table"),
        (state_files, "add"),
        (state_files, "_write_buckets"),
        (state_files, "end_era"),
        (commits, "publish"),
        (commits, "forget"),
        (commits, "delete"),
    ):
        monkeypatch.setattr(module, name, failing(getattr(module, name)))
    return seen


def committed(spark, folders):
    return sent_ids(spark, folders), total_counters(spark, folders).first()


def test_a_crash_around_a_commit_shows_no_part_of_a_batch(spark, place, tmp_path):
    """Batch 3 ends an era: it crashes before its record, while merging, and while deleting."""
    _, start = place
    batches = [spark.createDataFrame(rows(10 * i, 10 * i + 10), ENVELOPE) for i in range(4)]

    def run(folders, batch_id):
        process_batch(
            batches[batch_id], batch_id, snapshot(spark), ALL_CHANGES, folders, buckets=2, era_length=2
        )

    for batch_id in range(3):
        run(start, batch_id)
    before = committed(spark, start)
    with pytest.MonkeyPatch.context() as patch:
        whole = FeedFolders(str(tmp_path / "whole"))
        shutil.copytree(start.root, whole.root)
        writes = crash_at(patch, 0, True)
        run(whole, 3)
    after = committed(spark, whole)
    assert before != after
    record = writes.index("write_table", writes.index("publish")) - 1
    assert writes[record] == "publish" and len(writes) > record + 6
    # Around the batch's own record, where its rows appear, and around the merging.
    places = {record - 3, record + 1, writes.index("forget") - 1}
    for number in sorted(places):
        folders = FeedFolders(str(tmp_path / f"crash-{number}"))
        shutil.copytree(start.root, folders.root)
        with pytest.MonkeyPatch.context() as patch:
            crash_at(patch, number, number % 2 == 0)
            with pytest.raises(Crash):
                run(folders, 3)
        assert committed(spark, folders) in (before, after)
        run(folders, 3)
        assert committed(spark, folders) == after


def test_files_are_bounded_by_eras(spark, place):
    _, folders = place
    counts = []
    for batch_id in range(6):
        records = spark.createDataFrame(rows(5 * batch_id, 5 * batch_id + 5), ENVELOPE)
        process_batch(records, batch_id, snapshot(spark), ALL_CHANGES, folders, buckets=2, era_length=2)
        counts.append(len(read_table(spark, folders, "counters").inputFiles()))
    assert counts == [1, 1, 2, 2, 3, 3]
    kept = commits.names_in(spark, folders.table("notifications"))
    titles = sorted(commits.folder_title(name).rsplit("-", 1)[0] for name in kept)
    assert titles == ["batch-4", "batch-5", "era-0-1", "era-2-3", "era-4-5"]
    assert sent_ids(spark, folders) == expected_ids(spark, 30)
    totals = read_table(spark, folders, "counters", 4).collect()
    assert [row.batch_id for row in totals] == [4]


def test_a_table_that_no_batch_wrote_is_named(spark, place):
    _, folders = place
    with pytest.raises(ValueError, match="no committed rejected"):
        read_table(spark, folders, "rejected")


def test_a_running_feed_ends_where_the_log_ended(spark, place):
    """Three partitions, one empty at the start; a later record of each is left out."""
    log_path, folders = place

    def add(*places):
        made = [record(value(i), offset, partition) for i, partition, offset in places]
        spark.createDataFrame(made, ENVELOPE).coalesce(1).write.mode("append").parquet(log_path)

    add((1, 0, 0), (2, 0, 1))
    add((3, 2, 7), (4, 2, 9))
    marks = EndMarks.of_log(spark.read.schema(ENVELOPE).parquet(log_path))
    assert marks.ends == {0: 2, 2: 10} and not marks.reached
    add((5, 1, 0), (8, 2, 10))
    stream = files.stream_log(spark, log_path, max_files_per_trigger=1)
    trigger = {"processingTime": "0 seconds"}

    def start(bounds):
        return start_feed(
            stream, lambda: snapshot(spark), ALL_CHANGES, folders, trigger, buckets=2, marks=bounds
        )

    query = start(marks)
    stop_at_ends(query, marks)
    assert not query.isActive and query.exception() is None
    positions = {r.partition: r.last_offset for r in last_positions(spark, folders).collect()}
    assert positions[0] == 1 and positions[2] >= 9
    wanted = spark.createDataFrame([record(value(i), i) for i in (1, 2, 3, 4)], ENVELOPE)
    expected = feed.change_feed(wanted, snapshot(spark), ALL_CHANGES)
    assert sent_ids(spark, folders) == sorted(r.audit_log_event_id for r in expected.collect())

    again = EndMarks(marks.ends)
    query = start(again)
    assert again.reached
    stop_at_ends(query, again)
    assert not query.isActive


def test_marks_of_an_empty_log_are_reached_at_once(spark):
    marks = EndMarks.of_log(spark.createDataFrame([], ENVELOPE))
    assert marks.reached and EndMarks({3: 0}).reached
    assert spark.createDataFrame(rows(0, 3), ENVELOPE).where(marks.wanted()).count() == 0
