"""The physical plans have the shape that scale depends on."""

from __future__ import annotations

import re

import pytest

from checks import queries as q
from evotrail.operators import log_ranges, parse, registry, relevance
from evotrail.plans import batch_run
from evotrail.plans import change_feed as feed
from evotrail.schemas import ENVELOPE
from evotrail.sources import files
from checks.derived_tables import audit_log, registry_snapshot
from evotrail.staging import staged
from tests.events import ALL_CHANGES, event, plan_text, record, schema, snapshot_of

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return plan_text(df, mode)


@pytest.fixture(scope="module")
def stored_log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "log")
    rows = [record(event(), i, i % 3) for i in range(50)]
    spark.createDataFrame(rows, ENVELOPE).write.parquet(path)
    return files.read_log(spark, path)


def ran(df):
    """The plan as it ran, with reused exchanges shown once."""
    df.collect()
    whole = df._jdf.queryExecution().executedPlan().toString()
    return whole.split("== Initial Plan ==")[0]


def test_the_text_is_parsed_once(spark, stored_log):
    changes = feed.change_feed(stored_log, snapshot_of(spark, schema(1)), ALL_CHANGES)
    text = ran(changes)
    assert text.count("from_json(") == 1
    assert "Contains(value" in text


def test_duplicates_are_reduced_before_the_shuffle(spark, stored_log):
    text = ran(feed.change_feed(stored_log, snapshot_of(spark, schema(1)), ALL_CHANGES))
    limits = re.findall(r"WindowGroupLimit \[dedup_key#\d+\].*row_number\(\), 1, (\w+)", text)
    assert limits.count("Partial") == 1 and "Final" in limits
    shuffles = text.count("hashpartitioning(dedup_key") - text.count("ReusedExchange")
    assert shuffles == 1


def test_known_keys_need_no_further_shuffle_of_events(spark, stored_log, monkeypatch):
    """With joins by shuffle, events still move once by key for dedup and state."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = q._whole_state(spark, SF)
        events = parse.change_candidates(stored_log, ALL_CHANGES)
        firsts = feed.dedup.first_per_key(events)
        text = plan(feed.dedup.drop_known(firsts, state.select("dedup_key")), "simple")
        tree = text[: text.index("FileScan")]
        assert tree.count("hashpartitioning(dedup_key") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(q.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_time_bounds_reach_the_files(spark, stored_log):
    bounded = log_ranges.until_timestamp(stored_log, "2024-01-15T10:30:10Z")
    assert "PushedFilters: [IsNotNull(timestamp), LessThanOrEqual(timestamp" in plan(bounded)
    positions = q.mode_timestamp_range(spark, SF)
    text = plan(positions)
    assert "LessThanOrEqual(ts" in text and "GreaterThanOrEqual(ts" in text
    assert "props" not in text


def test_only_needed_columns_are_read(spark, stored_log):
    text = plan(feed.change_feed(stored_log, snapshot_of(spark, schema(1)), ALL_CHANGES))
    assert (
        "ReadSchema: struct<value:string,partition:int,offset:bigint,timestamp:timestamp>" in text
    )
    snapshot = registry_snapshot(spark, SF)
    text = plan(feed.change_feed(audit_log(spark, SF), snapshot, ALL_CHANGES))
    reads = re.findall(r"ReadSchema: (.*)", text)
    assert "struct<p_partkey:bigint>" in reads
    assert "struct<p_partkey:bigint,p_name:string,p_size:int>" in reads


def test_generated_code_stays_small_enough_to_be_compiled(spark):
    """The JVM does not compile methods of more than 8000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("notifications", "process_events", "skip_reasons", "registry_by_id"):
            text = plan(q.QUERIES[name](spark, SF), "codegen")
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", text)
            assert sizes and max(map(int, sizes)) < 8000, (name, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_are_stored_in_the_folder_the_session_names(spark):
    rows = staged(spark.range(10).selectExpr("id * 2 AS twice"))
    assert sorted(r.twice for r in rows.collect()) == list(range(0, 20, 2))
    named = spark.conf.get("spark.checkpoint.dir")
    assert named in spark.sparkContext.getCheckpointDir()
    assert "Range" not in plan(rows, "simple")


def test_distinct_lookups_hold_no_snapshot_whose_files_only_look_small(spark, tmp_path):
    """Rows of few different texts make tiny files, which Spark took for a small table."""
    rows = [schema(n, versions=[(f"subject-{n % 7}", n)]) for n in range(1, 2_001)]
    snapshot_of(spark, *rows).write.parquet(f"{tmp_path}/snapshot")
    snapshot = spark.read.parquet(f"{tmp_path}/snapshot")
    asked = spark.createDataFrame(
        [("env-blue", n, f"subject-{n % 7}", n) for n in (5, 5, 1_999, 9_999)],
        "environment_id string, schema_id int, subject string, version int",
    )
    for lookup in (registry.by_id, registry.by_subject_version):
        answers = lookup(asked, snapshot)
        how = ran(answers)
        assert "LeftSemi, BuildRight" in how and "LeftOuter, Build" not in how
        found = {r.schema_id or r.version: r.outcome for r in answers.collect()}
        assert found == {5: registry.HIT, 1_999: registry.HIT, 9_999: registry.MISSING}


def test_a_later_run_renders_its_log_once_and_reads_a_stored_state(spark):
    for name in ("known_keys_by_filter", "_later_log"):
        df = getattr(q, name)(spark, SF)
        rendered = df._jdf.queryExecution().optimizedPlan().toString()
        assert rendered.count("Generate explode(array(CASE") == 1


def test_a_run_stores_the_fields_of_events_that_may_be_sent_alone(spark, monkeypatch):
    stored, stage = [], batch_run.staged_table

    def noted(df):
        stored.append(stage(df))
        return stored[-1]

    monkeypatch.setattr(batch_run, "staged_table", noted)
    log, snapshot = audit_log(spark, SF), registry_snapshot(spark, SF)
    run = batch_run.run_batch(log, snapshot, q.ALL_CHANGES)
    events = stored[0].where("reject_reason IS NULL")
    relevant = relevance.relevant_events(parse.audit_events(log, q.ALL_CHANGES), q.ALL_CHANGES)
    assert 0 < events.where("type IS NOT NULL").count() == relevant.count() < events.count()
    assert events.where("dedup_key IS NULL").count() == 0
    assert stored[0].where("(value IS NULL) != (reject_reason IS NULL)").count() == 0
    assert run.rejected.count() == run.records_rejected > 0
    assert run.events_consumed == parse.audit_events(log, q.ALL_CHANGES).count()


def test_only_texts_with_an_escape_are_searched_for_its_place(spark):
    text = plan(audit_log(spark, SF))
    assert "END AS value" in text and text.count("replace(text#") == 1
    assert "replace(invoke(StructsToJson" not in text
