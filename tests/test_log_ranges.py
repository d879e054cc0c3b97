from __future__ import annotations

import pytest

from evotrail import ReadMode, ReadOptions
from evotrail.operators import log_ranges
from evotrail.options import parse_instant
from evotrail.schemas import ENVELOPE
from evotrail.sources import kafka
from tests.events import START, record

# Partition 0 holds an older record behind a newer one; partition 2 ends early.
ROWS = [
    record("a", 0, 0, seconds=0),
    record("b", 1, 0, seconds=20),
    record("c", 2, 0, seconds=5),
    record("d", 3, 0, seconds=30),
    record("e", 0, 1, seconds=10),
    record("f", 5, 1, seconds=40),
    record("g", 0, 2, seconds=1),
]


def at(seconds):
    return START.replace(minute=START.minute + seconds // 60, second=seconds % 60).isoformat()


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def log(spark, request):
    table = spark.createDataFrame(ROWS, ENVELOPE)
    return table.selectExpr(
        "key", "value", "topic", "partition", "offset",
        f"CAST(timestamp AS {request.param}) AS timestamp",
    )


def values(df):
    return "".join(sorted(r.value for r in df.collect()))


def test_backfill_reads_everything(log):
    assert values(log_ranges.select_range(log, ReadOptions(ReadMode.BACKFILL))) == "abcdefg"


def test_start_positions_each_partition(log):
    options = ReadOptions(ReadMode.TIMESTAMP, start_timestamp=at(10))
    assert values(log_ranges.select_range(log, options)) == "bcdef"


def test_start_after_the_log_gives_nothing(log):
    options = ReadOptions(ReadMode.TIMESTAMP, start_timestamp=at(59))
    assert values(log_ranges.select_range(log, options)) == ""


def test_end_is_inclusive_in_every_mode(log):
    options = ReadOptions(ReadMode.TIMESTAMP, start_timestamp=at(10), end_timestamp=at(20))
    assert values(log_ranges.select_range(log, options)) == "bce"
    options = ReadOptions(ReadMode.BACKFILL, end_timestamp=at(20))
    assert values(log_ranges.select_range(log, options)) == "abceg"


def test_bounded_backfill_stops_at_the_noted_ends(log):
    ends = log_ranges.end_offsets(log.filter("value NOT IN ('d', 'f')"))
    options = ReadOptions(ReadMode.BACKFILL, stop_at_current=True)
    assert values(log_ranges.select_range(log, options, ends)) == "abceg"


def test_stream_positions_need_a_query(log):
    for mode in (ReadMode.STREAM, ReadMode.RESUME):
        with pytest.raises(ValueError, match="streaming"):
            log_ranges.select_range(log, ReadOptions(mode))


def test_options_are_checked():
    with pytest.raises(ValueError, match="start_timestamp is required"):
        ReadOptions(ReadMode.TIMESTAMP)
    with pytest.raises(ValueError, match="zone"):
        ReadOptions(ReadMode.TIMESTAMP, start_timestamp="2024-01-01T00:00:00")
    with pytest.raises(ValueError, match="before"):
        ReadOptions(
            ReadMode.TIMESTAMP,
            start_timestamp="2024-01-02T00:00:00Z",
            end_timestamp="2024-01-01T00:00:00Z",
        )
    assert ReadOptions().mode is ReadMode.STREAM and not ReadOptions().bounded
    assert parse_instant("2024-01-01T02:00:00+02:00").hour == 0


def test_kafka_positions():
    moment = "2024-01-01T00:00:00Z"
    start = {
        ReadMode.STREAM: {"startingOffsets": "latest"},
        ReadMode.BACKFILL: {"startingOffsets": "earliest"},
        ReadMode.RESUME: {"startingOffsets": "earliest"},
    }
    for mode, options in start.items():
        assert kafka.start_options(ReadOptions(mode)) == options
    assert kafka.start_options(ReadOptions(ReadMode.TIMESTAMP, start_timestamp=moment)) == {
        "startingTimestamp": "1704067200000",
        "startingOffsetsByTimestampStrategy": "latest",
    }
    ends_at = ReadOptions(ReadMode.BACKFILL, end_timestamp=moment)
    assert kafka.end_options(ends_at) == {"endingTimestamp": "1704067200001"}
    assert kafka.end_options(ReadOptions(ReadMode.BACKFILL)) == {"endingOffsets": "latest"}


def test_kafka_tables_need_a_start(spark):
    with pytest.raises(ValueError, match="stream_topic"):
        kafka.read_topic(spark, "host:1", "t", ReadOptions(ReadMode.STREAM))
