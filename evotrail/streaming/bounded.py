"""Ending a running feed where the log ended at its start.

``EndMarks`` names, for every log partition, the offset after the last record wanted. A
feed started with marks leaves later records out and notes how far each partition has
come, with its commit records, so that a restart knows it. ``stop_at_ends`` ends the query
once every partition has passed its mark. A partition without records has no mark and is
not waited for. Offsets need not be gapless: any record at or behind the last one wanted
passes the mark. Marks are one row per log partition, whatever the log's size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evotrail.operators.log_ranges import end_offsets


class EndMarks:
    """Per partition, where to end and how far the feed has come."""

    def __init__(self, ends: Mapping[int, int]):
        self.ends = {int(p): int(end) for p, end in ends.items() if end > 0}
        self.passed: dict[int, int] = {}
        self._last_batch = -1

    @classmethod
    def of_log(cls, log: DataFrame) -> EndMarks:
        """The ends of a stored log as it is now."""
        return cls({row.partition: row.end_offset for row in end_offsets(log).collect()})

    def wanted(self) -> Column:
        """Whether a record lies before its partition's end."""
        if not self.ends:
            return F.lit(False)
        pairs = [F.lit(x) for pair in sorted(self.ends.items()) for x in pair]
        end = F.try_element_at(F.create_map(*pairs), F.col("partition"))
        return F.coalesce(F.col("offset") < end, F.lit(False))

    def watch(self, records: DataFrame) -> tuple[DataFrame, Observation]:
        """The records wanted, and what tells afterwards how far each partition came."""
        seen = Observation()
        farthest = [
            F.max(F.when(F.col("partition") == p, F.col("offset"))).alias(str(p))
            for p in sorted(self.ends)
        ]
        watched = records.observe(seen, F.count(F.lit(1)).alias("records"), *farthest)
        return watched.where(self.wanted()), seen

    def advance(self, positions: Mapping[int, int], batch_id: int) -> None:
        for partition, offset in positions.items():
            self.passed[partition] = max(offset, self.passed.get(partition, -1))
        self._last_batch = batch_id

    @property
    def reached(self) -> bool:
        return all(self.passed.get(p, -1) >= end - 1 for p, end in self.ends.items())

    def reached_in(self, query: StreamingQuery) -> bool:
        """Reached, and Spark has noted the batch that reached it as done."""
        if not self.reached:
            return False
        if self._last_batch < 0:
            return True
        progress = query.lastProgress
        return progress is not None and progress["batchId"] >= self._last_batch


def positions_of(seen: Observation) -> dict[int, int]:
    """Last offsets of the partitions that a watched batch had records of."""
    found = {name: value for name, value in seen.get.items() if name != "records"}
    return {int(name): value for name, value in found.items() if value is not None}


def stop_at_ends(query: StreamingQuery, marks: EndMarks, poll_seconds: float = 0.5) -> None:
    """Wait until every partition has passed its end, then stop the query.

    Returns early if the query ends by itself; raises what a failed query raised.
    """
    while not query.awaitTermination(poll_seconds):
        if marks.reached_in(query):
            query.stop()
            return
