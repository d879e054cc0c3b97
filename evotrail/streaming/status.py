"""A status line for running feeds."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping

from pyspark.sql.streaming import StreamingQueryListener

from evotrail.operators.metrics import COUNTERS

logger = logging.getLogger(__name__)


class StatusLog(StreamingQueryListener):
    """Reports a feed's counters so far, at most once per interval and at its end.

    Pass ``batch_done`` to ``start_feed`` and add the object itself with
    ``spark.streams.addListener`` to hear of the query's start and end.
    """

    def __init__(
        self,
        report: Callable[[str], None] = logger.info,
        interval_seconds: float = 60.0,
        clock: Callable[[], float] = time.monotonic,
    ):
        self._report = report
        self._interval = interval_seconds
        self._clock = clock
        self._reported_at = clock()
        self.totals = dict.fromkeys(COUNTERS, 0)

    def batch_done(self, counters: Mapping[str, int]) -> None:
        for name in COUNTERS:
            self.totals[name] += counters[name]
        now = self._clock()
        if now - self._reported_at >= self._interval:
            self._reported_at = now
            self._report(self._line("status"))

    def onQueryStarted(self, event) -> None:
        self._report("feed started")

    def onQueryProgress(self, event) -> None:
        """Row counts of Spark's progress count a batch once per scan; not used."""

    def onQueryTerminated(self, event) -> None:
        self._report(self._line("feed failed" if event.exception else "feed stopped"))

    def _line(self, head: str) -> str:
        return f"{head}: " + ", ".join(f"{k} {v}" for k, v in self.totals.items())
