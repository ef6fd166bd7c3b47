"""Repeated runs of a stream that stop once a run brings nothing new."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: The name under which a guarded stream counts its rows and successes.
METRIC = "progress_guard"


def counted(stream: DataFrame, success: Column) -> DataFrame:
    """The stream, with its rows and successes counted as it runs, for ProgressGuard."""
    return stream.observe(METRIC, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(success.cast("int")), F.lit(0)).alias("good"))


class ProgressGuard(StreamingQueryListener):
    """Adds up rows and successes of each run from its progress events."""

    def __init__(self) -> None:
        self.rows: dict[str, tuple[int, int]] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _end(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(METRIC)
        if seen is not None:
            with self.lock:
                rows, good = self.rows.get(str(p.runId), (0, 0))
                self.rows[str(p.runId)] = rows + seen["rows"], good + seen["good"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def result(self, query: StreamingQuery, timeout: float = 60) -> tuple[int, int]:
        """Rows and successes of a run that has ended; its events may come a little later than its end."""
        run = str(query.runId)
        if not self._end(run).wait(timeout):
            raise TimeoutError(f"no end of run {run} was told within {timeout} s")
        with self.lock:
            return self.rows.get(run, (0, 0))


def run_until_done(spark: SparkSession, start: Callable[[int], StreamingQuery], most: int | None = None) -> list[tuple[int, int, int]]:
    """Runs start(1), start(2), .. (availableNow queries over counted() streams) until one adds no success; run, rows and successes of each.

    most: runs after which to stop in any case.
    """
    guard, out = ProgressGuard(), []
    spark.streams.addListener(guard)
    try:
        while most is None or len(out) < most:
            query = start(len(out) + 1)
            query.awaitTermination()
            out.append((len(out) + 1, *guard.result(query)))
            if not out[-1][2]:
                break
    finally:
        spark.streams.removeListener(guard)
    return out
