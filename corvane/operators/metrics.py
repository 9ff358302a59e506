"""Totals of a run that come with the run itself: observed while a job writes or a stream goes on, without a second pass."""

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

log = logging.getLogger("corvane.runs")


def fetch_totals(valid: Column, status: Column, error: Column, size: Column) -> dict[str, Column]:
    """What a run of fetches counts: completed, valid, not_found, errors, and the sum of sizes."""
    return {
        "completed": F.count(F.lit(1)), "valid": F.count_if(F.coalesce(valid, F.lit(False))), "not_found": F.count_if(F.coalesce(status == 404, F.lit(False))),
        "errors": F.count_if(error.isNotNull()), "bytes": F.coalesce(F.sum(size), F.lit(0)),
    }


def record_totals(source: Column, skipped: Column) -> dict[str, Column]:
    """What a consolidation counts: files, records and skipped. Files are as many as the run reads, not as its rows."""
    bad = F.coalesce(skipped, F.lit(False))
    return {"files": F.size(F.collect_set(source)), "records": F.count_if(~bad), "skipped": F.count_if(bad)}


def failure_totals(failed: Column, key: Column, message: Column) -> dict[str, Column]:
    """The number of failures, and the one with the smallest key."""
    bad = F.coalesce(failed, F.lit(False))
    return {"failures": F.count_if(bad), "first_failure": F.min(F.when(bad, F.struct(key.alias("key"), message.alias("message"))))}


class Watched:
    """A table whose totals are known once a job has read it whole. One job counts; of a job that reads a part only (a limit, a
    first row) the totals are that part's."""

    def __init__(self, df: DataFrame, totals: dict[str, Column]):
        self._seen = Observation()
        self.table = df.observe(self._seen, *(c.alias(n) for n, c in totals.items()))

    @property
    def totals(self) -> dict:
        """Waits for the job."""
        return self._seen.get


def rate_and_eta(done: float, before: float, seconds: float, total: float) -> tuple[float, float | None]:
    """Rows a second since the last look, and the seconds left; None if nothing moves."""
    rate = (done - before) / max(seconds, 0.001)
    return rate, (total - done) / rate if rate > 0 else None


@dataclass
class Heartbeat(StreamingQueryListener):
    """A stream's totals and pace, batch by batch: add it with spark.streams.addListener. `total` is how many rows are expected;
    `report` is called for each batch with its line and the totals so far, which are sums of what the stream observes as
    `name`. Streams of other names don't count where `query` names one."""

    total: int
    name: str
    query: str | None = None
    report: Callable[[str, dict], None] = lambda line, totals: log.info("%s %s", line, totals)
    totals: dict = field(default_factory=dict)
    done: int = 0
    ended: threading.Event = field(default_factory=threading.Event)

    def _mine(self, name: str | None) -> bool:
        return self.query is None or name == self.query

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._runs = getattr(self, "_runs", set())
        if self._mine(event.name):
            self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if not self._mine(p.name) or not p.numInputRows:
            return
        before, self.done = self.done, self.done + p.numInputRows
        seen = p.observedMetrics.get(self.name)
        for key, value in (seen.asDict() if seen else {}).items():
            self.totals[key] = self.totals.get(key, 0) + (value or 0)
        rate, eta = rate_and_eta(self.done, before, (p.batchDuration or 0) / 1000, self.total)
        left = "n/a" if eta is None else f"{eta / 60:.1f}min"
        self.report(f"{self.done}/{self.total} rate={rate:.1f}/s eta={left}", dict(self.totals))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) in getattr(self, "_runs", set()):
            self.ended.set()


def stream_totals(query: StreamingQuery, name: str) -> dict:
    """Sums, over the batches that a query still knows, of what it observes as `name`."""
    out: dict = {}
    for progress in query.recentProgress:
        seen = progress.observedMetrics.get(name)
        for key, value in (seen.asDict() if seen else {}).items():
            out[key] = out.get(key, 0) + (value or 0)
    return out
