"""How far a stream has come."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


class Progress(StreamingQueryListener):
    """Rows and batches of one query, its rate a second since it started, and, if the total is known, the seconds
    left; report gets this after every batch.  Batches without rows count as none."""

    def __init__(self, name: str, total: int | None = None, report: Callable[[dict], None] | None = None):
        self.name, self.total, self.report = name, total, report
        self.run, self.began, self.ended, self.error = None, time.time(), threading.Event(), None
        self.rows = self.batches = 0

    def state(self) -> dict:
        took = max(time.time() - self.began, 1e-9)
        rate = self.rows / took
        left = None if self.total is None or not rate else max(0, self.total - self.rows) / rate
        return {"processed": self.rows, "batches": self.batches, "rate": rate, "seconds_left": left, "error": self.error}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802, Spark's name
        if event.name == self.name:
            self.run, self.began = event.runId, time.time()

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        if event.progress.name == self.name and event.progress.numInputRows:
            self.rows += event.progress.numInputRows
            self.batches += 1
            if self.report:
                self.report(self.state())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        if event.runId == self.run:
            self.error = event.exception
            self.ended.set()

    def watch(self, start: Callable[[], StreamingQuery], spark) -> dict:
        """Starts a query of this name, waits for its end and for what the listener hears of it."""
        spark.streams.addListener(self)
        try:
            start().awaitTermination()
            self.ended.wait(30)
        finally:
            spark.streams.removeListener(self)
        return self.state()
