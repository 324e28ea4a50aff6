"""Progress of streams and imports: counts and rates, no more often than every EVERY seconds."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

#: seconds between two events at least
EVERY = 0.25


class Throttle:
    """Passes events on, of those that come too soon the newest, once the time is there or ``flush`` is called."""

    def __init__(self, sink: Callable[[dict], None], every: float = EVERY, clock: Callable[[], float] = time.monotonic):
        self.sink, self.every, self.clock = sink, every, clock
        self._last, self._waiting, self._lock = -every, None, threading.Lock()

    def __call__(self, event: dict) -> None:
        with self._lock:
            now = self.clock()
            if now - self._last < self.every:
                self._waiting = event
                return
            self._last, self._waiting = now, None
        self.sink(event)

    def flush(self) -> None:
        with self._lock:
            event, self._waiting = self._waiting, None
        if event is not None:
            self.sink(event)


class StreamProgress(StreamingQueryListener):
    """Rows and rates of every micro-batch of the session's queries, and how each query ended."""

    def __init__(self, sink: Callable[[dict], None], every: float = EVERY):
        self.told = Throttle(sink, every)
        self.rows = 0

    def onQueryStarted(self, event: object) -> None:
        self.told({"query": str(event.id), "state": "started"})

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        self.rows += p.numInputRows
        self.told({"query": str(p.id), "state": "running", "batch": p.batchId, "rows": self.rows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event: object) -> None:
        self.told.flush()

    def onQueryTerminated(self, event: object) -> None:
        self.told.flush()
        self.told.sink({"query": str(event.id), "state": "failed" if event.exception else "finished", "rows": self.rows})
