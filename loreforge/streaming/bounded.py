"""A watch with a bound: progress of a streaming query as JSON lines, ended by time or by number of batches.

Every watch tells ``start`` first and ``shutdown`` last, whatever happens in between, and
``error`` before the latter if the query fails.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Seconds after which a watch ends if not told otherwise (fixed value).
DEFAULT_SECONDS = 60.0


class _Lines(StreamingQueryListener):
    """Progress of one query."""

    def __init__(self, run: str, tell: Callable[..., None]):
        self.run, self.tell, self.batches = run, tell, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        if str(progress.runId) == self.run:
            self.batches += 1
            self.tell("progress", batch=progress.batchId, rows=progress.numInputRows)

    def onQueryIdle(self, event):
        if str(event.runId) == self.run:
            self.tell("idle")

    def onQueryTerminated(self, event):
        pass


def watched(query: StreamingQuery, write: Callable[[str], None], seconds: float = DEFAULT_SECONDS, batches: int | None = None) -> int:
    """Follow a running query until it ends, ``seconds`` are over or ``batches`` are done, and stop it; 0, or 1 if it failed.

    ``write`` gets lines of JSON with event, query and at (milliseconds).
    """
    lock, ended = threading.Lock(), time.monotonic() + seconds

    def tell(event: str, **more: object) -> None:
        with lock:
            write(json.dumps({"event": event, "query": query.name or str(query.id), "at": int(time.time() * 1000)} | more))

    lines, code, reason = _Lines(str(query.runId), tell), 0, "time"
    streams = SparkSession.active().streams
    tell("start", seconds=seconds)
    streams.addListener(lines)
    try:
        while (left := ended - time.monotonic()) > 0:
            if query.awaitTermination(max(min(left, 0.2), 0.01)):
                reason = "done"
                break
            if batches is not None and lines.batches >= batches:
                reason = "batches"
                break
    except StreamingQueryException as error:
        tell("error", message=str(error).splitlines()[0][:200])
        code, reason = 1, "error"
    finally:
        if query.isActive:
            query.stop()
        streams.removeListener(lines)
        tell("shutdown", reason=reason, batches=lines.batches)
    return code
