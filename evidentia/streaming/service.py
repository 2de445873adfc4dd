"""The capture service: one streaming query a source, each with its own interval, checkpoint and restarts.

A source that fails ends its own query only. A StreamingQueryListener notes which query ended and why; the
service starts it again from its checkpoint after a pause that doubles up to a bound, and a batch that
succeeds resets the pause. The status (a JSON text below the service's folder) is written when it changes, else once a
minute.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Fixed values, seconds: conversations, code, vectors not yet made, other devices' lines.
CONVERSATIONS, CODE, RECHECK, PULL = 5, 120, 600, 60
RETRY, LONGEST_RETRY, STATUS_EVERY = 5.0, 300.0, 60.0
#: Characters of an error that a status keeps.
SAID = 4000


@dataclass
class Source:
    """A stream and what is done with its batches. stream() is called anew at each start."""

    name: str
    stream: Callable[[], DataFrame]
    land: Callable[[DataFrame, int], None]
    every: float = CONVERSATIONS


@dataclass
class _State:
    query: StreamingQuery | None = None
    error: str | None = None
    failures: int = 0
    pause: float = RETRY
    due: float = 0.0
    rows: int = 0
    batches: int = 0
    landed: int = field(default=-1)


class _Listener(StreamingQueryListener):
    def __init__(self, service: Service):
        self.service = service

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.service._progress(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.service._ended(str(event.id), event.exception)


class Service:
    def __init__(self, spark: SparkSession, sources: list[Source], folder: str, *, retry: float = RETRY, clock=time.monotonic):
        if len({s.name for s in sources}) < len(sources):
            raise ValueError("two sources have one name")
        self.spark, self.folder, self.retry, self.clock = spark, folder.rstrip("/"), retry, clock
        self.sources = {s.name: s for s in sources}
        self.states = {s.name: _State(pause=retry) for s in sources}
        self.names: dict[str, str] = {}  # of queries by id
        self.lock = threading.Lock()
        self.written: tuple[dict, float] | None = None
        self.listener: _Listener | None = None

    def _start(self, name: str, **trigger) -> StreamingQuery | None:
        source, state = self.sources[name], self.states[name]
        try:
            writer = source.stream().writeStream.foreachBatch(source.land).option("checkpointLocation", f"{self.folder}/state/{name}")
            query = writer.queryName(f"{name}-{time.time_ns()}").trigger(**trigger).start()
        except Exception as error:  # noqa: BLE001  a source that cannot start must not stop the others
            self._failed(state, error)
            return None
        with self.lock:
            self.names[str(query.id)], state.query = name, query
        return query

    def _failed(self, state: _State, error: object) -> None:
        with self.lock:
            state.query, state.error, state.failures = None, str(error)[:SAID], state.failures + 1
            state.due, state.pause = self.clock() + state.pause, min(LONGEST_RETRY, state.pause * 2)

    def _progress(self, progress) -> None:
        with self.lock:
            if (name := self.names.get(str(progress.id))) is None:
                return
            state = self.states[name]
            if progress.batchId > state.landed:
                state.landed, state.batches, state.rows = progress.batchId, state.batches + 1, state.rows + progress.numInputRows
            state.error, state.pause = None, self.retry

    def _ended(self, query_id: str, error: str | None) -> None:
        name = self.names.get(query_id)
        if name and error:
            self._failed(self.states[name], error)

    def run_once(self) -> dict:
        """One pass: every source takes what waits, side by side, and its errors stay its own."""
        queries = {name: self._start(name, availableNow=True) for name in self.sources}
        for name, query in queries.items():
            if query is None:
                continue
            state = self.states[name]
            try:
                query.awaitTermination()
            except Exception as error:  # noqa: BLE001
                self._failed(state, error)
                continue
            with self.lock:
                state.query, state.error, state.pause = None, None, self.retry
                state.rows += sum(p.numInputRows for p in query.recentProgress)
                state.batches += sum(p.numInputRows > 0 for p in query.recentProgress)
        return self.write_status()

    def start(self) -> None:
        """Start a query for each source; tend() keeps them going."""
        self.listener = _Listener(self)
        self.spark.streams.addListener(self.listener)
        for name, source in self.sources.items():
            self._start(name, processingTime=f"{source.every} seconds")

    def tend(self) -> dict:
        """Start again what ended and is due."""
        for name, source in self.sources.items():
            state = self.states[name]
            if state.query is not None and not state.query.isActive and state.error is None and (error := state.query.exception()) is not None:
                self._failed(state, error)  # the listener may be late
            if (state.query is None or not state.query.isActive) and self.clock() >= state.due:
                self._start(name, processingTime=f"{source.every} seconds")
        return self.write_status()

    def run(self, seconds: float | None = None, every: float = 1.0) -> None:
        """Start and tend until the time is over, or for ever."""
        self.start()
        end = None if seconds is None else self.clock() + seconds
        try:
            while end is None or self.clock() < end:
                self.tend()
                time.sleep(every)
        finally:
            self.stop()

    def stop(self) -> None:
        for state in self.states.values():
            if state.query is not None and state.query.isActive:
                state.query.stop()
        if self.listener:
            self.spark.streams.removeListener(self.listener)
            self.listener = None

    def status(self) -> dict:
        with self.lock:
            sources = {name: {"running": s.query is not None and s.query.isActive, "error": s.error, "failures": s.failures, "rows": s.rows, "batches": s.batches} for name, s in self.states.items()}
        return {"status": "CAPTURE_ERRORS" if any(s["error"] for s in sources.values()) else "CAPTURE_OK", "sources": sources}

    def write_status(self) -> dict:
        now, found = self.clock(), self.status()
        if self.written is None or self.written[0] != found or now - self.written[1] >= STATUS_EVERY:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/status.json")
            out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
            out.write(bytearray(json.dumps(found).encode()))
            out.close()
            self.written = found, now
        return found
