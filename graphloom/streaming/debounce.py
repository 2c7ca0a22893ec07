"""Changes of many trees as a stream: each tree's are held back for a fixed delay and given out together, once for each path.

State is one window a tree: when its first pending change came, and the pending paths.  Later changes don't put the window off.
More paths than ``most`` are not kept: the window then asks for a full scan.  An event-time timer closes the window; a change
that came after its end closes it too, and opens the next.  State survives a restart from the checkpoint.
"""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

#: Window of pending changes when it closes: ``path`` and ``change`` are null where a full scan is asked for.
OUTPUT = "tree string, since long, due long, path string, change string, coalesced long, full_scan boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debouncer(StatefulProcessor):
    """Times are microseconds; a micro-batch's changes of one tree are put in order of time and ``seq``."""

    def __init__(self, delay_ms: int, most: int):
        self.delay, self.most = delay_ms * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "since long, full boolean, dropped long")
        self.pending = handle.getMapState("pending", "path string", "change string, n long")

    def _load(self) -> tuple[int | None, bool, int, dict[str, tuple[str, int]]]:
        if not self.window.exists():
            return None, False, 0, {}
        since, full, dropped = self.window.get()
        return since, full, dropped, {k[0]: (v[0], v[1]) for k, v in self.pending.iterator()}

    def _closed(self, tree: str, since: int, full: bool, dropped: int, held: dict[str, tuple[str, int]]) -> pd.DataFrame:
        rows = [(None, None, dropped, True)] if full else [(p, c, n, False) for p, (c, n) in sorted(held.items())]
        out = pd.DataFrame(rows, columns=["path", "change", "coalesced", "full_scan"])
        out.insert(0, "due", since + self.delay)
        out.insert(0, "since", since)
        out.insert(0, "tree", tree)
        return out

    def _timer(self, since: int) -> int:
        return math.ceil((since + self.delay) / 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        since, full, dropped, held = self._load()
        began, before = since, set(held)
        for path, change, ts in zip(batch["path"], batch["change"], batch["at"], strict=True):
            if since is not None and ts >= since + self.delay:
                yield self._closed(key[0], since, full, dropped, held)
                since, full, dropped, held = None, False, 0, {}
            if since is None:
                since = int(ts)
            if full:
                dropped += 1
                continue
            held[path] = change, held[path][1] + 1 if path in held else 1
            if len(held) > self.most:
                full, dropped, held = True, sum(n for _, n in held.values()), {}
        if began is not None and began != since:
            self.handle.deleteTimer(self._timer(began))
        if since is not None:
            if began != since:
                self.handle.registerTimer(self._timer(since))
            self.window.update((since, full, dropped))
            for path in before - set(held):
                self.pending.removeKey((path,))
            for path, value in held.items():
                self.pending.updateValue((path,), value)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        since, full, dropped, held = self._load()
        if since is not None:
            yield self._closed(key[0], since, full, dropped, held)
        self.window.clear()
        self.pending.clear()

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in the store that timers and maps need; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def debounced(changes: DataFrame, delay_ms: int, most: int = 1000, late: str = "0 seconds") -> DataFrame:
    """A stream of ``tree, path, change, ts, seq`` as its windows close; changes that come more than ``late`` behind are dropped.

    The changes of one tree in one micro-batch are put in order together, so bound what a trigger reads.  Start it within ``state_store``.
    """
    at = F.col("ts").cast("timestamp")
    rows = changes.select("tree", "path", "change", at.alias("ts"), F.unix_micros(at).alias("at"), F.col("seq").cast("long").alias("seq")).withWatermark("ts", late)
    closed = rows.groupBy("tree").transformWithStateInPandas(Debouncer(delay_ms, most), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    return closed.withColumns({c: F.timestamp_micros(c) for c in ("since", "due")})


class LifecycleLog(StreamingQueryListener):
    """Started, progressed, failed and ended events of queries, the first ``most`` of each run, as rows of a table.

    ``run_id, number, event, at, batch, rows, detail``; a run's rows are written when it ends, and at every ``every``-th event before.
    """

    SCHEMA = "run_id string, number int, event string, at string, batch long, rows long, detail string"

    def __init__(self, spark: SparkSession, path: str, most: int = 200, every: int = 50):
        self.spark, self.path, self.most, self.every = spark, path, most, every
        self.runs: dict[str, int] = {}
        self.waiting: list[tuple] = []
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _add(self, run: Any, event: str, at: str | None, batch: int | None = None, rows: int | None = None, detail: str | None = None) -> None:
        run = str(run)
        with self.lock:
            number = self.runs[run] = self.runs.get(run, 0) + 1
            # The end of a run is always told; else a long run would seem to go on.
            if number <= self.most or event in ("ended", "failed"):
                self.waiting.append((run, number, event, at, batch, rows, detail))
            if self.waiting and (len(self.waiting) >= self.every or event in ("ended", "failed")):
                self.spark.createDataFrame(self.waiting, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
                self.waiting = []
        if event in ("ended", "failed"):
            self._end(run).set()

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def wait(self, run: Any, seconds: float = 60) -> bool:
        """Events come late; whether the end of a run was written in time."""
        return self._end(str(run)).wait(seconds)

    def onQueryStarted(self, event: Any) -> None:
        self._add(event.runId, "started", event.timestamp, detail=event.name)

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        self._add(p.runId, "progressed" if p.numInputRows else "idle", p.timestamp, p.batchId, p.numInputRows, json.dumps(dict(p.durationMs)))

    def onQueryIdle(self, event: Any) -> None:
        self._add(event.runId, "idle", event.timestamp)

    def onQueryTerminated(self, event: Any) -> None:
        self._add(event.runId, "failed" if event.exception else "ended", None, detail=event.exception)
