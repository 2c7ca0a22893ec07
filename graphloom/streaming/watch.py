"""Watching a tree: changes of polls, coalescing, and incremental refresh by micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..ingest.incremental import drift


def poll_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, changed and deleted paths between two polls of ``relative_path, content_hash``."""
    return drift(after, before)


def coalesce(changes: DataFrame) -> DataFrame:
    """Per path the last change and how many there were.  ``changes``: path, change, ts, and seq for ties."""
    return changes.groupBy("path").agg(F.max_by("change", F.struct("ts", "seq")).alias("change"), F.count(F.lit(1)).alias("coalesced"))


def overflow(changes: DataFrame, most_paths: int) -> DataFrame:
    """What each batch asks for: ``batch, path, change, full_scan``.  A batch of more than ``most_paths`` paths drops them and asks for a full scan.  ``changes``: batch, path, change, ts, seq."""
    latest = changes.groupBy("batch", "path").agg(F.max_by("change", F.struct("ts", "seq")).alias("change"))
    many = latest.groupBy("batch").agg((F.count(F.lit(1)) > most_paths).alias("full_scan"))
    few = latest.join(many, "batch").where("not full_scan").select("batch", "path", "change", "full_scan")
    none = F.lit(None).cast("string")
    return many.where("full_scan").select("batch", none.alias("path"), none.alias("change"), "full_scan").unionByName(few)


def backoff(failures: int, poll_seconds: float, most: float = 30.0) -> float:
    """Doubles with each failure in a row."""
    return min(poll_seconds * 2 ** max(0, failures - 1), most)


@dataclass
class Debounce:
    """Fires a fixed delay after the first pending change; later ones don't put it off.  Too many pending paths turn the next scan into a full one."""

    delay: float
    most_pending: int = 1000
    pending: dict[str, str] = field(default_factory=dict)
    since: float | None = None
    coalesced: int = 0
    full: bool = False

    def put(self, path: str, change: str, now: float) -> None:
        if self.since is None:
            self.since = now
        if path in self.pending:
            self.coalesced += 1
        self.pending[path] = change
        if len(self.pending) > self.most_pending:
            self.pending.clear()
            self.full = True

    def due(self, now: float) -> bool:
        return self.since is not None and now - self.since >= self.delay

    def take(self) -> tuple[dict[str, str], bool]:
        out = dict(self.pending), self.full
        self.pending, self.since, self.full = {}, None, False
        return out


class Lifecycle:
    """What happened to a watch, the first ``most`` events of it."""

    def __init__(self, most: int = 200):
        self.most, self.events, self.dropped = most, [], 0

    def add(self, event: str, **details: object) -> None:
        if len(self.events) < self.most:
            self.events.append({"event": event, **details})
        else:
            self.dropped += 1


class Terminal(Exception):
    """A scan failed in a way that trying again can't mend."""


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Spark jobs started within belong to a group; what is yielded cancels them, from any thread."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: spark.sparkContext.cancelJobGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def attempt(scan: Callable[[], None], poll_seconds: float, retries: int = 5, log: Lifecycle | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """Runs a scan, again after a growing wait while it fails; a ``Terminal`` failure, or the last one, goes to the caller."""
    log = log or Lifecycle()
    for failures in range(retries + 1):
        log.add("scan_started", attempt=failures + 1)
        try:
            scan()
        except Terminal as e:
            log.add("scan_failed", reason=str(e), retry=False)
            raise
        except Exception as e:
            again = failures < retries
            log.add("scan_failed", reason=type(e).__name__, retry=again)
            if not again:
                raise
            sleep(backoff(failures + 1, poll_seconds))
        else:
            log.add("scan_completed", attempt=failures + 1)
            return


def refresh(source: DataFrame, scan: Callable[[DataFrame, int], None], checkpoint: str, most_paths: int = 10_000, full_scan: Callable[[int], None] | None = None, poll_seconds: float = 1.0, log: Lifecycle | None = None) -> StreamingQuery:
    """Runs ``scan`` on each micro-batch of changes, coalesced by path; a batch of too many paths runs ``full_scan``.

    ``source`` is a stream of path, change, ts and seq.  A scan that fails is tried again, later each time; the
    checkpoint replays the batch when it fails for good.
    """

    def each(batch: DataFrame, number: int) -> None:
        latest = coalesce(batch)
        if full_scan is not None and latest.limit(most_paths + 1).count() > most_paths:
            attempt(lambda: full_scan(number), poll_seconds, log=log)
        elif not latest.isEmpty():
            attempt(lambda: scan(latest, number), poll_seconds, log=log)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Changes by kind and event-time window; works on a stream, where late data is dropped after ``late``, and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
