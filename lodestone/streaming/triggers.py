"""Debounce, save triggers, polls and throttling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from . import sessions
from ..session import ship

GAP, POLL, THROTTLE_MS = "1500 milliseconds", "6 hours", 12 * 60 * 60 * 1000


def debounce(edits: DataFrame, gap: str = GAP, workspace: str | None = None, lateness: str | None = None) -> DataFrame:
    """Scans after quiet times: for each burst of edits (ts, doc) its start, end and last document.

    There is one timer for a workspace, whatever the document; without a workspace column there is one at all,
    so that a stream's sessions have a single key by definition.  Works on tables and, with a watermark
    (`lateness`), on streams.  Of equal times the greater document counts as the last.  A table's bursts are found
    range by range (`sessions.bursts`), so one timer's edits are shared out among any number of tasks.
    """
    rows = edits.where("ts is not null").select(F.col("ts").cast("timestamp").alias("ts"), "doc", (F.col(workspace) if workspace else F.lit("w")).alias("workspace"))
    if not edits.isStreaming:
        return sessions.bursts(rows, gap)
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    burst = rows.groupBy("workspace", F.session_window("ts", gap).alias("s")).agg(F.max(F.struct("ts", "doc")).alias("last"), F.count("*").alias("edits"))
    return burst.select("workspace", F.col("s.start").alias("first_ts"), F.col("last.ts").alias("last_ts"), F.col("last.doc").alias("doc"), "edits")


def last_document(events: DataFrame, key: str | None = None) -> DataFrame:
    """The document of the latest event, for each key or at all."""
    return events.groupBy(*([key] if key else [])).agg(F.max_by("doc", F.struct("ts", "doc")).alias("doc"))


def target(active, last, first_open):
    """The document to scan: the active one, else the last, else the first open one."""
    return F.coalesce(active, last, first_open)


def polls(events: DataFrame, every: str = POLL) -> DataFrame:
    """The windows of a periodic poll in which events fall, with their number."""
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), every).alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def on_save(events: DataFrame, scan: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Calls scan(documents, batch) for the saved documents of each micro-batch."""
    saves = events.where("kind = 'save'").select("doc", "ts")
    return saves.writeStream.foreachBatch(lambda df, k: scan(df.select("doc").distinct(), k)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def throttle(polled: DataFrame, age_ms: int = THROTTLE_MS, parts: int | None = None) -> DataFrame:
    """Which polls (key, t in epoch ms) go through: the first, and each that comes age_ms or more after the last that did; `sessions.throttled`."""
    return sessions.throttled(polled.where("t is not null").select("key", F.col("t").cast("long").alias("t")), age_ms, parts)


class Throttle(StatefulProcessor):
    """`throttle` over a stream: a value state holds the last poll that went through, for as long as it can matter.

    With ttl_ms a timer that went quiet loses its state that long after its last poll by the clock (it should be the age at least); `every_ms`
    sets a processing-time timer that polls by itself, as a job that wakes up every so often does.
    """

    def __init__(self, age_ms: int, ttl_ms: int | None = None, every_ms: int | None = None):
        self.age, self.ttl, self.every = age_ms, ttl_ms, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long", ttlDurationMs=self.ttl)

    def _through(self, key: tuple, times: list[int], kind: str) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        last = held[0] if held else None
        rows = []
        for t in times:
            passed = last is None or t - last >= self.age
            last = t if passed else last
            rows.append((key[0], t, passed, kind))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(rows, columns=["key", "t", "passed", "kind"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.every and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        yield from self._through(key, sorted(t for b in rows for t in b["t"].tolist()), "poll")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(now + self.every)
        yield from self._through(key, [now], "timer")

    def close(self) -> None:
        pass


def throttle_stream(polled: DataFrame, age_ms: int = THROTTLE_MS, ttl_ms: int | None = None, every_ms: int | None = None) -> DataFrame:
    """`throttle` over a stream of polls: key, t, passed and kind (a poll of the stream, or of the timer's own).

    State lives in RocksDB, so that keys needn't fit into memory; polls of one micro-batch are taken in order of time.
    The session's state store is set to the RocksDB one, which such processors need; streams that have a checkpoint keep theirs.
    With ttl_ms or every_ms the clock drives it, so it needs a processingTime trigger: availableNow would not end.
    """
    ship(polled.sparkSession)
    polled.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "ProcessingTime" if every_ms or ttl_ms else "None"
    kind = polled.schema["key"].dataType.simpleString()
    return polled.select("key", "t").groupBy("key").transformWithStateInPandas(Throttle(age_ms, ttl_ms, every_ms), f"key {kind}, t long, passed boolean, kind string", "Append", mode)

