"""Streams: linkers in micro-batches, predecessors from state, sequences, scoped timelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engram.operators import edges as E
from engram.operators.store import Versioned
from engram.operators.timeline import micros, scoped, sequenced

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def merge_edges(link: Callable[[DataFrame], DataFrame], table: Versioned) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the batch's edges are merged into the table. A batch that is run again changes nothing.

    link must give final edges of a batch (see linkers); nothing is dropped under load, batches are
    kept small by the source's limits.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = link(batch)
        stored = table.read()
        table.write(E.merge(new.limit(0) if stored is None else stored, new))

    return sink


def number(table: Versioned) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends event_seq after the highest one given so far; a batch run again keeps its numbers."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        stored = table.read()
        if stored is not None and not stored.where(F.col("batch_id") == batch_id).isEmpty():
            return
        top = 0 if stored is None else stored.agg(F.max("event_seq")).first()[0] or 0
        new = sequenced(batch, "event_time", "memory_id", start=top).withColumn("batch_id", F.lit(batch_id).cast("long"))
        table.write(new if stored is None else stored.unionByName(new))

    return sink


def timeline(events: DataFrame) -> DataFrame:
    """The scoped timeline of a stream of events, to be appended."""
    return scoped(events).select("scope", "event_seq", "memory_id", "memory_type", F.col("project").cast("string").alias("project"), "session_id")


class _InEventOrder(StatefulProcessor):
    """Of one session: events that the watermark has not passed, and the last one that it has."""

    ROW = "at long, event_seq long, memory_id string"

    def __init__(self, idle: int):
        self.idle = idle  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.last = handle.getListState("waiting", self.ROW), handle.getValueState("last", self.ROW)

    def _wake(self, at: int) -> None:
        """Call again once the watermark has passed an instant."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(at), int(seq), mid) for r in rows for at, seq, mid in zip(r["at"], r["event_seq"], r["memory_id"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for row in ready:
            if last is not None and row[0] - last[0] <= self.idle and row[2] != last[2]:
                out.append((row[2], last[2], key[0]))
            last = row
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
            if rest:
                self._wake(rest[0][0])
        if last is not None and passed > last[0] + self.idle:
            self.last.clear()  # whatever comes now is further away than idle
        elif ready:
            self.last.update(last)
            self._wake(last[0] + self.idle)
        if out:
            yield pd.DataFrame(out, columns=["source_id", "target_id", "session_id"])

    def close(self) -> None:
        pass


def session_predecessors(events: DataFrame, late: str = "10 minutes", idle: str = "7 days") -> DataFrame:
    """(source_id, target_id, session_id) of events(session_id, event_time, event_seq, memory_id): each event and the one before it.

    Order is that of the events, (event_time, event_seq, memory_id), in whatever order and batches they come: an event
    waits in its session's state until the watermark, `late` behind the latest event, has passed it.
    The edges are those of timeline.predecessors_in_time(events, idle). An event behind the watermark is dropped by the engine and
    counted in its metrics; predecessors_in_time() over the stored events is the full truth. Events without a session,
    time, event_seq or id are left out. A session's state goes once the watermark is `idle` after its last event.

    Needs the RocksDB state store; `state_store` sets it. `idle` is a number and a unit, of weeks at most.
    """
    if "RocksDB" not in (events.sparkSession.conf.get(STATE_STORE) or ""):
        raise ValueError(f"{STATE_STORE} must name the RocksDB provider before the stream is started")
    rows = events.select("session_id", F.col("event_time").cast("timestamp").alias("event_time"), F.col("event_seq").cast("long").alias("event_seq"), "memory_id").dropna()
    rows = rows.withWatermark("event_time", late).withColumn("at", F.unix_micros("event_time"))
    return rows.groupBy("session_id").transformWithStateInPandas(_InEventOrder(micros(idle)), "source_id string, target_id string, session_id string", "Append", "EventTime")


def state_store(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB. A stream that runs already, or goes on from a checkpoint, keeps its own kind."""
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n): events by tumbling window, late ones up to a bound."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n")
