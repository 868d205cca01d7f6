"""Ingest, usage windows and alert suppression over streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.cost import SILENCE
from ..plans.config import Config
from ..plans.ingest import ingest
from ..sources.commits import Store
from ..sources.files import store_chunks


def ingest_stream(documents: DataFrame, chunks_path: str, checkpoint: str, config: Config | None = None, every: str | None = None) -> StreamingQuery:
    """Chunks of a stream of documents (id, text, error, metadata, file_path, content_type). A batch that is run again
    writes the same rows: chunks replace those of their documents. Takes what is there and ends, or looks again after each
    interval of `every` ("30 seconds")."""

    def write(batch: DataFrame, _: int) -> None:
        made, _outcomes = ingest(batch.dropDuplicates(["id"]), config)
        store_chunks(made, chunks_path)

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def ingest_to_store(documents: DataFrame, store: Store, checkpoint: str, name: str = "ingest", config: Config | None = None, every: str | None = None) -> StreamingQuery:
    """ingest_stream() into the table "chunks" of a store of commits: a batch writes what it brings, and one that is run
    again after its commit writes nothing. The stream goes by name in the store."""

    def write(batch: DataFrame, number: int) -> None:
        made, _outcomes = ingest(batch.dropDuplicates(["id"]), config)
        store.transact(lambda _: {"chunks": store.put("chunks", made)}, (name, number))

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def usage_windows(usage: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Requests and cost by window, provider and operation; rows later than `late` are left out. Works on batches too."""
    timed = usage.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", width).alias("w"), "provider", "operation").agg(F.count("*").alias("request_count"), F.sum("cost_usd").alias("total_cost")).select(
        F.col("w.start").alias("window_start"), "provider", "operation", "request_count", "total_cost"
    )


def silenced(alerts: DataFrame, silence: timedelta = SILENCE) -> DataFrame:
    """Of a stream of candidate alerts (alert_type, triggered_at) those with none of their type raised less than `silence`
    before; the state holds the last raised one's time. Each trigger takes its rows in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        times = sorted(t for b in batches for t in b["triggered_at"])
        out = []
        for t in times:
            if last is None or t - last >= silence:
                out.append(t)
                last = t
        if last is not None:
            state.update((last.isoformat(),))
        yield pd.DataFrame({"alert_type": [key[0]] * len(out), "triggered_at": out})

    return alerts.groupBy("alert_type").applyInPandasWithState(step, "alert_type string, triggered_at timestamp", "last string", "append", GroupStateTimeout.NoTimeout)


HOUR, HELD = 3_600_000_000, 1 << 20  # microseconds; times that a task holds before they go into the state
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Suppress(StatefulProcessor):
    """Of one alert type: the time of the last alert raised, and candidates that wait for the watermark: of each hour the
    sorted distinct times as one packed value, so that a trigger reads and writes the hours that it touches."""

    def __init__(self, silence: timedelta):
        self.silence = silence // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.waiting = handle.getMapState("waiting", "hour long", "us binary")

    def _last(self) -> int | None:
        return self.last.get()[0] if self.last.exists() else None

    def _times(self, hour: int) -> np.ndarray:
        return np.frombuffer(self.waiting.getValue((hour,))[0], np.int64)

    def _keep(self, new: list[np.ndarray]) -> None:
        """Adds times to their hours."""
        times = np.unique(np.concatenate(new))
        for part in np.split(times, np.flatnonzero(np.diff(times // HOUR)) + 1):
            hour = int(part[0] // HOUR)
            have = self._times(hour) if self.waiting.containsKey((hour,)) else part[:0]
            self.waiting.updateValue((hour,), (np.union1d(have, part).tobytes(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, new, first = self._last(), [], None
        for batch in rows:
            us = np.unique(batch["us"].to_numpy(np.int64))
            us = us if last is None else us[us - last >= self.silence]  # others are silent whatever comes
            if len(us):
                new.append(us)
                first = int(us[0]) if first is None else min(first, int(us[0]))
            if sum(map(len, new)) >= HELD:
                self._keep(new)
                new = []
        if new:
            self._keep(new)
        if first is not None:  # what waited before has a timer
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # all up to here has come
        last, out, ripe, first = self._last(), [], False, None
        for hour in sorted(k[0] for k in self.waiting.keys()):
            if last is not None and (hour + 1) * HOUR <= last + self.silence:  # silent whatever comes
                self.waiting.removeKey((hour,))
                ripe = True
                continue
            times = self._times(hour)
            n = int(np.searchsorted(times, now, "right"))
            at = 0 if last is None else int(np.searchsorted(times, last + self.silence))
            while at < n:
                last = int(times[at])
                out.append(last)
                at = int(np.searchsorted(times, last + self.silence))
            left = times[max(n, at) :]
            ripe = ripe or len(left) < len(times)
            if not len(left):
                self.waiting.removeKey((hour,))
                continue
            if len(left) < len(times):
                self.waiting.updateValue((hour,), (left.tobytes(),))
            first = int(left[0])
            break  # later hours have nothing ripe
        if ripe and first is not None:
            self.handle.registerTimer(-(-first // 1000))
        if out:
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.silence) // 1000))  # by then the last alert is forgotten
        elif last is not None and now >= last + self.silence:
            self.last.clear()
        return iter([pd.DataFrame({"alert_type": [key[0]] * len(out), "us": out})] if out else [])

    def close(self) -> None:
        pass


def suppressed(alerts: DataFrame, silence: timedelta = SILENCE, late: str = "1 hour") -> DataFrame:
    """Of a stream of candidate alerts (alert_type, triggered_at) those with none of their type raised less than `silence`
    before, by event time: a candidate waits until the watermark, `late` behind the newest, has passed it, so out-of-order
    and repeated rows within that give what replay_alerts gives over the whole log. Later rows are dropped. The state holds
    each type's last alert, for as long as it silences others, and the candidates that wait. Needs the RocksDB state store
    (ROCKSDB as spark.sql.streaming.stateStore.providerClass)."""
    at = F.col("triggered_at").cast("timestamp")
    timed = alerts.select("alert_type", at.alias("triggered_at"), F.unix_micros(at).alias("us")).withWatermark("triggered_at", late)
    found = timed.groupBy("alert_type").transformWithStateInPandas(_Suppress(silence), "alert_type string, us long", "append", "eventTime")
    return found.select("alert_type", F.timestamp_micros("us").alias("triggered_at"))
