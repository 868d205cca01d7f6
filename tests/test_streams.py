"""Alert suppression by event time."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from docloom.streaming import flows

START = datetime(2024, 7, 1)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, flows.ROCKSDB)
    yield
    spark.conf.set(key, before)


def raised(spark, tmp_path, files, silence, late):
    kind = "alert_type string, triggered_at timestamp"
    for i, rows in enumerate(files):
        made = [(k, START + timedelta(hours=h)) for k, h in rows]
        spark.createDataFrame(made, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = flows.suppressed(stream, silence, late).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sorted((r.alert_type, (r.triggered_at - START) / timedelta(hours=1)) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_out_of_order_alerts_give_what_a_replay_gives(spark, tmp_path, rocksdb):
    files = [
        [("warning", 3), ("warning", 0.5), ("limit", 5)],
        [("warning", 1), ("warning", 0), ("warning", 0), ("limit", 4)],  # out of order over triggers
        [("warning", 24.5), ("warning", 30)],
        [("warning", 24), ("warning", 23.9), ("limit", 29)],
        [("end", 200)],
        [("warning", 26), ("end", 201)],  # too late: dropped
    ]
    assert raised(spark, tmp_path, files, timedelta(hours=24), "8 hours") == [("limit", 4), ("limit", 29), ("warning", 0), ("warning", 24)]


class _State:
    """A value or a map of one key; written counts what goes into it."""

    def __init__(self, written):
        self.rows, self.written = {}, written

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self.rows.clear()

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value
        self.written.append(len(value[0]) if hasattr(value[0], "__len__") else 1)

    def keys(self):
        return iter(list(self.rows))

    def removeKey(self, key):
        del self.rows[key]


class _Handle:
    def __init__(self):
        self.written, self.timers = [], []

    def getValueState(self, *_):
        return _State(self.written)

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.append(ms)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_trigger_writes_only_the_hours_of_waiting_alerts_that_it_touches():
    hour, handle = 3_600_000_000, _Handle()
    made = flows._Suppress(timedelta(hours=24))
    made.init(handle)
    give = lambda us: list(made.handleInputRows(("a",), iter([pd.DataFrame({"us": us})]), _At(0)))
    give([h * hour + i for h in range(100) for i in range(1000)])
    handle.written.clear()
    give([99 * hour + 5000])
    assert sum(handle.written) <= 8 * 1001
    assert made._times(99).tolist() == [99 * hour + i for i in [*range(1000), 5000]]


def test_waiting_alerts_over_hours_are_raised_as_a_replay_raises_them():
    rng, silence = random.Random(5), 24 * 3_600_000_000
    times = [rng.randrange(60 * silence) for _ in range(3000)] * 2
    late = 2 * silence
    handle, raised, newest, at = _Handle(), [], 0, sorted(times, key=lambda t: t + rng.randrange(late))
    made = flows._Suppress(timedelta(microseconds=silence))
    made.init(handle)

    def fire(ms):
        ready = sorted(t for t in handle.timers if t <= ms)
        handle.timers[:] = [t for t in handle.timers if t > ms]
        for _ in ready:
            for b in made.handleExpiredTimer(("a",), _At(ms), None):
                raised.extend(b["us"].tolist())

    for i in range(0, len(at), 97):
        part = at[i : i + 97]
        list(made.handleInputRows(("a",), iter([pd.DataFrame({"us": part})]), _At(0)))
        newest = max(newest, *part)
        fire((newest - late) // 1000)
    for _ in range(3):
        fire(100 * silence // 1000)
    want = []
    for t in sorted(set(times)):
        if not want or t - want[-1] >= silence:
            want.append(t)
    assert raised == want and not made.waiting.exists() and not made.last.exists()
