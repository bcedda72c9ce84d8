"""Live alarms: the same onsets however the stream is cut."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sigspark.streaming import alarms

START = dt.datetime(2024, 3, 1)


def onsets(rows, k, n, idle):
    out, state = [], {}
    for key, at, tie, flag in sorted(rows, key=lambda r: (r[1], r[2])):
        recent, active, last = state.get(key, ([], False, None))
        if idle is not None and last is not None and (at - last).total_seconds() > idle:
            recent, active = [], False
        recent = (recent + [bool(flag)])[-n:]
        now = sum(recent) >= k
        if now and not active:
            out.append((key, at, tie))
        state[key] = recent, now, at
    return sorted(out)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    draw, at = random.Random(1), tmp_path_factory.mktemp("landed")
    rows = [(draw.choice("abc"), START + dt.timedelta(seconds=draw.randrange(900), microseconds=draw.choice([0, 1, 999_999])), k, draw.choice([True, True, False, None])) for k in range(400)]
    files = {}
    for r in rows:                                                  # each row in its own minute's file or the next but one
        files.setdefault((r[1] - START).seconds // 60 + draw.randrange(3), []).append(r)
    for number in sorted(files):
        spark.createDataFrame(files[number], "key string, ts timestamp, tie int, flag boolean").coalesce(1).write.parquet(f"{at}/{number:03d}")
    return str(at), rows


@pytest.mark.parametrize("files, idle", [(1, None), (4, 20), (100, 20), (100, None)])
def test_the_trigger_does_not_matter(spark, landed, tmp_path, files, idle):
    folder, rows = landed
    schema = spark.read.parquet(folder + "/*").schema
    found = alarms.alarm_onsets(alarms.replay(spark, folder + "/*", "*.parquet", schema, files_per_batch=files), "key", "ts", "tie", "flag", 2, 3, "200 seconds", idle)
    before = spark.conf.get(alarms.STATE_STORE, None)
    got = sorted(tuple(r) for r in alarms.run_to_table(found, str(tmp_path / "t"), str(tmp_path / "c")).collect())
    assert spark.conf.get(alarms.STATE_STORE, None) == before
    mark = max(r[1] for r in rows).replace(microsecond=max(r[1] for r in rows).microsecond // 1000 * 1000) - dt.timedelta(seconds=200)
    assert got == onsets([r for r in rows if r[1] <= mark], 2, 3, idle) and got


def test_state_of_silent_keys_goes(spark, tmp_path):
    rows = [("gone", START, 1, True), ("gone", START + dt.timedelta(seconds=1), 2, True), ("here", START + dt.timedelta(hours=1), 3, True), ("here", START + dt.timedelta(hours=2), 4, True)]
    for number, r in enumerate(rows):
        spark.createDataFrame([r], "key string, ts timestamp, tie int, flag boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    found = alarms.alarm_onsets(alarms.replay(spark, f"{tmp_path}/in/*", "*.parquet", spark.read.parquet(f"{tmp_path}/in/*").schema, files_per_batch=1), "key", "ts", "tie", "flag", 2, 3, "1 second", 60)
    got = alarms.run_to_table(found, str(tmp_path / "t"), str(tmp_path / "c")).collect()
    assert [tuple(r) for r in got] == [("gone", START + dt.timedelta(seconds=1), 2)]
    state = spark.read.format("statestore").option("stateVarName", "memory").load(str(tmp_path / "c"))
    assert {r[0] for r in state.select(F.col("key.alarm_key")).collect()} == {"here"}


class Memory:
    """One key's state and timers, counting the calls that would go to the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_key_with_rows_has_one_turn_a_batch():
    class Clock:
        def __init__(self, mark):
            self.mark = mark

        def getCurrentWatermarkInMs(self):
            return self.mark

    alarm, memory, found = alarms.KOfNAlarm(2, 3, None, "int"), Memory(), []
    alarm.init(memory)
    rows = [(1000 * s, s, s % 5 < 2) for s in range(60)]            # (microseconds, tie, flag), ten a batch, five of them behind the watermark
    for first in range(0, 60, 10):
        memory.calls, clock = 0, Clock(first + 5)
        batch = [alarms.Row(alarm_at=a, alarm_tie=t, alarm_flag=int(f)) for a, t, f in reversed(rows[first:first + 10])]
        found += [r.alarm_at for r in alarm.handleInputRows(("a",), iter(batch), clock)]
        for timer in sorted(t for t in memory.timers if t <= clock.mark):
            found += [r.alarm_at for r in alarm.handleExpiredTimer(("a",), clock, None)]
            memory.timers.discard(timer)
        assert memory.calls <= 4, "state is read and written once, the timer moved once"
    assert found == [1000 * s for s in range(1, 56, 5)]
