"""Streams with timers over several batches, against the same rules in batch form and in plain Python."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnquery.operators import tasks
from tarnquery.streaming import events as E
from tarnquery.streaming import timers

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROWS = "key long, ts timestamp, event_id long, {}"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def us(seconds):
    return int(at(seconds).timestamp()) * timers.SECOND + round(seconds % 1 * timers.SECOND)


@pytest.fixture
def run(spark, tmp_path):
    def go(batches, field, processor, out):
        """Batches as files that come one after the other; the stream is started anew for each."""
        folder, name = f"file://{tmp_path}/in", ROWS.format(field)
        for k, rows in enumerate(batches):
            spark.createDataFrame([(key, at(s), event, x) for key, s, event, x in rows], name).coalesce(1).write.parquet(f"{folder}/part={k}")
            stream = spark.readStream.schema(name).parquet(f"{folder}/part=*").select("key", "ts", "event_id", field.split()[0])
            with timers.timers_kept(spark):
                got = E.run_to_table(timers.timed(stream, processor, out, "10 seconds"), f"file://{tmp_path}/out", "append")
        return sorted((tuple(r) for r in got.collect()), key=str)

    return go


TASK_OUT = "event_id long, us long, from_state string, to_state string, attempts long"


def test_a_failed_task_comes_back_by_itself(run):
    big = 2**60 + 1
    batches = [[(1, 0, big, "queued"), (1, 5, 2, "failed"), (2, 1, 3, "failed")], [(1, 30, 5, "failed"), (1, 29, 4, "processing")], [(1, 31, 6, "completed"), (9, 100, 7, "queued")]]
    assert run(batches, "state string", timers.TaskTimers(), TASK_OUT) == sorted([
        (1, big, us(0), "new", "queued", 0), (1, 2, us(5), "queued", "retrying", 1), (1, None, us(7), "retrying", "queued", 1),
        (1, 4, us(29), "queued", "processing", 1), (1, 5, us(30), "processing", "retrying", 2), (1, 6, us(31), "retrying", "completed", 2),
        (2, 3, us(1), "new", "retrying", 1), (2, None, us(3), "retrying", "queued", 1),
    ], key=str)


def test_rows_in_any_batch_are_put_in_order(run, spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(60), k, rng.choice(["queued", "failed", "completed", "processing"])) for k in range(120)]
    rows.sort(key=lambda r: r[1] + rng.random() * 8)
    batches = [rows[:40], rows[40:80], rows[80:], [(0, 500, 1000, "queued")]]
    got = run(batches, "state string", timers.TaskTimers(), TASK_OUT)
    given = spark.createDataFrame([(r[0], at(r[1]), r[2], r[3]) for r in rows], "user_id long, ts timestamp, event_id long, event_type string")
    kinds = F.create_map(*map(F.lit, ("queued", "signup", "failed", "error", "completed", "purchase", "processing", "view")))
    want = tasks.with_retries(tasks.task_states(given.withColumn("event_type", kinds[F.col("event_type")])))
    assert got == sorted((tuple(r) for r in want.collect()), key=str)


def test_an_alert_holds_before_it_fires(run):
    batches = [[(1, 0, 1, True), (2, 0, 2, True), (2, 59, 3, False)], [(1, 50, 4, True), (1, 70, 5, False), (2, 65, 6, True)], [(1, 130, 7, False), (2, 125, 8, False), (9, 500, 9, False)]]
    got = run(batches, "bad boolean", timers.HoldAlerts(60), "us long, change string")
    assert got == sorted([(1, us(60), "fired"), (1, us(70), "resolved"), (2, us(125), "fired"), (2, us(125), "resolved")], key=str)


def test_alerts_of_a_table_and_no_rows(spark):
    rows = [(1, at(0), 1, True), (1, at(70), 2, False), (2, at(0), 3, True), (None, at(0), 4, True), (3, at(0), 5, True), (3, at(0), 6, False)]
    df = spark.createDataFrame(rows, ROWS.format("bad boolean"))
    assert sorted((tuple(r) for r in tasks.held(df, 60).collect()), key=str) == sorted(
        [(1, us(60), "fired"), (1, us(70), "resolved"), (2, us(60), "fired"), (None, us(60), "fired")], key=str
    )
    assert tasks.held(df.limit(0), 60).count() == 0


def test_rows_of_a_batch_wait_as_one_value():
    """A stand-in for the engine's state counts what is passed to it; big and missing numbers stay as they are."""

    class Kept(list):
        value = None
        get = lambda self: self.value
        appendValue = list.append
        appendList = list.extend
        exists = lambda self: self.value is not None

        def update(self, value):
            self.value = value

    class Handle:
        lists, values, alarms = Kept(), Kept(), []
        getListState = lambda self, *_: self.lists
        getValueState = lambda self, *_: self.values
        registerTimer = lambda self, ms: self.alarms.append(ms)

    handle, processor = Handle(), timers.TaskTimers()
    processor.init(handle)
    rows = pd.DataFrame({"key": 1, "ts": pd.Timestamp(START), "us": range(5000, 5050), "event_id": range(2**60 + 1, 2**60 + 51), "state": ["queued", None] * 25})
    assert list(processor.handleInputRows((1,), iter([rows]), None)) == []
    assert len(handle.lists) == 1 and len(handle.lists[0][0]) == 50 and handle.alarms == [5]
    assert handle.lists[0][0][:2] == [(5000, 2**60 + 1, "queued"), (5001, 2**60 + 2, None)]
