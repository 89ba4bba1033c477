"""Streams whose state changes by itself: rows of a key in order of event time, and timers between them.

Rows wait in the state until the watermark has passed them, so late rows are put in order whatever batch they come in; a
key's state is read and written when it has something due, never rewritten as a whole table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


def _plain(values: pd.Series) -> list:
    """Python values, with None for what is missing."""
    missing = values.isna().to_numpy()
    return [None if gone else v for v, gone in zip(values.tolist(), missing)] if missing.any() else values.tolist()


class Timed(StatefulProcessor):
    """Rows (us, event_id, *fields) of a key as event time goes on.

    A subclass says what state it keeps, what a row and what a timer does to it. Times are microseconds; a due timer goes
    before a row of the same time. A key has one timer of the engine: the first time that a row or its own timer is due.
    """

    #: Types of the fields of a row and of the state, whose first field `due` is the next timer or null.
    fields: str
    state: str
    start: tuple
    columns: tuple[str, ...]

    def on_row(self, state: list, us: int, event_id: int, *fields) -> Iterable[tuple]:
        raise NotImplementedError

    def on_timer(self, state: list, us: int) -> Iterable[tuple]:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        # the rows that a key gets at once are one value: values are passed to the state one by one
        self.waiting = handle.getListState("waiting", f"rows array<struct<us long, event_id long, {self.fields}>>")
        self.known = handle.getValueState("known", f"alarm long, due long, {self.state}")

    def _load(self) -> list:
        known = self.known.get()
        return [None, *self.start] if known is None else list(known)

    def _wake(self, known: list, us: int | None) -> None:
        """Sets the key's timer to this time, if it has none before."""
        ms = None if us is None else -(-us // 1000)
        if ms is not None and (known[0] is None or ms < known[0]):
            if known[0] is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(ms)
            known[0] = ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, first = self._load(), None
        for some in rows:
            values = [_plain(some[c]) for c in some.columns if c not in ("ts", "key")]
            self.waiting.appendValue((list(zip(*values)),))
            least = int(some["us"].min())
            first = least if first is None else min(first, least)
        self._wake(known, first)
        self.known.update(tuple(known))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, known = timerValues.getCurrentWatermarkInMs() * 1000, self._load()
        rows = sorted(tuple(r) for (some,) in self.waiting.get() for r in some)
        ready = [r for r in rows if r[0] <= until]
        state, out = known[1:], []
        for row in [*ready, None]:
            at = until if row is None else row[0]
            while state[0] is not None and state[0] <= at:
                out += self.on_timer(state, state[0])
            if row is not None:
                out += self.on_row(state, *row)
        left, known = rows[len(ready) :], [None, *state]
        if left:
            self.waiting.put([(left,)])
        else:
            self.waiting.clear()
        self._wake(known, min([x for x in (state[0], left[0][0] if left else None) if x is not None], default=None))
        self.known.update(tuple(known))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.columns], dtype=object)

    def close(self) -> None:
        pass


@dataclass
class TaskTimers(Timed):
    """Tasks through their states. A failed task waits for its delay, then is queued again by itself, unless an event of
    it comes before; after `tries` failures it stays failed."""

    tries: int = 3
    longest: int = 60
    fields = "state string"
    state = "task string, attempts long"
    start = (None, "new", 0)
    columns = ("event_id", "us", "from_state", "to_state", "attempts")

    def on_row(self, state, us, event_id, kind):
        was = state[1]
        state[2] += kind == "failed"
        again = kind == "failed" and state[2] <= self.tries
        state[0] = us + min(2 ** state[2], self.longest) * SECOND if again else None
        state[1] = "retrying" if again else kind
        yield event_id, us, was, state[1], state[2]

    def on_timer(self, state, us):
        state[0], state[1] = None, "queued"
        yield None, us, "retrying", "queued", state[2]


@dataclass
class HoldAlerts(Timed):
    """An alert that fires once its condition has held for `hold` seconds, and is resolved by the first reading that
    breaks it. A reading counts until the next."""

    hold: int = 900
    fields = "bad boolean"
    state = "pending boolean, firing boolean"
    start = (None, False, False)
    columns = ("us", "change")

    def on_row(self, state, us, event_id, bad):
        if bad and not state[1]:
            state[0], state[1] = us + self.hold * SECOND, True
        elif not bad:
            if state[2]:
                yield us, "resolved"
            state[:] = [None, False, False]

    def on_timer(self, state, us):
        state[0], state[2] = None, True
        yield us, "fired"


@contextmanager
def timers_kept(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in a store that knows timers."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def timed(rows: DataFrame, processor: Timed, out: str, late: str = "1 hour") -> DataFrame:
    """What processor gives out for a stream of rows (key, ts, event_id, *fields), of what the watermark has passed.

    Rows later than the watermark when they come are dropped by it. A key's rows that wait, those of the last `late` and
    of a batch, are held in one task; null event times never become due. Null keys are one key.
    """
    names = [c for c in rows.columns if c not in ("key", "ts", "event_id")]
    given = rows.where(F.col("ts").isNotNull()).withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), "event_id", *names)
    return given.groupBy("key").transformWithStateInPandas(processor, f"key long, {out}", "Append", "EventTime")
