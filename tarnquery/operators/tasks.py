"""Alerts and tasks whose next state depends on the one before: as windows over a table, or over a batch and a state.

`before` is what `last` returned for all rows that came earlier: one row for each key, or None for none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A user's rows in order; ties go by id.
ORDER = ("ts", "event_id")


def _with(rows: DataFrame, before: DataFrame | None, kinds: dict[str, str]) -> DataFrame:
    """Rows beside the columns of their user's state."""
    if before is None:
        return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    known = before.select(F.col("user_id").alias("whose"), *kinds)
    return rows.join(known, F.col("user_id").eqNullSafe(F.col("whose")), "left").drop("whose")


def last(rows: DataFrame, before: DataFrame | None, **state: Column) -> DataFrame:
    """The state after rows: of each user the given columns in the last row, or as they were before."""
    made = F.struct(*[c.alias(n) for n, c in state.items()])
    new = rows.groupBy("user_id").agg(F.max_by(made, F.struct(*ORDER)).alias("s"))
    if before is not None:
        both = new.withColumn("late", F.lit(True)).union(before.select("user_id", F.struct(*state).alias("s"), F.lit(False)))
        new = both.groupBy("user_id").agg(F.max_by("s", "late").alias("s"))
    return new.select("user_id", "s.*")


def alert_states(rows: DataFrame, before: DataFrame | None, threshold: float) -> DataFrame:
    """Rows (user_id, event_id, ts, value) with `firing`, and `was` for the row before. A null value doesn't fire."""
    firing = F.coalesce(F.col("value") >= threshold, F.lit(False))
    rows = _with(rows.withColumn("firing", firing), before if before is None else before.withColumnRenamed("firing", "fired"), {"fired": "boolean"})
    was = F.lag("firing").over(Window.partitionBy("user_id").orderBy(*ORDER))
    return rows.withColumn("was", F.coalesce(was, "fired", F.lit(False)))


def alert_changes(states: DataFrame) -> DataFrame:
    """Where alerts fire and resolve."""
    change = F.when(F.col("firing"), "fired").otherwise("resolved").alias("change")
    return states.where("firing <> was").select("user_id", "event_id", change)


def state_of(kind: Column) -> Column:
    return F.when(kind == "signup", "queued").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("processing")


def task_states(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Rows (user_id, event_id, ts, event_type) with the `state` that an event puts its user's task in, the state
    `was` and how many `attempts` have failed so far."""
    rows = rows.select("event_id", "user_id", "ts", state_of(F.col("event_type")).alias("state"))
    if before is not None:
        before = before.select("user_id", F.col("state").alias("known"), F.col("attempts").alias("failed"))
    rows = _with(rows, before, {"known": "string", "failed": "long"})
    u = Window.partitionBy("user_id").orderBy(*ORDER)
    failures = F.sum((F.col("state") == "failed").cast("long")).over(u.rowsBetween(Window.unboundedPreceding, 0))
    was = F.coalesce(F.lag("state").over(u), "known", F.lit("new"))
    return rows.withColumns({"was": was, "attempts": failures + F.coalesce("failed", F.lit(0))}).drop("known", "failed")


def task_changes(states: DataFrame, tries: int = 3, longest: int = 60) -> DataFrame:
    """Changes of state: failures are retried after a growing delay while tries last, and a completed task only
    queues again; other changes of one aren't allowed."""
    again = (F.col("state") == "failed") & (F.col("attempts") <= tries)
    delay = F.least(F.pow(F.lit(2), "attempts").cast("long"), F.lit(longest).cast("long"))
    return states.select(
        "event_id", "user_id", F.col("was").alias("from_state"), F.when(again, "retrying").otherwise(F.col("state")).alias("to_state"),
        "attempts", F.when(again, delay).alias("retry_after_s"), ((F.col("was") != "completed") | (F.col("state") == "queued")).alias("allowed"),
    )


def with_retries(states: DataFrame, tries: int = 3, longest: int = 60) -> DataFrame:
    """Changes (user_id, event_id, us, from_state, to_state, attempts) with those that no event makes: a failed task is
    queued again once its delay is over, if no event of it came before; a retry goes before an event of the same time."""
    by = Window.partitionBy("user_id").orderBy(*ORDER)
    again = (F.col("state") == "failed") & (F.col("attempts") <= tries)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    delay = F.least(F.pow(F.lit(2), "attempts").cast("long"), F.lit(longest).cast("long")) * 1_000_000
    timed = states.withColumns({"us": us, "next": F.lead(us).over(by), "due": F.when(again, us + delay)})
    comes = F.col("due").isNotNull() & F.coalesce(F.col("next") >= F.col("due"), F.lit(True))
    own = F.struct(F.col("event_id"), F.col("us"), F.when(again, "retrying").otherwise(F.col("state")).alias("to_state"), F.lit(1).alias("k"))
    back = F.struct(F.lit(None).cast("long").alias("event_id"), F.col("due").alias("us"), F.lit("queued").alias("to_state"), F.lit(0).alias("k"))
    rows = timed.select("user_id", "attempts", F.explode(F.when(comes, F.array(own, back)).otherwise(F.array(own))).alias("c"))
    rows = rows.select("user_id", "attempts", "c.*")
    was = F.lag("to_state").over(Window.partitionBy("user_id").orderBy("us", "k", "event_id"))
    return rows.withColumn("from_state", F.coalesce(was, F.lit("new"))).select("user_id", "event_id", "us", "from_state", "to_state", "attempts")


def held(readings: DataFrame, hold: int) -> DataFrame:
    """(key, us, change) of readings (key, ts, event_id, bad): where an alert fires as readings have been bad for `hold`
    seconds, and where the first one that isn't resolves it."""
    by = Window.partitionBy("key").orderBy(*ORDER)
    rows = readings.select("key", *ORDER, "bad", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    turns = rows.withColumn("was", F.coalesce(F.lag("bad").over(by), F.lit(False))).where("bad <> was")
    fires = F.col("us") + hold * 1_000_000
    runs = turns.withColumn("broke", F.lead("us").over(by)).where(F.col("bad") & F.coalesce(F.col("broke") >= fires, F.lit(True)))
    change = lambda us, name: F.struct(us.alias("us"), F.lit(name).alias("change"))
    both = F.array(change(fires, "fired"), change(F.col("broke"), "resolved"))
    return runs.select("key", F.explode(both).alias("c")).select("key", "c.*").where("us IS NOT NULL")
