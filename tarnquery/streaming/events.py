"""Structured Streaming over an event log: windowed counts, process-once, alert state and sessions.

Each function maps a streaming (or batch) DataFrame of events (event_id, ts, user_id, event_type, value) to another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnquery.operators import tasks


def event_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Events from files as they arrive; the schema is that of the files there, event times become instants."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name[:-1]}[{name[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means by window and type; state of windows older than the watermark is dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("since"), "event_type", "n", "mean")


def process_once(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first event of each key. All keys are remembered as state, or with `late` until the watermark passes them."""
    if late is None:
        return events.select(*keys).dropDuplicates(keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys)


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of events of a user without a longer gap."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("since"), "n")


def alert_step(rows: DataFrame, before: DataFrame | None, threshold: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Where alerts of a user fire and resolve in a batch, and which are active after it."""
    states = tasks.alert_states(rows.select("user_id", "event_id", "ts", "value"), before, threshold)
    return tasks.alert_changes(states), tasks.last(states, before, firing=F.col("firing"))


def task_step(rows: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """A batch's changes of tasks, and each task's state and failed attempts after it."""
    states = tasks.task_states(rows, before)
    return tasks.task_changes(states), tasks.last(states, before, state=F.col("state"), attempts=F.col("attempts"))


def fold_to_table(stream: DataFrame, path: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Runs a stream whose rows depend on those before them over what is there now; returns the table of results.

    step(rows, before) gives a batch's result and the state after it; `before` is the state after the batch before, or
    None. Both are written into folders of the batch's own, so that a repeated batch replaces itself. A batch's rows
    are put in order by windows, which spill, so no user's rows are held in memory at once; batches follow each other
    in order of arrival. The state is written anew by each batch: a row for each key seen so far.
    """
    spark = stream.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        before = rows.sparkSession.read.parquet(f"{path}/state/batch={batch - 1}") if batch else None
        rows = rows.persist()
        result, state = step(rows, before)
        result.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
        state.write.mode("overwrite").parquet(f"{path}/state/batch={batch}")
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    schema = step(spark.createDataFrame([], stream.schema), None)[0].schema
    return spark.read.schema(schema).parquet(f"{path}/data/batch=*")


def run_to_table(stream: DataFrame, path: str, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is there now, writing to path with a checkpoint beside it; returns the table.

    In append mode rows are final. In update mode each batch writes what changed into a folder of its own, so that a
    repeated batch replaces itself, and the table holds the last version of each of `keys`.
    """
    spark, schema = stream.sparkSession, stream.schema
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{path}/data").outputMode("append")
    else:
        put = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
        writer = stream.writeStream.outputMode("update").foreachBatch(put)
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{path}/data")
    rows = spark.read.schema(StructType([*schema]).add("batch", "long")).parquet(f"{path}/data")
    last = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def deliver(stream: DataFrame, send, checkpoint: str):
    """Hands each batch of alerts to send(rows), such as a mailer or webhook (SNK17); at least once."""
    hand = lambda df, _: send(df.toLocalIterator())
    return stream.writeStream.foreachBatch(hand).option("checkpointLocation", checkpoint).trigger(processingTime="30 seconds").start()
