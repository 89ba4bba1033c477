"""Tables in the shared folder that cut lineage, and joins that broadcast only what is proven small."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnquery.sources.shared import new_folder

#: Rows up to which a table of ids or keys is small enough to be sent to every executor.
BROADCAST_ROWS = 500_000


#: Bytes of an Arrow batch between the JVM and Python: a batch of long texts is held several times over in a task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a bound of its own below Spark's default of 64 MB."""
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps don't repeat its work if an executor is lost."""
    bound_batches(df.sparkSession)
    path = new_folder(df.sparkSession, tag)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with right sent to all executors if it is proven small, else by a shuffled join that splits hot keys."""
    return left.join(F.broadcast(right) if small(right, limit) else right, on, how)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    bound_batches(docs.sparkSession)
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def parts_for(n_bytes: int, each: int) -> int:
    return max(1, math.ceil(n_bytes / each))
