"""Running windows over few keys: places by prefix sums over ranges, and frames over blocks of places.

A window over a handful of keys puts a key's rows into one task each. Here rows are cut into ranges of key and order,
numbered within their range, and moved on by the rows of the key in the ranges before; frames that look back over a
fixed number of rows are worked out by blocks of places, each with the last rows of the block before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnquery.sources.shared import new_folder

#: Rows of a block.
BLOCK = 100_000


def places(rows: DataFrame, by: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """rows with their place among those of equal `by`, from 1 on. The order should be total, or places of equal rows
    depend on the run; null keys are a key. Columns named part, place and before are replaced.

    Ranges are written, so that a lost executor can't cut them anew. A row count by range and key is all that is summed
    over the ranges.
    """
    spark, by = rows.sparkSession, list(by)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(spark, "ranges")
    cut = rows.drop("part", "place", "before").repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id())
    schema = cut.schema
    cut.write.parquet(path)
    cut = spark.read.schema(schema).parquet(path)
    inside = cut.withColumn("place", F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)))
    sizes = cut.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(Window.partitionBy(*by).orderBy("part")) - F.col("n")).alias("before")
    before = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("part").alias("_part"), before)
    same = F.col("part") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = inside.join(before, same)
    return met.withColumn("place", (F.col("place") + F.col("before")).cast("long")).drop("part", "before", "_part", *[f"_{c}" for c in by])


def looking_back(placed: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Rows with a `block`, and again, not `own`, in the next block if they are among the last n of theirs: a frame of up
    to n rows before the current one lies within a block. Take the frame by key and block, ordered by place, then the rows
    that are own."""
    if not 0 <= n <= block:
        raise ValueError("a frame must not be longer than a block")
    at = F.floor((F.col("place") - 1) / block)
    both = F.array(F.struct(at.alias("block"), F.lit(True).alias("own")), F.struct((at + 1).alias("block"), F.lit(False).alias("own")))
    late = (F.col("place") - 1) % block >= block - n
    return placed.withColumn("b", F.explode(F.when(late, both).otherwise(F.slice(both, 1, 1)))).select("*", "b.*").drop("b")
