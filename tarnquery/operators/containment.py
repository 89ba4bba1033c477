"""Containment join: which short texts are parts of which others, through an index of their q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
Q = 3


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def contained(parts: DataFrame, wholes: DataFrame, by: str, part: str = "part", whole: str = "whole") -> DataFrame:
    """(by, part, whole): of equal `by`, the different texts `part` that are within the different texts `whole`.

    A part is looked up by the one of its grams that the fewest wholes have, a shorter one by itself, an empty one by the
    empty gram that all wholes have; hits are then tested. Nulls contain nothing and are in nothing, null keys meet nothing.
    """
    inner = parts.select(by, F.col(part).alias("part")).where(F.col("part").isNotNull()).distinct()
    outer = wholes.select(by, F.col(whole).alias("whole")).where(F.col("whole").isNotNull()).distinct()
    every = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("whole"), k) for k in range(1, Q + 1)]))
    index = outer.select(by, "whole", F.explode(every).alias("gram"))
    counts = index.groupBy(by, "gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("part") >= Q, F.array_distinct(_grams(F.col("part"), Q))).otherwise(F.array("part"))
    # a gram that no whole has rules its part out; the rest of a part's grams needn't be looked up
    sought = inner.select(by, "part", F.size(own).alias("grams"), F.explode(own).alias("gram")).join(counts, [by, "gram"])
    rarest = sought.groupBy(by, "part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("met"), F.first("grams").alias("grams"))
    met = rarest.where("met = grams").select(by, "part", "gram").join(index, [by, "gram"])
    return met.where(F.contains("whole", "part")).select(by, F.col("part").alias(part), F.col("whole").alias(whole))
