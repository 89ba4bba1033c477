"""Histograms of fixed buckets: counts that add up over tasks, times and sources, and quantiles out of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_counts(rows: DataFrame, by: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """(by, counts): of each key how many values fall in each bucket, the open one last. A value on a bound belongs below
    it. Null and NaN values count nowhere. A group's state is a number a bucket."""
    given = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    lower = [None, *bounds]
    upper = [*bounds, None]

    def inside(low, high):
        test = F.lit(True)
        if low is not None:
            test = test & (given > low)
        if high is not None:
            test = test & (given <= high)
        return test & given.isNotNull()

    counts = F.array(*[F.count_if(inside(low, high)) for low, high in zip(lower, upper)])
    return rows.groupBy(by).agg(counts.alias("counts"))


def merged(counts: DataFrame, by: str) -> DataFrame:
    """Counts of equal keys from several sources as one."""
    cells = counts.select(F.col(by).alias("key"), F.posexplode("counts").alias("at", "n")).groupBy("key", "at").agg(F.sum("n").alias("n"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda c: c["n"])
    return cells.groupBy("key").agg(whole.alias("counts")).withColumnRenamed("key", by)


def quantile(counts: DataFrame, by: str, bounds: Sequence[float], share: float) -> DataFrame:
    """(by, n, at): the value below which a share of the values lies, on a straight line within the bucket that holds it,
    from 0 on in the first. In the open bucket it is the last bound; keys without values are left out."""
    c = F.col("counts")
    upto = F.transform(F.sequence(F.lit(1), F.lit(len(bounds) + 1)), lambda k: F.aggregate(F.slice(c, F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    rows = counts.select(F.col(by).alias("key"), "counts", upto.alias("upto")).withColumn("n", F.element_at("upto", -1)).where("n > 0")
    rank = F.lit(share) * F.col("n").cast("double")
    rows = rows.withColumn("k", F.size(F.filter("upto", lambda u: u < rank)))
    edges = F.array(*[F.lit(float(b)) for b in (0.0, *bounds)])
    low, high, own = F.get(edges, F.col("k")), F.get(edges, F.col("k") + 1), F.get(c, F.col("k"))
    below = F.get(F.col("upto"), F.col("k")) - own
    at = F.when((F.col("k") >= len(bounds)) | (own == 0), low).otherwise(low + (high - low) * ((rank - below) / own))
    return rows.select(F.col("key").alias(by), "n", at.alias("at"))


def histogram_quantile(rows: DataFrame, by: str, value: str, bounds: Sequence[float], share: float) -> DataFrame:
    return quantile(bucket_counts(rows, by, value, bounds), by, bounds, share)
