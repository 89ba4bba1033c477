"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnquery.llm.session import written


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40)))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node with an edge reaches; nodes without edges aren't listed.

    Every step is a grouped minimum and a join; no group is ever collected, so a node with many edges is harmless.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    e = written(edges.where(F.col(a) != F.col(b)).select(*pair(F.col(a), F.col(b))).distinct(), "edges")
    now = _sum(e)
    while now[0]:
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("x")).union(e.select("lo", "hi"))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where("x > n").select(F.col("x").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", "m"))
        e = written(small.distinct(), "edges")
        was, now = now, _sum(e)
        if was == now:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
