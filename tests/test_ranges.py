"""Places and frames over ranges, and histogram quantiles, against plain loops."""

import bisect
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnquery.operators import histograms as H
from tarnquery.operators.ranges import looking_back, places


@pytest.mark.parametrize("keys", [[1], [1, 2, 3, None]])
def test_places_of_one_key_and_of_few(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice(keys), rng.randrange(50), k, "clash") for k in range(2000)]
    df = spark.createDataFrame(rows, "key int, t int, id int, part string").repartition(7)
    placed = places(df, ["key"], [F.desc("t"), F.col("id")], parts=9)
    got = {r.id: r.place for r in placed.collect()}
    for key in keys:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    # no task of the numbering holds more than its range
    sizes = placed.withColumn("task", F.floor((F.col("place") - 1) / 300)).groupBy("key", "task").count()
    assert sizes.agg(F.max("count")).first()[0] <= 300


@pytest.mark.parametrize("block", [5, 7, 100, 3000])
def test_frames_that_look_back(spark, block):
    df = spark.range(1, 1001).select(F.lit(1).alias("key"), (F.col("id") * 37 % 1009).alias("v"), F.col("id").alias("place"))
    rows = looking_back(df, 4, block)
    w = Window.partitionBy("key", "block").orderBy("place").rowsBetween(-4, 0)
    got = rows.withColumn("s", F.sum("v").over(w)).where("own").orderBy("place").collect()
    v = [k * 37 % 1009 for k in range(1, 1001)]
    assert [r.s for r in got] == [sum(v[max(0, k - 4) : k + 1]) for k in range(1000)]
    with pytest.raises(ValueError):
        looking_back(df, 10, 5)


def test_no_rows(spark):
    none = spark.createDataFrame([], "key int, t int")
    assert places(none, ["key"], [F.col("t")]).count() == 0
    assert H.histogram_quantile(none, "key", "t", (1, 2), 0.5).count() == 0


def test_quantiles_of_buckets(spark):
    rng = random.Random(2)
    bounds = (1, 2, 5, 10)
    rows = [(k % 3, rng.choice([0.5, 1.0, 1.5, 2.0, 4.0, 9.0, 30.0])) for k in range(600)] + [(4, None), (5, 99.0), (6, float("nan"))]
    df = spark.createDataFrame(rows, "k int, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        want = {}
        for key in {r[0] for r in rows}:
            values = [v for k, v in rows if k == key and v is not None and v == v]
            counts = [0] * 5
            for v in values:
                counts[bisect.bisect_left(bounds, v)] += 1
            seen, rank = 0, share * len(values)
            for b, n in enumerate(counts):
                if values and seen + n >= rank:
                    low = (0, *bounds)[b]
                    want[key] = low if b == 4 else low + (bounds[b] - low) * ((rank - seen) / n if n else 0)
                    break
                seen += n
        got = {r.k: r["at"] for r in H.histogram_quantile(df, "k", "v", bounds, share).collect()}
        if share:
            assert got == pytest.approx(want)
    halves = H.bucket_counts(df.where("v < 3"), "k", "v", bounds).unionByName(H.bucket_counts(df.where("v >= 3"), "k", "v", bounds))
    whole = {r.k: r.counts for r in H.bucket_counts(df, "k", "v", bounds).collect() if sum(r.counts)}
    assert {r.k: r.counts for r in H.merged(halves, "k").collect() if sum(r.counts)} == whole
