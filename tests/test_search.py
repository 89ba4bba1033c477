"""The search index against plain loops over all items."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnquery.operators import search
from tarnquery.sources.shared import new_folder


@pytest.fixture(scope="module")
def items():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)] + ["w1"] * 20 + ["a", "É", "x-y"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    return [*rows, (1000, None), (1001, ""), (1002, "w1 w2 " * 3000), (1003, "w1 w2"), (1004, "w1 w2")]


@pytest.fixture(scope="module", params=[4096, 10])
def built(spark, items, request):
    before, search.BLOCK, search.FIRST = (search.BLOCK, search.FIRST), request.param, 3
    index = search.SearchIndex.build(spark.createDataFrame(items, "id long, text string").repartition(3), new_folder(spark, "index"))
    yield index
    search.BLOCK, search.FIRST = before


def tokens(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


@pytest.mark.parametrize("words,n", [(["w1"], 5), (["W1", "w2"], 50), (["w1", "w2", "w3"], 500), (["w1", "nowhere"], 5), ([], 5)])
def test_best_items(built, items, words, n):
    t = {k: Counter(tokens(x)) for k, x in items}
    mean = sum(sum(c.values()) for c in t.values()) / len(t)
    want = []
    asked = {w.lower() for w in words}
    for k, c in t.items():
        if asked and all(c[w] for w in asked):
            score = 0.0
            for w in asked:
                df = sum(1 for x in t.values() if x[w])
                score += math.log((len(t) - df + 0.5) / (df + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            want.append((k, score))
    want = sorted(want, key=lambda r: (-round(r[1], 9), r[0]))[:n]
    got = built.top(words, n).collect()
    assert [r.id for r in got] == [k for k, _ in want] and [r.score for r in got] == pytest.approx([s for _, s in want])


def test_phrases_and_prefixes(built, items):
    for words in (["w1", "w2"], ["w1", "w1", "w1"], ["w5"], ["w5", "nowhere"]):
        want = {}
        for k, x in items:
            t = tokens(x)
            n = sum(t[i : i + len(words)] == words for i in range(len(t)))
            if n:
                want[k] = n
        assert {r.id: r.n for r in built.phrase(words).collect()} == want
    for start in ("w", "w1", "w12", "A", "zz"):
        df = Counter(w for _, x in items for w in set(tokens(x)) if w.startswith(start.lower()))
        assert {r.term: r.df for r in built.prefix(start).collect()} == dict(df)


def test_only_its_folders_are_read(built):
    plan = built._of(built.postings, ["w1"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "w1" in plan and "PushedFilters: [IsNotNull(term)" in plan.replace("In(term", "IsNotNull(term")


def test_nothing_to_index(spark):
    index = search.SearchIndex.build(spark.createDataFrame([], "id string, text string"), new_folder(spark, "index"))
    assert index.top(["a"]).count() == index.phrase(["a"]).count() == index.prefix("a").count() == 0


def test_texts_are_read_twice_at_most(spark):
    """Once to find ranges of terms and once to deal the postings out, not for the mean length too."""
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([(k, f"w{k} w1 w1") for k in range(50)], "id long, text string")
    index = search.SearchIndex.build(rows.select("id", F.udf(told, "string")("text").alias("text")), new_folder(spark, "index"))
    assert index.stats["docs"] == 50 and index.stats["mean"] == 3.0 and seen.value <= 100
