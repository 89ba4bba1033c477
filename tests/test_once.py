"""Work that grows with the input is done once for each text."""

import pytest
from pyspark.sql import functions as F

from tarnquery.functions import classify as C
from tarnquery.functions import pii as P
from tarnquery.functions import text as T
from tarnquery.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_sought_once(spark):
    plan = plan_of(spark.createDataFrame([("Ab Cd",)], "t string").select(P.matches(F.col("t")).alias("m")))
    assert plan.count("regexp_extract_all(") == len(P.PATTERNS) + 2  # and the two kinds of hints


@pytest.mark.parametrize("text", ["Ab Cd Ef Gh", "call Ab Cd", "Ab Cd 123456789 x@y.org", "", "1:2", "éAb Cd Efé Gh Ij"])
def test_guards_lose_no_match(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(P.matches(F.col("t")).alias("m")).first().m
    got = [(m.kind, m.text, m.start, m.end, round(m.confidence, 6)) for m in found]
    want = {
        "Ab Cd Ef Gh": [("person_name", "Ab Cd", 0, 5, 0.32), ("person_name", "Ef Gh", 6, 11, 0.32)],
        "call Ab Cd": [("person_name", "call Ab", 0, 7, 0.384)],
        "Ab Cd 123456789 x@y.org": [("person_name", "Ab Cd", 0, 5, 0.32), ("phone", "123456789", 6, 15, 0.6), ("email", "x@y.org", 16, 23, 0.9)],
        "éAb Cd Efé Gh Ij": [("person_name", "Gh Ij", 11, 16, 0.32)],
    }.get(text, [])
    assert got == want


def test_similar_pairs_of_different_texts_in_a_class_are_told(spark, tmp_path):
    rows = [(1, "a b c d", "s", "l"), (2, "d c b a", "s", "l"), (3, "a b c d", "s", "l"), (4, "a b c d", None, "l"), (5, "", "s", "l"), (6, "x y", "s", "l")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = registry.queries()["jaccard_similarity"](spark, f"file://{tmp_path}").collect()
    assert sorted(tuple(r) for r in got) == [
        ("member", 1, 1, 3, 3, 1.0), ("member", 1, 2, 3, 3, 1.0), ("member", 1, 3, 3, 3, 1.0), ("member", 4, 4, 1, 1, 0.0), ("member", 5, 5, 1, 1, 0.0), ("member", 6, 6, 1, 1, 1.0),
    ]


def test_nothing_is_sought_behind_the_last_word_of_a_pattern(spark):
    texts = ["a nice  course and later", "see courses. one\nmore training course, x", "no word", "", "my course certified course tail", "certified"]
    backward = [p for p in T.COURSES_WIDE if p.startswith("([^")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in backward:
        every = lambda c: F.regexp_extract_all(c, F.lit(p), 1)  # noqa: E731, B023
        got = rows.select("t", T.up_to_last(F.col("t"), p).alias("cut")).select("t", "cut", every(F.col("t")).alias("whole"), every(F.col("cut")).alias("part")).collect()
        assert [r.whole for r in got] == [r.part for r in got] and got[2].cut == "" and got[0].cut in ("", "a nice  course")


def test_words_are_counted_once_for_all_classes(spark):
    rows = spark.createDataFrame([("the thing and",)], "t string").select(C.weighted_class(F.col("t"), C.SYLLABLES)["category"].alias("c"))
    assert plan_of(rows).count("split(") == 1 and rows.first().c == "north"


def test_insights_are_found_once_for_a_summary(spark):
    rows = spark.createDataFrame([("x",), (None,), ("A key thing that is long enough. No.",)], "t string").select(T.summary(F.col("t")).alias("s"))
    assert plan_of(rows).count("split(") == 1
    assert [r.s for r in rows.collect()] == ["x", None, "A key thing that is long enough"]
