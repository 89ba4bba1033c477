"""What plans must and must not hold."""

import os

import pytest
from pyspark.sql import functions as F

from tarnquery.operators import similarity
from tarnquery.plans import registry
from tarnquery.sources import files

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@here
def test_top_k_and_pushdown(spark):
    q = registry.queries()
    assert "TakeOrderedAndProject" in plan(q["recent_items"](spark, SF))
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,42)]" in plan(q["item_lookup"](spark, SF))
    scan = plan(q["category_distribution"](spark, SF))
    assert "ReadSchema: struct<source:string>" in scan


@here
def test_native_operators_run_no_python(spark):
    for name in ("clean_text", "key_insights", "rule_category", "url_parse", "pii_counts", "jaccard_similarity", "fts_bm25", "error_stats"):
        assert "Python" not in plan(registry.queries()[name](spark, SF)) and "Pandas" not in plan(registry.queries()[name](spark, SF)), name


def test_similarity_join_finds_what_all_pairs_find(spark):
    import random

    rng = random.Random(1)
    base = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.sample(base, rng.randint(5, 40))), f"c{k % 2}") for k in range(80)] + [(200, "", "c0"), (201, None, "c0"), (202, "  ", "c1")]
    got = {(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame(rows, "id long, text string, cat string"), ["cat"], 0.8).collect()}
    want = set()
    for i, t, c in rows:
        for j, u, d in rows:
            if i < j and c == d and (t or "").strip() and (u or "").strip():
                x, y = set(t.split()), set(u.split())
                if 0.7 * len(x & y) / len(x | y) + 0.3 * min(len(t), len(u)) / max(len(t), len(u)) >= 0.8 - 1e-12:
                    want.add((i, j))
    assert got == want and want


def test_similar_classes_tell_what_all_pairs_tell(spark):
    import random

    rng = random.Random(2)
    base = [f"w{k}" for k in range(9)]
    texts = [" ".join(rng.sample(base, rng.randint(5, 9))) for _ in range(25)]
    rows = [(k, texts[min(k % 40, 24)], f"c{k % 2}") for k in range(90)]
    rows += [(200, "", "c0"), (201, None, "c0"), (202, "alone here", "c1"), (203, texts[0], None), (204, texts[0], None)]
    items = spark.createDataFrame(rows, "id long, text string, cat string")
    pairs = {(r.a, r.b): r.score for r in similarity.similar_pairs(items, ["cat"]).collect()}
    partners = {i: sorted([(-round(s, 9), b if a == i else a) for (a, b), s in pairs.items() if i in (a, b)]) for i, _, _ in rows}
    members, found = similarity.similar_classes(items, ["cat"])
    text = {i: (sorted(set((t or "").split())), len(t or ""), c) for i, t, c in rows}
    links = {r["id"]: r for r in similarity.link_counts(members, found).collect()}
    assert set(links) == {i for i, (w, _, c) in text.items() if w and c}
    for i, r in links.items():
        assert r["class"] == min(j for j in links if text[j] == text[i]) and r.links == len(partners[i])
    top = sorted(map(tuple, similarity.top_related(members, found.withColumn("score", F.round("score", 9)), 3).collect()))
    assert top == sorted((i, b, -s, n + 1) for i, near in partners.items() for n, (s, b) in enumerate(near[:3]))
    stats = similarity.link_stats(members, found).first()
    assert stats.n == len(pairs) and abs(stats["mean"] - sum(pairs.values()) / len(pairs)) < 1e-9 and stats.most == max(pairs.values())
    assert found.count() < len(pairs) / 2
    none = similarity.link_stats(*similarity.similar_classes(items.limit(0), ["cat"])).first()
    assert none.n == 0 and none["mean"] is None


def test_upsert_and_snapshot(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seen int, v string")
    new = spark.createDataFrame([(2, 5, "c"), (2, 6, "d"), (3, 7, "e")], "k int, seen int, v string")
    got = files.upsert(old, new, ["k"], F.col("seen"), {"seen": F.min("seen")})
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a"), (2, 1, "d"), (3, 7, "e")]
    files.snapshot({"t": old}, f"file://{tmp_path}/s", "2024-01-01")
    assert files.restore(spark, f"file://{tmp_path}/s")["t"].count() == 2


def test_json_stores(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"items": [{"id": "1", "topic": "t", "category": null, "extraction_date": "2024-01-02T03:04:05"}, {"id": "2", "course_references": ["a", "b"]}]}')
    (tmp_path / "bad.json").write_text("{not json")
    got = {r.id: r for r in files.read_repository(spark, f"file://{tmp_path}/r.json").collect()}
    assert got["1"].category == "Other" and str(got["1"].extraction_date) == "2024-01-02 03:04:05" and got["1"].course_references == [] and got["2"].course_references == ["a", "b"]
    assert files.read_repository(spark, f"file://{tmp_path}/bad.json").count() == 0
    (tmp_path / "q.json").write_text('{"tasks": {"a": {"id": "a", "url": "u", "retry_count": 1}, "b": {"id": "b"}}}')
    ok, broken = files.read_queue(spark, f"file://{tmp_path}/q.json")
    assert [r.id for r in ok.collect()] == ["a"] and [r.key for r in broken.collect()] == ["b"]
    (tmp_path / "e.json").write_text('{"error_records": {"x": {"id": "x", "error_type": "APIError", "recovery_attempted": true}}}')
    assert files.read_errors(spark, f"file://{tmp_path}/e.json").first().error_type == "APIError"
    (tmp_path / "urls.txt").write_text(" http://a \n\n\thttp://b\n")
    assert [r.url for r in files.read_urls(spark, f"file://{tmp_path}/urls.txt").collect()] == ["http://a", "http://b"]


def test_folded_streams_give_what_whole_tables_give(spark, tmp_path):
    import random

    from tarnquery.streaming import events as E

    rng = random.Random(3)
    kinds = ["signup", "purchase", "error", "click"]
    rows = [(k, k // 2, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(kinds), rng.choice([None, 10.0, 19.9, 20.0, 30.0])) for k in range(90)]
    frame = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double")
    for k in range(3):
        part = frame.where(F.floor(F.col("event_id") / 30) == k).coalesce(1)
        part.write.mode("append").parquet(f"file://{tmp_path}/in")
        for f in (tmp_path / "in").glob("*.parquet"):
            if f.stat().st_mtime > 2_000_000:
                os.utime(f, (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for name, step in (("alerts", E.alert_step), ("tasks", E.task_step)):
        got = E.fold_to_table(stream, f"file://{tmp_path}/{name}", step)
        assert len(list((tmp_path / name / "data").glob("batch=*"))) == 3
        want = step(frame, None)[0]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 0
