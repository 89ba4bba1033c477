"""JSON columns, queue files as a stream, and the rules of records, on odd rows."""

import json
import time

from pyspark.sql import functions as F

from tarnquery.functions import jsons as J
from tarnquery.plans import records
from tarnquery.sources import queues
from tarnquery.streaming import events as E


def test_values_of_json(spark):
    rows = ['{"a": {"b": 3}, "s": "x"}', '{"a": {"b": "4"}}', '{"a": [1]}', "[1, 2]", "null", "{broken", "", None, '{"a": {"b": 1e300}}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").withColumn("v", J.parsed(F.col("t")))
    got = df.orderBy("k").select(J.field(F.col("v"), "$.a.b", "int", 0).alias("b"), J.field(F.col("v"), "$.s", "string").alias("s"), J.items(F.col("v"), "int").alias("i")).collect()
    assert [r.b for r in got] == [3, 4, 0, 0, 0, 0, 0, 0, 0]
    assert [r.s for r in got] == ["x", *[None] * 8]
    assert [r.i for r in got] == [[], [], [], [1, 2], *[[]] * 5]


def test_tasks_of_odd_files():
    said = lambda text: [(r[1], r[2], r[3], r[4], r[5], r[6]) for r in queues.tasks_of("f", text)]
    assert said(json.dumps({"tasks": {"1": {"id": "a", "url": "u", "priority": 2, "retry_count": 1, "status": "failed"}}})) == [("a", "u", "failed", 2, 1, None)]
    assert said(json.dumps({"tasks": {"1": {"url": "u"}, "2": {"id": 7}, "3": [], "4": {"id": "x", "url": "u", "priority": "high"}}})) == [
        ("1", "u", "queued", 0, 0, "no id"), ("7", None, "queued", 0, 0, "no url"), ("3", None, None, None, None, "no task"), ("x", "u", "queued", 0, 0, None),
    ]
    for text in ("", "[]", "{}", '{"tasks": 3}', "nul", '{"tasks": {}'):
        assert [r[5] is not None for r in said(text)] == [True]
    assert said('{"tasks": {}}') == []


def test_each_file_is_read_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "queue"
    folder.mkdir()

    def put(name, *ids):
        (folder / name).write_text(json.dumps({"tasks": {i: {"id": i, "url": f"u{i}"} for i in ids}}))
        time.sleep(0.02)

    def run():
        rows = E.run_to_table(queues.queue_stream(spark, f"file://{folder}"), f"file://{tmp_path}/out", "append").collect()
        return sorted((r.file, r.id) for r in rows)

    put("b.json", "1", "2")
    put(".hidden", "9")
    assert run() == [("b.json", "1"), ("b.json", "2")]
    assert run() == [("b.json", "1"), ("b.json", "2")]
    put("a.json", "3")
    (folder / "c.json").write_text("not json")
    assert run() == [("a.json", "3"), ("b.json", "1"), ("b.json", "2"), ("c.json", None)]


def test_counters_are_those_of_the_rows(spark):
    got = {r.counter: r.n for r in records.counters_by_the_way(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got["items"] == docs and got["items_with_matches"] <= docs and got["matches"] >= got["items_with_matches"]
