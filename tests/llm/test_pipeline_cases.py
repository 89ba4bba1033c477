"""The pipeline on empty tables, repeated and null rows, and columns with the names its stages use."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnquery.llm.session import written

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, change):
        top = f"file://{tmp_path}/{name}"
        for t in ("documents", "labels", "benchmark"):
            df = spark.read.parquet(f"{SF}/{t}.parquet")
            change(t, df).write.parquet(f"{top}/{t}.parquet")
        return top

    return put


def test_empty_tables(spark, folder):
    out = corpus_pipeline.run(spark, folder("empty", lambda t, df: df.limit(0)))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_clashing_columns_change_nothing(spark, folder):
    def odd(t, df):
        if t != "documents":
            return df
        first = df.where("doc_id < 20")
        blank = first.limit(3).withColumn("text", F.lit(None).cast("string"))
        lost = first.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
        return df.unionByName(first).unionByName(blank).unionByName(lost).coalesce(1)

    names = ("id", "score", "kept", "chunk", "data", "bucket", "component_id", "n_removed")

    def clash(t, df):
        df = odd(t, df)
        return df.withColumns({c: F.lit("clash") for c in names}) if t == "documents" else df

    def stages(top):
        docs = spark.read.parquet(f"{top}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, top), "stage")
        return docs, corpus_pipeline.STAGES[-1][1](spark, docs, top)

    (plain, mixed), (named, mixed_too) = stages(folder("plain", odd)), stages(folder("named", clash))
    rows = lambda df: sorted((str(r.doc_id), r.text or "", str(r.source), r.n_chars) for r in df.collect())
    assert rows(plain) == rows(named) and plain.count() > 0
    assert {tuple(r) for r in named.select(*names).distinct().collect()} == {("clash",) * len(names)}
    # which of a source's rows the mix takes depends on the whole row, how much it takes doesn't
    targets = lambda df: {r.source: (r.source_size, r.target) for r in df.collect()}
    assert targets(mixed) == targets(mixed_too)
