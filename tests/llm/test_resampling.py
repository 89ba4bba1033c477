"""Importance resampling against plain loops with zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnquery.llm import hashing, queries, resampling


def runs(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(run):
    return zlib.crc32(run.encode()) % 10_000


def slowly(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    big_s, big_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10_000)]
    out = []
    for k, text in docs:
        words, f = runs(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    order = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(order[: 25 * len(order) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.fixture(scope="module")
def rows(corpus):
    rng = random.Random(8)
    more = ["É" * 60 + " a " + "b" * 70 + " " + "c" * 48, "a-b_c 9é9", "x" * 49 + " y", "Ab\x00cD"]
    target = [" ".join(f"w{rng.randint(0, 40)}" for _ in range(30)) for _ in range(8)]
    return [*corpus, *[(5000 + k, t) for k, t in enumerate(more)], (None, corpus[4][1]), (7, corpus[5][1])], [*target, None, "", target[0]]


def test_sums_of_runs():
    texts = ["alpha beta gamma", "", "é" * 40 + " b " + "z" * 100 + " q", "one", "a b"]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = hashing.tokenise(np.frombuffer(data, np.uint8), offs, lower=True, separators=hashing.NOT_ALNUM)
    doc, sums = resampling.run_sums(w, 3)
    want = Counter()
    for k, t in enumerate(texts):
        said = t.split()
        want.update((k, zlib.crc32(" ".join(said[i : i + n]).encode())) for n in (1, 2, 3) for i in range(len(said) - n + 1))
    assert Counter(zip(doc.tolist(), sums.tolist())) == want


@pytest.mark.parametrize("hot", [1000, 2])
def test_against_plain_loops(spark, rows, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(resampling, "HOT", hot)
    docs, target = rows
    given = spark.createDataFrame([(k, t, "c", 1) for k, t in docs], "doc_id long, text string, digest string, weight int")
    given.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = queries.op11_importance_resampling(spark, f"file://{tmp_path}").select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=str) == slowly(docs, target)


def test_texts_are_collapsed_and_ids_of_any_type(spark, rows):
    docs = spark.createDataFrame([(f"d{k}", "the same words again " * 6) for k in range(200)], "doc_id string, text string")
    assert resampling.text_features(docs, "text", 2, 10_000).count() == 1
    got = resampling.resample(docs, docs).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 51)) and len({(r.n_features, r.weight) for r in got}) == 1
    assert min(r.score for r in got if r.rank) >= max(r.score for r in got if not r.rank)


def test_empty_tables(spark, nothing, docs):
    assert resampling.resample(nothing, docs).count() == 0
    left = resampling.resample(docs, nothing).collect()
    assert len(left) == docs.count() and sum(r.rank is not None for r in left) > 0
