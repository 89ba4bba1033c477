import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnquery.llm import exchange, suffix_tree


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(corpus, train, depth, least):
    """The same model word by word: counts of every context of up to depth words, tests, smoothing, scores."""
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for k, t in corpus}
    follow = {}
    for k in tokens:
        if train(k):
            for i, x in enumerate(tokens[k]):
                for n in range(min(depth, i) + 1):
                    follow.setdefault(tuple(tokens[k][i - n : i]), Counter())[x] += 1
    uni = follow.get((), Counter())
    total, kinds = sum(uni.values()), len(uni)
    size = {c: sum(f.values()) for c, f in follow.items()}
    mass = {}

    def probability(context, x):
        """Of x after the longest retained suffix of a context."""
        if not context:
            return (uni[x] + 1) / (total + kinds + 1)
        p, n, m = probability(context[1:], x), size.get(context, 0), state(context)
        return (max(follow[context][x] - 1, 0) + (n - m) * p) / n if m else p

    def state(context):
        """The mass of the followers seen again if the context is a state, else 0."""
        if context not in mass:
            f, n = follow.get(context, {}), size.get(context, 0)
            m = sum(c - 1 for c in f.values())
            gain = 0.0
            if n >= 2 and m and n != size.get(context[1:]):
                for x, c in f.items():
                    if c > 1:
                        q = math.exp(-round(-8 * math.log(probability(context[1:], x))) / 8)
                        gain += (c - 1) * math.log((c - 1 + (n - m) * q) / (n * q))
                gain += (n - m) * math.log((n - m) / n)
                mass[context] = m if gain / n >= least else 0
            else:
                mass[context] = 0
        return mass[context]

    out = {}
    for k, ws in tokens.items():
        base = sum(math.log10((uni[x] + 1) / (total + kinds + 1)) for x in ws)
        score = sum(math.log10(probability(tuple(ws[max(0, i - depth) : i]), x)) for i, x in enumerate(ws))
        out[k] = (len(ws), sum(uni[x] > 0 for x in ws), total, base, score)
    return out


@pytest.mark.parametrize(
    ("chunk", "bucket", "depth", "hot", "divergence"),
    [(4 << 20, 2_000_000, 3, 4_000_000, 0.02), (4000, 300, 5, 10, 0.02), (4000, 300, 3, 4, 0.6), (4000, 300, 3, 10, -100)],
)
def test_matches_brute_force(docs, corpus, chunk, bucket, depth, hot, divergence, monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(exchange, "BUCKET_KEYS", bucket)
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    want = brute(corpus, lambda k: k % 5, depth, divergence)
    got = suffix_tree.score_texts(docs, F.col("doc_id") % 5 != 0, depth=depth, divergence=divergence)
    got = {r.id: r for r in got.collect()}
    assert len(got) == len(corpus)
    for k, (n, known, total, base, score) in want.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_probabilities_of_a_state_sum_to_one():
    uni = Counter({"a": 5, "b": 3, "c": 2})
    total, kinds = sum(uni.values()), len(uni)
    follow = Counter({"a": 3, "b": 1})
    p = lambda x: (uni[x] + 1) / (total + kinds + 1)
    mass, _ = suffix_tree.gain(np.array([0, 0]), np.array([4]), np.array([3, 1]), np.array([p("a"), p("b")]))
    q = lambda x: (max(follow[x] - 1, 0) + (4 - mass[0]) * p(x)) / 4
    assert sum(q(x) for x in "abc") + q("unknown") == pytest.approx(1)


def test_longer_contexts_predict_held_out_copies_better(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    passages = [[rng.choice(words) for _ in range(30)] for _ in range(40)]
    rows = [(k, " ".join(passages[k % 40])) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for depth in (1, 2, 3):
        found = suffix_tree.score_texts(docs, F.col("doc_id") < 160, depth=depth).where("not train")
        scores.append(found.agg(F.sum("score"), F.sum("base_score")).first())
    assert scores[2][0] > scores[1][0] > scores[0][0] > scores[0][1]


def test_nothing_to_learn_from(spark, nothing):
    assert suffix_tree.score_texts(nothing, F.lit(True)).count() == 0
    rows = suffix_tree.score_texts(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), F.lit(False)).collect()
    assert {(r.id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows} == {(1, 3, 0, 0, 0.0), (None, 1, 0, 0, 0.0)}
