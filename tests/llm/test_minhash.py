import re
from collections import Counter

import numpy as np

from tarnquery.llm.components import connected_components
from tarnquery.llm.minhash import bands_for, near_duplicates, sketch


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_sets(corpus, size):
    out = {}
    for k, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        out[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    return out


def expected(sets, percent):
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {k: find(k) for k in ids}


def check(docs, corpus, size, percent):
    sets = shingle_sets(corpus, size)
    want = expected(sets, percent)
    got = {r.id: r for r in near_duplicates(docs, shingle=size, percent=percent).collect()}
    assert len(got) == len(corpus)
    for k, s in sets.items():
        assert (got[k].n_shingles, got[k].component_id, got[k].kept) == (len(s), want[k], want[k] == k)


def test_links_match_brute_force(docs, corpus):
    check(docs, corpus, 3, 85)


def test_links_at_the_usual_threshold(docs, corpus):
    check(docs, corpus, 5, 80)


def test_edge_cases(spark, nothing):
    assert near_duplicates(nothing).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (4, None), (5, "")]
    got = sorted(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert Counter((r.id, r.component_id, r.kept) for r in got) == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (4, 4, True), (5, 5, True)])


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([shared, own[:50]])), np.sort(np.concatenate([shared, own[50:]])), shared[:1]]
    doc = np.repeat(np.arange(3), [len(s) for s in sets])
    out = sketch(doc, np.concatenate(sets), 3, 180)
    assert (out != 2**64 - 1).all()
    assert abs((out[0] == out[1]).mean() - 0.9) < 0.08
    assert bands_for(0.85) >= 29


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert set(got[k] for k in range(1, 41)) == {1}
    assert set(got[k] for k in range(100, 200)) == {100}
