import hashlib
import re
from collections import Counter

import pytest

from tarnquery.llm import exchange
from tarnquery.llm.substring import remove_repeats


def brute(corpus, window):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in corpus}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        drop = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                drop[i : i + window] = [True] * window
        out[k] = (w, drop)
    return out


@pytest.mark.parametrize(("window", "chunk", "bucket"), [(35, 4 << 20, 2_000_000), (6, 3000, 400)])
def test_matches_brute_force(docs, corpus, window, chunk, bucket, monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(exchange, "BUCKET_KEYS", bucket)
    want = brute(corpus, window)
    got = {r.doc_id: r for r in remove_repeats(docs, window=window, digest=True).collect()}
    assert len(got) == len(corpus)
    for k, (w, drop) in want.items():
        kept = " ".join(x for x, d in zip(w, drop) if not d)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest())
        assert got[k].id == "clash"


def test_texts_without_repeats_stay_as_they_are(docs, corpus):
    want = brute(corpus, 35)
    for r in remove_repeats(docs, window=35).collect():
        w, drop = want[r.doc_id]
        assert r.text == (dict(corpus)[r.doc_id] if not any(drop) else " ".join(x for x, d in zip(w, drop) if not d))


def test_repeats_within_one_text_and_empty_tables(spark, nothing):
    assert remove_repeats(nothing).count() == 0
    words = " ".join(f"u{k}" for k in range(40))
    got = remove_repeats(spark.createDataFrame([(None, f"{words} gap {words}"), (2, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in got} == {(None, "gap", 80), (2, None, 0)}


def test_packing_round_trip():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (exchange.unpack(exchange.pack(keys)) == keys).all()
        edges = exchange.bucket_edges(keys, 7)
        assert edges[0] == 0 and edges[-1] == n and (np.diff(edges) >= 0).all()
        counts = rng.integers(0, 1000, n)
        assert (exchange.unpack_counts(exchange.pack_counts(counts)) == counts).all()
