import numpy as np
import pytest

from tarnquery.llm import embeddings
from tarnquery.llm.embeddings import near_vectors


def brute(rows, cosine):
    good = [(k, np.array(v, float)) for k, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    ids = [k for k, _ in good]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(ids))
    while True:
        new = np.array([min(label[i], *label[near[i]], label[i]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    least = {c: min(ids[i] for i in range(len(ids)) if label[i] == c) for c in set(label)}
    return {k: (int(near[i].sum()), least[label[i]]) for i, k in enumerate(ids)}


@pytest.mark.parametrize("tile", [16384, 40])
def test_matches_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + rng.normal(size=16) * rng.choice([0.1, 0.4, 2])).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[7][1]) for k in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("inf")] + [1.0] * 15), (2004, [float("nan")] * 16), (2005, [1.0] * 3), (2006, [1e-30] * 16), (2007, [1e30] * 16)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, label int, id string")
    want = brute(rows, 0.9)
    got = {r.id: r for r in near_vectors(df, tile=tile).collect()}
    assert len(got) == len(rows)
    for k, _ in rows:
        links, component = want.get(k, (0, k))
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (links, component, component == k), k


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_dealing_holds_no_more_than_its_batch(spark, monkeypatch, tmp_path):
    """F1 of r04: a batch was dealt to all tiles of all blocks at once, the more of them the larger the table."""
    deal, log = embeddings._deal, str(tmp_path / "dealt")

    def watched(batches, *args, **kwargs):
        for batch in batches:
            for dealt in deal(iter([batch]), *args, **kwargs):
                with open(log, "a") as f:
                    f.write(f"{dealt.nbytes / batch.nbytes}\n")
                yield dealt

    monkeypatch.setattr(embeddings, "_deal", watched)
    x = np.random.default_rng(4).normal(size=(2000, 64)).astype(np.float32)
    x = np.concatenate([x, x[:20] * 1.001 + 0.001])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(2)
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(df, tile=100).collect()}
    assert got == {k: (int(k < 20 or k >= 2000), k - 2000 if k >= 2000 else k) for k in range(2020)}
    assert max(map(float, open(log))) < 1.5


@pytest.mark.parametrize("tile", [16384, 700])
def test_large_groups_match_brute_force(spark, tile):
    """Groups so large that their pairs are verified by products, with many pairs at both sides of the threshold."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 16))
    spread = [0.05, 0.31, 0.35]
    rows = [(k, (centres[k % 3] + rng.normal(size=16) * spread[k % 3]).astype(np.float32).tolist()) for k in range(2400)]
    rows += [(3000 + k, rows[k][1]) for k in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 0.9)
    got = {r.id: (r.n_links, r.component_id) for r in near_vectors(df, tile=tile).collect()}
    assert got == want


def test_vectors_of_low_rank(spark):
    """Most blocks have no variance there; a tile without a home raised an error."""
    x = np.zeros((1200, 16))
    x[:, :3] = np.random.default_rng(0).normal(size=(1200, 3))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    want = brute(rows, 0.9)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.id: (r.n_links, r.component_id) for r in near_vectors(df, tile=300).collect()} == want
