"""Yinyang grouping against clustering that measures every distance."""

import hashlib
import math

import numpy as np
import pytest

from tarnquery.llm import centroids


def slowly(rows, dims, k, rounds):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(at)), key=lambda c: (square(v, at[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for c in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    d = [square(v, at[c]) for (_, v), c in zip(kept, own)]
    inertia = {c: sum(x for x, o in zip(d, own) if o == c) for c in set(own)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, x, inertia[c], sum(d), sha[c]) for (i, _), c, x in zip(kept, own, d)), key=str)


def got(spark, rows, kind="long", **more):
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], f"vec_id {kind}, embedding array<float>, cluster int, id string")
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **more).collect()), key=str)


def vectors(n, dims, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, dims))
    return [(i, (middles[i % 9] + rng.normal(size=dims) * spread).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("rounds,group", [(0, 4), (3, 4), (6, 1), (3, 100)])
def test_against_all_distances(spark, monkeypatch, rounds, group):
    monkeypatch.setattr(centroids, "GROUP", group)
    rows = vectors(300, 8)
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(i, rows[5][1]) for i in (5, 5, None, None)]
    rows += [(2000, None), (2001, [1.0] * 7), (2002, [None] + [1.0] * 7), (2003, [float("inf")] * 8), (2004, [float("nan")] * 8), (2005, [0.0] * 8), (2006, [])]
    assert got(spark, rows, dims=8, k=16, rounds=rounds) == slowly(rows, 8, 16, rounds)


def test_ties_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(27)]
    assert got(spark, grid, dims=2, k=12, rounds=3) == slowly(grid, 2, 12, 3)
    assert got(spark, grid[:5], dims=2, k=16, rounds=3) == slowly(grid[:5], 2, 16, 3)
    assert got(spark, [], dims=2) == got(spark, [(1, None)], dims=2) == []
    named = [(f"v{i}", v) for i, v in grid]
    assert got(spark, named, "string", dims=2, k=4, rounds=2) == slowly(named, 2, 4, 2)


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 1e5).astype(np.float32).tolist()) for i in range(80)]
    assert got(spark, rows, dims=4, k=8, rounds=3) == slowly(rows, 4, 8, 3)
    far = [*rows, (100, [3e38, -3e38, 1.0, 1.0]), (101, [-3e38, 3e38, 1.0, 1.0])]
    out = got(spark, far, dims=4, k=8, rounds=3)
    assert len(out) == 82 and all(0 <= r[2] < 2**63 and 0 <= r[4] < 2**63 for r in out)


def test_bounds_spare_distances(monkeypatch):
    """After the centroids have settled, most vectors keep theirs without a scan, and all are right."""
    x = np.array([[round(64 * c) for c in v] for _, v in vectors(4000, 16, spread=0.1)], np.int64)
    cs = centroids.Centroids.seeded(x[:32].tolist(), 16)
    state, cells = (None, None, None), []
    monkeypatch.setattr(centroids, "all_distances", lambda x, at, whole=centroids.all_distances: cells.append(len(x) * len(at)) or whole(x, at))
    for _ in range(8):
        cells.clear()
        state = centroids.nearest(x, cs, *state)
        assert (state[0] == ((x[:, None, :] - cs.at) ** 2).sum(2).argmin(1)).all()
        at = np.stack([x[state[0] == c].sum(0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else cs.at[c] for c in range(32)])
        cs = cs.replaced(at)
    assert sum(cells) < 0.5 * len(x) * 32
