"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c have squared distance <= 2 - 2c. Rotated to the principal axes and split into blocks of
a few axes, a pair within that distance is, in at least one block, within the block's share of it. Vectors are dealt
into tiles of bounded size, and each two tiles within reach meet once, in a task of their own. There each block is
joined by range, with budgets in proportion to the blocks' variance; a pair found in some block is verified exactly on
the full vectors, and counted in the first block whose budget it meets.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnquery.llm.components import connected_components
from tarnquery.llm.hashing import mix, trim
from tarnquery.llm.session import written

#: Axes of a block, vectors of a tile, and vectors compared at once.
AXES, TILE, LEAF, CHUNK = 11, 32768, 512, 1024
#: Bytes of the vectors of a tile, and tiles that a table of 1,024 vectors in each is dealt into at least.
TILE_BYTES, SPREAD = 16 << 20, 8
#: Pairs verified one by one at once, and the share of pairs in reach from which they are verified by a matrix product.
PAIRS, DENSE = 1 << 14, 0.05


def _unit(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are whole, finite and not zero, and these as unit vectors in double precision."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    ok = np.flatnonzero((sizes == dim) & ~np.asarray(lists.is_null()))
    if not len(ok) or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    flat = lists.take(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(flat).all(1) & np.isfinite(norm) & (norm > 0)
    # the exponent first, so that very large or small components neither overflow nor vanish
    if (bad := np.isfinite(flat).all(1) & (flat != 0).any(1) & ~good).any():
        flat[bad] /= np.abs(flat[bad]).max(1)[:, None]
        norm[bad] = np.sqrt((flat[bad] ** 2).sum(1))
        good |= bad
    return ok[good], flat[good] / norm[good][:, None]


def _units(batches, dim: int):
    """(id, two hashes, unit vector as bytes) of each row; nulls for a vector that links with nothing."""
    for batch in batches:
        ok, x = _unit(batch.column(1), dim)
        ok_ids = np.asarray(batch.column(0).is_valid())[ok]
        ok, x = ok[ok_ids], x[ok_ids] + 0.0
        bits = x.view(np.uint64)
        h = [np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)]
        for k in range(dim):
            for j, salt in enumerate((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)):
                h[j] = mix((h[j] ^ bits[:, k]) + np.uint64(salt))
        at = np.full(batch.num_rows, -1)
        at[ok] = np.arange(len(ok))
        take = pa.array(np.maximum(at, 0), mask=at < 0)
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v.view(np.int64)).take(take) for v in h], rows.take(take)], ["id", "h1", "h2", "x"])


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _covariance(batches, dim: int):
    total, count = np.zeros((dim, dim)), 0
    for batch in batches:
        x = _rows(batch.column(0), dim)
        total += x.T @ x
        count += len(x)
    yield pa.RecordBatch.from_arrays([pa.array([[float(count), *total.reshape(-1)]], pa.list_(pa.float64()))], ["sums"])


def _firsts(batches, axis: np.ndarray):
    """The coordinate on the first axis."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_rows(batch.column(0), len(axis)) @ axis)], ["first"])


def _strip_sizes(batches, axis: np.ndarray, edges: np.ndarray):
    """How many vectors lie in each strip."""
    sizes = np.zeros(len(edges) + 1, np.int64)
    for batch in batches:
        sizes += np.bincount(np.searchsorted(edges, _rows(batch.column(0), len(axis)) @ axis, "right"), minlength=len(sizes))
    strip = np.flatnonzero(sizes)
    yield pa.RecordBatch.from_arrays([pa.array(strip, pa.int32()), pa.array(sizes[strip])], ["strip", "vectors"])


def _deal(batches, axis: np.ndarray, edges: np.ndarray, parts: np.ndarray, reach: float):
    """Vectors packed by tile, once each, with the first and the last tile that theirs has to meet.

    Strips are cut along the axis at the edges; a strip has as many tiles as parts says, dealt out by the id.
    """
    end = np.cumsum(parts)
    first = end - parts
    low = first[np.searchsorted(edges, np.append(-np.inf, edges) - reach, "right")]
    high = end[np.searchsorted(edges, np.append(edges, np.inf) + reach, "right")] - 1
    for batch in batches:
        ids, copies, x = np.asarray(batch.column(0)), np.asarray(batch.column(2)), _rows(batch.column(1), len(axis))
        if not len(ids):
            continue
        strip = np.searchsorted(edges, x @ axis, "right")
        tile = first[strip] + (mix(ids.view(np.uint64)) % parts[strip].astype(np.uint64)).astype(np.int64)
        order = np.argsort(tile, kind="stable")
        new = np.flatnonzero(np.diff(tile[order], prepend=-1))
        packed = [[v[k].tobytes() for k in np.split(order, new[1:])] for v in (ids, copies, x)]
        at = order[new]
        numbers = [pa.array(v, pa.int32()) for v in (tile[at], low[strip[at]], high[strip[at]])]
        yield pa.RecordBatch.from_arrays([*numbers, *[pa.array(v, pa.binary()) for v in packed]], ["tile", "low", "high", "ids", "copies", "x"])


def _leaves(home: np.ndarray, probe: np.ndarray, y: np.ndarray, r: float, later: bool):
    """Splits homes at medians until LEAF are left; probes farther than r from a part's range are left out of it.

    y has a row for each axis. later: probes before a part on the first axis are left out, too.
    """
    todo = [(home, probe)]
    while todo:
        h, p = todo.pop()
        if not len(h) or not len(p):
            continue
        if len(h) <= LEAF:
            for c in range(len(y)):
                v, w = y[c, h], y[c, p]
                p = p[(w >= v.min() - (0 if later and not c else r)) & (w <= v.max() + r)]
            yield h, p
            continue
        c = int(np.argmax(y[:, h].std(1)))
        v, w = y[c, h], y[c, p]
        low = v <= np.median(v)
        if low.all() or not low.any():
            half = len(h) // 2
            todo += [(h[:half], p), (h[half:], p)]
            continue
        top, bottom = v[low].max(), v[~low].min()
        todo += [(h[low], p[w <= top + r]), (h[~low], p[w >= bottom - (0 if later and not c else r)])]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reached) that keep the components of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


class _Links:
    """Numbers of links, and labels that connected vectors share: their size is that of the vectors, not of the links."""

    def __init__(self, copies: np.ndarray) -> None:
        self.copies, self.count, self.label = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def merge(self, u: np.ndarray, v: np.ndarray) -> None:
        a, b = self.label[u], self.label[v]
        if len(new := np.flatnonzero(a != b)):
            node, root = _forest(a[new], b[new])
            to = np.arange(len(self.label))
            to[node] = root
            self.label = to[self.label]

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        """Links u-v, each pair once."""
        np.add.at(self.count, u, self.copies[v])
        np.add.at(self.count, v, self.copies[u])
        self.merge(u, v)

    def add_all(self, h: np.ndarray, q: np.ndarray, linked: np.ndarray) -> None:
        """Links of each row h with each column q where linked."""
        weight = linked.astype(np.float64)
        self.count[h] += (weight @ self.copies[q].astype(np.float64)).astype(np.int64)
        self.count[q] += (self.copies[h].astype(np.float64) @ weight).astype(np.int64)
        while True:  # each vector's first link to another label at once, which at least halves the labels
            apart = linked & (self.label[h][:, None] != self.label[q])
            i, j = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
            if not len(i):
                return
            self.merge(np.concatenate([h[i], h[apart[:, j].argmax(0)]]), np.concatenate([q[apart[i].argmax(1)], q[j]]))


def _join(key, table: pa.Table, turn: np.ndarray, blocks: list[tuple[int, int]], budget: np.ndarray, cosine: float) -> pa.Table:
    """Links between the vectors of two tiles, or within one: their numbers by vector, and a forest of their components."""
    dim, (one, two) = len(turn), (k.as_py() for k in key)
    join = lambda name, kind: np.concatenate([np.frombuffer(v, kind) for v in table[name].to_pylist()])
    ids, x = join("ids", np.int64), join("x", np.float64).reshape(-1, dim)
    tile = np.repeat(table["tile"].to_numpy(), [len(v) // 8 for v in table["ids"].to_pylist()])
    links, y = _Links(join("copies", np.int64)), x @ turn
    home, probe, same = np.flatnonzero(tile == one), np.flatnonzero(tile == two), one == two
    starts = [s for s, _ in blocks]
    slack = budget * 1e-4 + 1e-5  # single precision only tells what is far from the budget
    sides = []
    for b, (a, z) in enumerate(blocks):
        part = y[:, a:z].astype(np.float32)
        half, ones = (part * part).sum(1, keepdims=True) / 2, np.ones((len(part), 1), np.float32)
        # the product of a row of each is (budget + slack - squared distance) / 2
        reach = float(budget[b] + slack[b]) / 2
        sides.append((np.hstack([part, ones, reach - half]).astype(np.float32), np.hstack([part, -half, ones]).astype(np.float32)))

    def product(b: int, h: np.ndarray, q: np.ndarray) -> np.ndarray:
        return sides[b][0][h] @ sides[b][1][q].T

    def verify(b: int, i: np.ndarray, j: np.ndarray) -> None:
        for m in range(0, len(i), PAIRS):
            u, v = i[m : m + PAIRS], j[m : m + PAIRS]
            ok = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            u, v = u[ok], v[ok]
            within = np.add.reduceat((y[u] - y[v]) ** 2, starts, axis=1) <= budget * (1 + 1e-9) + 1e-12
            mine = within.argmax(1) == b
            if mine.any():
                links.add(u[mine], v[mine])

    def verify_all(b: int, h: np.ndarray, q: np.ndarray, near: np.ndarray, hit: np.ndarray) -> None:
        """As verify, where many pairs hit: what is clear is told by products, the rest pair by pair. near: product()."""
        clear = near >= slack[b]
        for e in range(b):
            before = product(e, h, q)
            hit &= before < slack[e]  # else it counts in that block
            clear &= before < 0
        if hit.any():
            cos = x[h] @ x[q].T
            hit &= cos >= cosine - 1e-9
            clear &= hit & (cos >= cosine + 1e-9)
            links.add_all(h, q, clear)
            i, j = np.divmod(np.flatnonzero(hit & ~clear), len(q))
            verify(b, h[i], q[j])

    for b, (a, z) in enumerate(blocks):
        part = np.ascontiguousarray(y[:, a:z].T, np.float32)
        first = part[0]
        for h, p in _leaves(home, probe, part, math.sqrt(budget[b]) + 1e-4, same):
            left = sides[b][0][h]
            for k in range(0, len(p), CHUNK):
                q = p[k : k + CHUNK]
                near = left @ sides[b][1][q].T
                some = np.flatnonzero(near.max(1) >= 0)
                if not len(some):
                    continue
                hit = near[some] >= 0
                if np.count_nonzero(hit) > DENSE * near.size:
                    hit, u = near >= 0, h[:, None]
                    if same:
                        hit &= (first[u] < first[q]) | ((first[u] == first[q]) & (u < q))
                    verify_all(b, h, q, near, hit)
                    continue
                i, j = np.divmod(np.flatnonzero(hit), len(q))
                i, j = h[some[i]], q[j]
                if same:  # each pair once, from the one that comes first
                    keep = (first[i] < first[j]) | ((first[i] == first[j]) & (i < j))
                    i, j = i[keep], j[keep]
                verify(b, i, j)
    node = np.flatnonzero(links.label != np.arange(len(ids)))
    some = np.flatnonzero(links.count)
    out = pa.table({
        "vec": pa.chunked_array([pa.array(ids[some]), pa.array(ids[node])]),
        "links": pa.chunked_array([pa.array(links.count[some]), pa.nulls(len(node), pa.int64())]),
        "root": pa.chunked_array([pa.nulls(len(some), pa.int64()), pa.array(ids[links.label[node]])]),
    })
    trim()
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, axes: int = AXES, tile: int = TILE) -> DataFrame:
    """Per row: id, n_links, component_id (the smallest id reachable by links, itself included), kept (id = component_id).

    Two vectors are linked if their cosine in double precision is at least `cosine` (above 0). Vectors that are null,
    zero, hold null or non-finite components, or have another length than most, link with nothing. Equal vectors are
    joined first and stand as one with their number; every other pair within reach is compared once. Ids are unique whole numbers, others raise an
    error; a null id links with nothing. Other columns are dropped. Vectors count as equal by 128 bits of hash of the unit vector.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0, at most 1")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    dim = given.where(F.col("v").isNotNull()).groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    if dim is None:
        return given.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = dim.d
    units = written(given.mapInArrow(partial(_units, dim=dim), "id long, h1 long, h2 long, x binary"), "units")
    # equal vectors first: one row for each, with the number of its copies
    same = units.where("x is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.any_value("x").alias("x"), F.count("*").alias("copies"))
    reps = written(same, "vectors")
    sums = np.sum([r.sums for r in reps.select("x").mapInArrow(partial(_covariance, dim=dim), "sums array<double>").collect()], axis=0)
    n = int(sums[0])
    value, turn = np.linalg.eigh(sums[1:].reshape(dim, dim) / max(n, 1))
    turn, value = np.ascontiguousarray(turn[:, ::-1]), np.maximum(value[::-1], 0)
    blocks = [(a, min(a + axes, dim)) for a in range(0, dim, axes)]
    shares = np.array([value[a:z].sum() for a, z in blocks]) + 1e-9
    budget = (2 - 2 * cosine) * shares / shares.sum() + 1e-12
    # tiles: strips along the first axis; a crowded strip has several
    most = max(1, min(tile, TILE_BYTES // (8 * dim)))
    strips = max(1, math.ceil(n / most), min(SPREAD, n >> 10))
    axis, edges, reach = np.ascontiguousarray(turn[:, 0]), np.zeros(0), math.sqrt(2 - 2 * cosine) + 1e-6
    if strips > 1:
        along = reps.select("x").mapInArrow(partial(_firsts, axis=axis), "first double")
        edges = np.unique(along.agg(F.percentile_approx("first", [k / strips for k in range(1, strips)], min(100 * strips, 1_000_000))).first()[0])
    parts = np.ones(len(edges) + 1, np.int64)
    sizes = reps.select("x").mapInArrow(partial(_strip_sizes, axis=axis, edges=edges), "strip int, vectors long")
    for r in sizes.groupBy("strip").agg(F.sum("vectors").alias("vectors")).collect():
        parts[r.strip] = max(1, math.ceil(r.vectors / (1.25 * most)))
    dealt = reps.select("rep", "x", "copies").mapInArrow(partial(_deal, axis=axis, edges=edges, parts=parts, reach=reach), "tile int, low int, high int, ids binary, copies binary, x binary")
    met = dealt.withColumn("other", F.explode(F.sequence("low", "high")))
    met = met.select(F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "ids", "copies", "x")

    def joined(key, table):
        return _join(key, table, turn, blocks, budget, cosine)

    found = written(met.groupBy("one", "two").applyInArrow(joined, "vec long, links long, root long"), "found")
    links = found.where("links is not null").groupBy(F.col("vec").alias("rep")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("root is not null"), "vec", "root")
    label = reps.select("rep", "h1", "h2", "copies").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    label = label.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = units.select("id", "h1", "h2").join(label, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
