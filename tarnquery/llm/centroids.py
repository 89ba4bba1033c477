"""Centroid clustering by Yinyang grouping, in whole numbers.

Centroids are put into groups once. A vector keeps an upper bound of the distance to its centroid and, for each group, a
lower bound of the distance to the group's other centroids. When centroids move, bounds move by as much; a vector whose
bounds don't meet keeps its centroid unseen (global filter), else only groups whose bound is met are scanned, exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnquery.llm.session import written

#: Centroids of a group, on average.
GROUP = 4
#: Vectors whose distances to a group are held at once.
TILE = 4096
#: Bounds are widened by this share, so that rounding never hides a tie.
EPS = 1e-9
#: Up to this size of components, distances by matrix product are whole numbers below 2**53.
EXACT = 1 << 21
STATE = "id {id}, x array<int>, cluster int, upper double, lower array<double>"


def most_component(dims: int) -> int:
    """Components beyond this are cut to it: squared distances of `dims` of them are 64-bit numbers."""
    return min(1 << 27, int((2**60 / max(dims, 1)) ** 0.5))


@dataclass
class Centroids:
    """Centroids by number, the group of each, and how far each moved from its last place."""

    at: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @classmethod
    def seeded(cls, seeds: list[list[int]], dims: int) -> Centroids:
        """Groups by a few rounds of plain clustering of the seeds themselves."""
        at = np.array(seeds, np.int64).reshape(-1, dims)
        n = max(1, -(-len(at) // GROUP))
        middles = at[np.arange(n) * len(at) // n].astype(float) if len(at) else np.zeros((1, dims))
        group = np.zeros(len(at), int)
        for _ in range(5):
            group = ((at[:, None, :] - middles) ** 2).sum(2).argmin(1) if len(at) else group
            middles = np.stack([at[group == g].mean(0) if (group == g).any() else middles[g] for g in range(n)])
        used = np.unique(group)
        return cls(at, np.searchsorted(used, group), np.zeros(len(at)))

    @property
    def groups(self) -> int:
        return int(self.group.max()) + 1 if len(self.group) else 0

    def replaced(self, at: np.ndarray) -> Centroids:
        return Centroids(at, self.group, np.sqrt(distances(at, self.at, np.arange(len(at)))))

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.at[k].tolist())).encode()).hexdigest()


def distances(x: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to the centroid of the number own gives."""
    step = x - at[own]
    return (step * step).sum(1)


def all_distances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to some centroids, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(at).max(initial=0)) <= EXACT and x.shape[1] <= 256:
        a, b = x.astype(float), at.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([distances(x, at, np.full(len(x), k)) for k in range(len(at))], 1)


def nearest(x: np.ndarray, cs: Centroids, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """(own, upper, lower) of vectors after the centroids moved; without own, of vectors seen for the first time."""
    n, wide, narrow = len(x), 1 + EPS, 1 - EPS
    if own is None:
        own, lower = np.zeros(n, int), np.zeros((n, cs.groups))
        live = np.arange(n)
    else:
        most = np.zeros(cs.groups)
        np.maximum.at(most, cs.group, cs.moved)
        upper, lower, own = upper + cs.moved[own] * wide, lower - most * wide, own.copy()
        live = np.flatnonzero(lower.min(1) <= upper)
    exact = distances(x[live], cs.at, own[live])
    tight = np.sqrt(exact) * wide
    if upper is None:
        upper = tight.copy()
    upper[live] = tight
    meets = lower[live].min(1) <= tight
    live, exact = live[meets], exact[meets]
    before, first = own[live], exact.copy()
    best, best_at = exact, before.copy()
    scanned = []
    for g in range(cs.groups):
        members = np.flatnonzero(cs.group == g)
        rows = np.flatnonzero(lower[live, g] <= np.sqrt(best) * wide)
        if not len(rows):
            continue
        d = all_distances(x[live[rows]], cs.at[members])
        pick = d.argmin(1)
        least = d[np.arange(len(rows)), pick]
        d[np.arange(len(rows)), pick] = np.iinfo(np.int64).max
        scanned.append((g, rows, members[pick], least, d.min(1)))
        better = (least < best[rows]) | ((least == best[rows]) & (members[pick] < best_at[rows]))
        best[rows[better]], best_at[rows[better]] = least[better], members[pick[better]]
    # the centroid that a vector leaves is one of its group's others from now on
    left = cs.group[before]
    lower[live, left] = np.where(best_at != before, np.minimum(lower[live, left], np.sqrt(first) * narrow), lower[live, left])
    for g, rows, picked, least, second in scanned:
        others = np.where(picked == best_at[rows], second, least)
        lower[live[rows], g] = np.sqrt(others.astype(float)) * narrow
    own[live], upper[live] = best_at, np.sqrt(best) * wide
    return own, upper, lower


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _assign(batches, cs: Centroids, last: bool):
    """Rows of the state with their new centroid and bounds; in the last round the exact distance instead of both."""
    for whole in batches:
        for k in range(0, len(whole), TILE):
            batch = whole.slice(k, TILE)
            x = _matrix(batch.column("x"), np.int64)
            known = [None] * 3
            if "cluster" in batch.schema.names:
                known = [batch.column("cluster").to_numpy().astype(int), batch.column("upper").to_numpy(), _matrix(batch.column("lower"), float)]
            own, upper, lower = nearest(x, cs, *known)
            ids, cluster = batch.column("id"), pa.array(own, pa.int32())
            if last:
                yield pa.RecordBatch.from_arrays([ids, cluster, pa.array(distances(x, cs.at, own))], ["id", "cluster", "distance"])
                continue
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * lower.shape[1], pa.int32()), pa.array(lower.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, batch.column("x"), cluster, pa.array(upper), bounds], ["id", "x", "cluster", "upper", "lower"])


def _sums(batches, k: int, dims: int):
    """Of the rows of a task, by centroid, the number of vectors and the sums of their components."""
    count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for batch in batches:
        own, x = batch.column("cluster").to_numpy(), _matrix(batch.column("x"), np.int64)
        order = np.argsort(own, kind="stable")
        held, starts = np.unique(own[order], return_index=True)
        if len(held):
            total[held] += np.add.reduceat(x[order], starts)
            count += np.bincount(own, minlength=k)
    held = np.flatnonzero(count)
    cells = np.repeat(held, dims + 1), np.tile(np.arange(dims + 1), len(held)), np.column_stack([total, count])[held].reshape(-1)
    yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int32()), pa.array(cells[2])], ["cluster", "dim", "n"])


def moved(state: DataFrame, cs: Centroids) -> Centroids:
    """Centroids at the floored means of their vectors; those without vectors stay. A number a component comes to the driver."""
    k, dims = cs.at.shape
    parts = state.select("cluster", "x").mapInArrow(partial(_sums, k=k, dims=dims), "cluster int, dim int, n long")
    sums: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(r.cluster, {})[r.dim] = r.n
    at = cs.at.copy()
    for c, s in sums.items():
        at[c] = [s[d] // s[dims] for d in range(dims)]
    return cs.replaced(at)


def whole_vectors(vectors: DataFrame, id_col: str, vector: str, dims: int, scale: float) -> DataFrame:
    """(id, x): vectors of exactly `dims` finite components as floored multiples of 1 / scale."""
    most, x = most_component(dims), F.col(vector)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = F.coalesce((F.size(x) == dims) & F.forall(x, finite), F.lit(False))
    cut = lambda v: F.greatest(F.least(F.lit(scale) * v.cast("double"), F.lit(float(most))), F.lit(-float(most)))
    return vectors.where(good).select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(cut(v)).cast("int")).alias("x"))


def seed_hash(id_col: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: float = 64.0, k: int = 16,
    rounds: int = 3, seed: int = 1,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dims` finite components.

    Vectors become whole numbers first; components beyond most_component(dims) are cut to it. Other vectors (null, of
    another size, with a null or non-finite component) give no row. Centroids start as the k vectors whose ids hash least
    under the seed; of equal ids, as of null ones, which hash as an empty text, the smaller vector comes first. A round
    assigns every vector to its nearest centroid, of ties that of the smaller number, and moves centroids to the floored
    means; at the end vectors are assigned once more. Fewer than k vectors: as many centroids; none: no rows. Repeated
    rows count as often as they come. Ids may be of any type; other columns aren't read. Sums of distances stop at the
    largest 64-bit number.

    The driver holds the centroids only; every round is a pass that rewrites the vectors with their bounds and one that
    sums them by task. No cluster is ever in one task.
    """
    points = written(whole_vectors(vectors, id_col, vector, dims, scale), "points")
    seeds = points.orderBy(seed_hash(F.col("id"), seed), "x").limit(k).collect()
    kind = points.schema["id"].dataType.simpleString()
    cs = Centroids.seeded([r.x for r in seeds], dims)
    state = points
    for _ in range(rounds if len(seeds) else 0):
        state = written(state.mapInArrow(partial(_assign, cs=cs, last=False), STATE.format(id=kind)), "bounds")
        cs = moved(state, cs)
    done = written(state.mapInArrow(partial(_assign, cs=cs, last=True), f"id {kind}, cluster int, distance long"), "clusters")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), most)
    by_cluster = done.groupBy("cluster").agg(total("distance").cast("long").alias("cluster_inertia"))
    digests = done.sparkSession.createDataFrame(
        [(c, cs.digest(c)) for c in range(len(cs.at))], "cluster int, centroid_sha256 string"
    )
    # one row a centroid
    stats = by_cluster.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(by_cluster.agg(total("cluster_inertia").cast("long").alias("inertia"))))
    found = done.join(F.broadcast(stats), "cluster")
    return found.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(dims: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """The same in SQL: every vector's distance to every centroid, in every round."""
    square = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    near = "SELECT p.n, any_value(p.vec_id) AS vec_id, any_value(p.x) AS x, min(struct_pack(d := CAST({d} AS BIGINT), c := c.c)) AS best FROM p, {c} c GROUP BY p.n"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(d=square, c=f'c{r}')})")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY best.c, i),
            m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY c),
            c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)""")
    return f"""
        WITH p AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        ), c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS INTEGER) AS c, x FROM p QUALIFY c < {k}
        ), {", ".join(steps)}
        SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON a.best.c = c.c"""
