"""MinHash near-duplicates: fast similarity sketches, banding, then exact verification of shingle sets.

A sketch has t coordinates. In round i < t every element of the set falls into a hashed bin with a value between i
and i + 1, and a bin keeps its least value; from round t on, round i fills bin i - t alone. A document stops once all
its bins are full, so short texts fill every coordinate too and the estimate keeps its concentration bounds.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnquery.llm.components import connected_components
from tarnquery.llm.hashing import U, mix, shingles, slices, string_parts, tokenise, trim
from tarnquery.llm.session import join_small, written

SKETCH_SCHEMA = "id long, n_shingles long, set_a long, set_b long, bands array<long>"


def bands_for(similarity: float, rows: int = 6, miss: float = 1e-6) -> int:
    """Bands of `rows` coordinates each so that a pair at the threshold shares none with probability `miss`."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def sketch(doc: np.ndarray, h: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """Fast similarity sketches (n_docs x t) of the sets given as sorted (document, hash) rows."""
    empty = U(2**64 - 1)
    out = np.full((n_docs, t), empty, U)
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(doc):
            break
        r = mix(h + U(i * 0x9E3779B97F4A7C15 % 2**64))
        low = (r & U(0xFFFFFFFF)) | U(i << 32)
        where = (((r >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, doc * t + where, low)
        if i < 4 or i % 8 == 0 or i >= t:
            there = np.unique(doc)
            open_ = np.zeros(n_docs, bool)
            open_[there] = (out[there] == empty).any(1)
            keep = open_[doc]
            doc, h = doc[keep], h[keep]
    return out


def _sketches(batches, size: int, rows: int, bands: int):
    for batch in batches:
        data, offs = string_parts(batch.column(1))
        for a, b in slices(offs):
            w = tokenise(data, offs[a : b + 1], lower=True)
            doc, h = shingles(w, size)
            n = b - a
            counts = np.bincount(doc, minlength=n)
            sums = [np.zeros(n, U), np.zeros(n, U)]
            for s, salt in zip(sums, (0x243F6A8885A308D3, 0x13198A2E03707344), strict=True):
                np.add.at(s, doc, mix(h ^ U(salt)))
            sk = sketch(doc, h, n, rows * bands).reshape(n, bands, rows)
            key = np.broadcast_to(np.arange(bands, dtype=U) * U(0xA0761D6478BD642F), (n, bands)).copy()
            for k in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) + sk[:, :, k])
            some = counts > 0
            key = key.view(np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(key[some].reshape(-1)))
            sets = [pa.array(x.view(np.int64)) for x in sums]
            columns = [batch.column(0).slice(a, n), pa.array(counts, pa.int64()), *sets, lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_a", "set_b", "bands"])
    trim()


def _similar(batches, size: int, percent: int):
    """Of rows (a, b, text_a, text_b) the pairs with 100 * intersection >= percent * union."""

    def sets(ids, texts):
        """Distinct ids of a batch with their sets; a pivot's text is hashed once."""
        ids = np.asarray(ids)
        uniq, at, back = np.unique(ids, return_index=True, return_inverse=True)
        data, offs = string_parts(texts.take(pa.array(at)))
        out = []
        for x, y in slices(offs):
            doc, h = shingles(tokenise(data, offs[x : y + 1], lower=True), size)
            out += np.split(h, np.searchsorted(doc, np.arange(1, y - x)))
        return out, back

    for batch in batches:
        ends = np.cumsum(_lengths(batch.column(2)) + _lengths(batch.column(3)))
        for at, to in slices(np.concatenate([[0], ends]), 4 << 20):
            part = batch.slice(at, to - at)
            sa, ia = sets(part.column(0), part.column(2))
            sb, ib = sets(part.column(1), part.column(3))
            ok = []
            for i, j in zip(ia, ib, strict=True):
                x, y = sa[i], sb[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(np.array(ok, bool))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])
    trim()


def _lengths(col: pa.Array) -> np.ndarray:
    return np.diff(string_parts(col)[1])


def _tokens(batches, size: int):
    """The shingle hashes of each text, as (id, token) rows."""
    for batch in batches:
        data, offs = string_parts(batch.column(1))
        for a, b in slices(offs):
            doc, h = shingles(tokenise(data, offs[a : b + 1], lower=True), size)
            ids = batch.column(0).take(pa.array(doc + a))
            yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64))], ["id", "token"])
    trim()


def _prefix_pairs(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """All pairs of `open_` (id, c, n) in different components that can reach the similarity.

    With the tokens of each set ordered from the rarest, two similar sets share one among their first n - percent * n + 1,
    and after the first that they share enough tokens are left in both. So what keeps copies of a text apart, their own
    words, comes first, and pairs that differ too much never meet. Nor do members of one component: the components that
    share a token are paired first, then the members of the one with those of the other.
    """
    rows = texts.join(open_.select("id"), "id", "left_semi").select("id", "text")
    rows = written(rows.mapInArrow(partial(_tokens, size=size), "id long, token long"), "tokens")
    shared = rows.groupBy("token").count().where("count > 1")
    by_id = Window.partitionBy("id").orderBy("count", "token")
    place = F.row_number().over(by_id)
    shared_n = F.count("*").over(Window.partitionBy("id"))
    ranked = rows.join(shared, "token").select("id", "token", place.alias("k"), shared_n.alias("shared"))
    # tokens of one text alone come first in any order, so only their number matters
    ranked = ranked.join(open_, "id").select("id", "c", "n", "token", (F.col("n") - F.col("shared") + F.col("k")).alias("at"))
    ranked = written(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), "prefixes")
    ranked = ranked.withColumn("left", F.col("n") - F.col("at"))
    # of each component that has a token the range of sizes and the most tokens left: pairs that can't do are left out
    groups = ranked.groupBy("token", "c").agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("left").alias("left_hi")
    )

    def can(least_a: str, least_b: str, most_a: str, most_b: str, left_a: str, left_b: str):
        near = (F.col(most_a) * 100 >= F.col(least_b) * percent) & (F.col(most_b) * 100 >= F.col(least_a) * percent)
        enough = (1 + F.least(left_a, left_b)) * (100 + percent) >= percent * (F.col(least_a) + F.col(least_b))
        return near & enough

    a_side = lambda df: df.select("token", *[F.col(k).alias(f"{k}_a") for k in df.columns if k != "token"])
    apart = a_side(groups).join(groups, "token").where(
        (F.col("c_a") < F.col("c")) & can("n_lo_a", "n_lo", "n_hi_a", "n_hi", "left_hi_a", "left_hi")
    )
    both = a_side(ranked).join(apart.select("token", "c_a", "c"), ["token", "c_a"]).join(ranked, ["token", "c"])
    return both.where(can("n_a", "n", "n_a", "n", "left_a", "left")).select(F.col("id_a").alias("a"), F.col("id").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    rows: int = 6, miss: float = 1e-6,
) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| over their sets of `shingle`-word shingles
    (A-Z lower-cased). Null and empty texts, and texts without words, have an empty set and link with nothing.
    Ids are whole numbers, others raise an error. Repeated rows of an id count as one document, and of different texts under one id the least is compared; a null id
    links with nothing and is kept. Other columns of docs are ignored, whatever their names. Equal sets, by 128 bits of
    hash and their size, are joined first. In each bucket of the sketch bands the smallest id is then compared with all
    members, next another one with the members outside its component, and last the members of buckets that still span
    components by the rare words they share. So groups of copies never expand into all pairs, while no link between
    components is lost. Links are confirmed on the full sets of 64-bit shingle hashes.
    """
    bands = bands_for(percent / 100, rows, miss)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = partial(_sketches, size=shingle, rows=rows, bands=bands)
    table = written(given.mapInArrow(sketches, SKETCH_SCHEMA), "sketches")
    full = table.where("n_shingles > 0 and id is not null")
    sets = ["set_a", "set_b", "n_shingles"]
    reps = written(full.groupBy(*sets).agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "sets")
    members = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    members = written(members.join(shared, "bucket").select("bucket", "rep", "n", "lo"), "buckets")
    ids = written(members.select(F.col("rep").alias("id")).distinct(), "candidates")
    texts = written(join_small(given, ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")

    def fits(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        same = partial(_similar, size=shingle, percent=percent)
        return written(both.select("a", "b", "text_a", "text_b").mapInArrow(same, "a long, b long"), "links")

    first = members.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct()
    links = verified(written(first, "pairs"))
    done, comp = first, connected_components(links, "a", "b")
    for k in range(2):
        named = members.join(comp, F.col("rep") == F.col("node"), "left")
        named = named.select("bucket", "rep", "n", F.coalesce("component", "rep").alias("c"))
        mixed = named.groupBy("bucket").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"))
        mixed = mixed.where("c_lo < c_hi").select("bucket")
        named = written(named.join(mixed, "bucket", "left_semi"), "open")
        if named.isEmpty():
            break
        if k == 0:
            pivot = named.groupBy("bucket").agg(F.min_by(F.struct("rep", "c", "n"), F.xxhash64("rep")).alias("p"))
            pairs = named.join(pivot, "bucket").where((F.col("c") != F.col("p.c")) & fits("n", "p.n"))
            pairs = pairs.select(F.col("p.rep").alias("a"), F.col("rep").alias("b"))
        else:
            members_left = named.select(F.col("rep").alias("id"), "c", "n").distinct()
            pairs = _prefix_pairs(members_left, texts, shingle, percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done, links = done.union(pairs), links.union(verified(pairs))
        comp = connected_components(links, "a", "b")
    label = reps.join(comp, F.col("rep") == F.col("node"), "left").select(*sets, F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = table.join(label, sets, "left").select("id", "n_shingles", component.alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select("id", "n_shingles", "component_id", kept.alias("kept"))
