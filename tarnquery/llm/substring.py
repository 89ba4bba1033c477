"""Substring deduplication by fixed-block anchors.

A window of W words always holds one whole block of B = (W + 1) // 2 words whose start is a multiple of B in its
document. The blocks of all documents are indexed, and all rolling windows of B words probe them. A hit is extended to
both sides as far as any W-word window around it occurs elsewhere too, so that runs of such windows are the maximal
exact repeats. Extensions go over two independent hashes, 104 bits in all, as the other place is in another task.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from tarnquery.llm.exchange import CHUNK, bucket_edges, chunked, pack, pack_bits, rows_of, unpack, unpack_bits
from tarnquery.llm.hashing import SEEDS, U, Words, grams, slices, string_parts, tokenise, trim, word_hash

#: Anchors are hashed to so many bits; a false hit only costs an extension that comes to nothing.
ANCHOR_BITS = U(48)
#: Bytes of a window's second hash, beside 64 bits of the first.
CHECK_BYTES = 5
ANCHORS = "bucket int, chunk long, keys binary, blocks binary, many binary"
WINDOWS = "bucket int, chunk long, a binary, b binary, many binary"


def _words(rows: pa.Table, text: str):
    data, offs = string_parts(rows[text])
    for a, b in slices(offs):
        yield a, b, tokenise(data, offs[a : b + 1])


def _anchors(w: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each rolling window of block words, which are whole, and which of these are reference blocks."""
    g, ok = grams(w, block)
    place = np.arange(len(g)) - np.repeat(w.first[:-1], w.counts)[: len(g)]
    return g >> (U(64) - ANCHOR_BITS) << (U(64) - ANCHOR_BITS), ok, ok & (place % block == 0)


def _distinct_anchors(rows: pa.Table, text: str, block: int):
    """Sorted distinct anchors of a chunk: key, whether it is a block here, whether it occurs here more than once."""
    keys, blocks = [np.zeros(0, U)], [np.zeros(0, bool)]
    for _, _, w in _words(rows, text):
        g, ok, is_block = _anchors(w, block)
        keys.append(g[ok])
        blocks.append(is_block[ok])
    # the lowest bit, always 0 after the cut, carries the flag through the sort
    keys = np.concatenate(keys) | np.concatenate(blocks).astype(U)
    keys.sort()
    blocks, keys = (keys & U(1)).astype(bool), keys & ~U(1)
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, np.int64)
    if not len(new):
        return keys, blocks, blocks
    return keys[new], np.logical_or.reduceat(blocks, new), np.diff(new, append=len(keys)) > 1


def _sent(chunk: int, edges: np.ndarray, *columns) -> list[pa.Array]:
    """A row for each bucket that gets anything; columns pack the range of a bucket."""
    some = [(b, x, y) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
    fixed = [pa.array([b for b, _, _ in some], pa.int32()), pa.array([chunk] * len(some), pa.int64())]
    return fixed + [pa.array([f(v[x:y]) for _, x, y in some], pa.binary()) for f, v in columns]


def _send_anchors(chunk: pa.Table, text: str, block: int, buckets: int) -> pa.Table:
    keys, blocks, many = _distinct_anchors(rows_of(chunk), text, block)
    sent = (pack, keys), (pack_bits, blocks), (pack_bits, many)
    out = _sent(chunk[CHUNK][0].as_py(), bucket_edges(keys, buckets), *sent)
    trim()
    return pa.table(out, ["bucket", "chunk", "keys", "blocks", "many"])


def _match_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: the anchors that are a block anywhere and occur more than once in all, as bits for each chunk."""
    each = [unpack(k) for k in table["keys"].to_pylist()]
    sizes = [len(k) for k in each]
    flags = lambda name: np.concatenate([unpack_bits(x, n) for x, n in zip(table[name].to_pylist(), sizes, strict=True)])
    _, back, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    hit = (np.bincount(back, flags("blocks")) > 0) & ((counts > 1) | (np.bincount(back, flags("many")) > 0))
    parts = np.split(hit[back], np.cumsum(sizes)[:-1])
    some = [k for k, p in enumerate(parts) if p.any()]
    at = pa.array(some, pa.int64())
    hits = pa.array([pack_bits(parts[k]) for k in some], pa.binary())
    out = pa.table({"chunk": table["chunk"].take(at), "bucket": table["bucket"].take(at), "hits": hits})
    trim()
    return out


def _cut_bytes(h: np.ndarray) -> bytes:
    """The low CHECK_BYTES of each hash."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :CHECK_BYTES]).tobytes()


def _whole_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // CHECK_BYTES, 8), np.uint8)
    out[:, :CHECK_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, CHECK_BYTES)
    return out.view(U).reshape(-1)


def _second(w: Words, window: int) -> np.ndarray:
    """Of each window a hash that is independent of the first, word by word."""
    h = grams(w, window, word_hash(w.raw, w.start, w.end, SEEDS[1]))[0]
    return h & U((1 << 8 * CHECK_BYTES) - 1)


def _send_windows(left: pa.Table, right: pa.Table, text: str, block: int, window: int, buckets: int) -> pa.Table:
    """Two hashes of each window that holds a hit, as sorted distinct pairs of a chunk."""
    a, b = [np.zeros(0, U)], [np.zeros(0, U)]
    rows = rows_of(left) if right.num_rows else None
    keys = _distinct_anchors(rows, text, block)[0] if rows else a[0]
    edges = bucket_edges(keys, buckets)
    hits = np.zeros(len(keys), bool)
    for k, bits in zip(right["bucket"].to_pylist(), right["hits"].to_pylist(), strict=True):
        hits[edges[k] : edges[k + 1]] = unpack_bits(bits, edges[k + 1] - edges[k])
    hits = keys[hits]
    for _, _, w in _words(rows, text) if rows else ():
        g, ok, _ = _anchors(w, block)
        h, whole = grams(w, window)
        if not len(h):
            continue
        at = np.minimum(np.searchsorted(hits, g), len(hits) - 1)
        seen = np.concatenate([[0], np.cumsum(ok & (hits[at] == g))])
        near = (seen[window - block + 1 :][: len(h)] > seen[: len(h)]) & whole
        if near.any():
            a.append(h[near])
            b.append(_second(w, window)[near])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = np.flatnonzero(new)
    many = np.diff(new, append=len(a)) > 1
    a, b = a[new], b[new]
    out = _sent(left[CHUNK][0].as_py(), bucket_edges(a, buckets), (pack, a), (_cut_bytes, b), (pack_bits, many))
    trim()
    return pa.table(out, ["bucket", "chunk", "a", "b", "many"])


def _match_windows(table: pa.Table) -> pa.Table:
    """Of one bucket: the windows that start at more than one place, for each chunk that holds one."""
    each = [unpack(k) for k in table["a"].to_pylist()]
    sizes = [len(k) for k in each]
    a, b = np.concatenate(each), np.concatenate([_whole_bytes(x) for x in table["b"].to_pylist()])
    many = np.concatenate([unpack_bits(x, n) for x, n in zip(table["many"].to_pylist(), sizes, strict=True)])
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    new = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
    group = np.cumsum(new) - 1
    repeated = (np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0)
    found = np.zeros(len(a), bool)
    found[order] = repeated[group]
    ends = np.cumsum(sizes)
    some = [k for k in range(len(each)) if found[ends[k] - sizes[k] : ends[k]].any()]
    where = [np.flatnonzero(found[ends[k] - sizes[k] : ends[k]]) + ends[k] - sizes[k] for k in some]
    out = pa.table({
        "chunk": table["chunk"].take(pa.array(some, pa.int64())), "a": pa.array([pack(a[x]) for x in where], pa.binary()),
        "b": pa.array([_cut_bytes(b[x]) for x in where], pa.binary()),
    })
    trim()
    return out


def _repeats(w: Words, window: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first words of w's windows that are among the repeated ones, (a, b) sorted by both."""
    h, ok = grams(w, window)
    if not len(a) or not len(h):
        return np.zeros(0, np.int64)
    lo = np.searchsorted(a, h)
    start = np.flatnonzero(ok & (a[np.minimum(lo, len(a) - 1)] == h))
    if not len(start):
        return start
    lo, hi = lo[start], np.searchsorted(a, h[start], "right")
    second, found = _second(w, window)[start], np.zeros(len(start), bool)
    for k in range(int((hi - lo).max())):  # nearly always one round: windows of equal first and other second hash
        found |= (lo + k < hi) & (b[np.minimum(lo + k, len(b) - 1)] == second)
    return start[found]


def _extended(start: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows as maximal repeats: first words and ends of the runs of windows that overlap or touch as starts."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + window, -1)
    inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])


def _cut(left: pa.Table, right: pa.Table, text: str, window: int, digest: bool, schema: pa.Schema) -> pa.Table:
    """Documents of a chunk without the words of its repeats."""
    given = rows_of(left)
    a = np.concatenate([np.zeros(0, U), *map(unpack, right["a"].to_pylist())])
    b = np.concatenate([np.zeros(0, U), *map(_whole_bytes, right["b"].to_pylist())])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    texts, n_words, n_removed, digests = [], [], [], []
    for x, y, w in _words(given, text):
        drop = np.zeros(len(w.hash) + 1, np.int64)
        for at, step in zip(_extended(_repeats(w, window, a, b), window, len(w.hash)), (1, -1), strict=True):
            np.add.at(drop, at, step)
        drop = np.cumsum(drop)[:-1] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(drop)])[w.first])
        n_words += w.counts.tolist()
        n_removed += removed.tolist()
        raw = w.raw.tobytes()
        whole = given[text].slice(x, y - x).to_pylist() if not digest else []
        for k in range(y - x):
            i, j = w.first[k], w.first[k + 1]
            if not digest and not removed[k]:
                texts.append(whole[k])
                continue
            keep = np.arange(i, j)[~drop[i:j]]
            kept = b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
            if digest:
                digests.append(hashlib.sha256(kept).hexdigest())
            else:
                texts.append(kept.decode())
    out = {c: given[c] for c in given.column_names if c != text}
    out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
    out |= {"kept_sha256": pa.array(digests, pa.string())} if digest else {text: pa.array(texts, pa.string())}
    done = pa.table([out[f.name].cast(f.type) for f in schema], schema=schema)
    trim()
    return done


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, digest: bool = False
) -> DataFrame:
    """Removes each word covered by a window of `window` words whose sequence also starts anywhere else, in the input.

    Returns the rows of docs with n_words and n_removed. With digest, text_col gives way to kept_sha256 of the kept
    words joined by one space; else text_col holds that text where words went, and the given text elsewhere. Null texts
    have no words and stay null; columns named n_words, n_removed or kept_sha256 are replaced, others kept, whatever
    their names. Repeated rows and equal texts count as places of their own, so exact copies of `window` words or more
    lose all those words. Word sequences are equal if two independent hashes of 64 and 40 bits are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    block = (window + 1) // 2
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    chunks, buckets = chunked(docs, text_col)

    def send(key, table):
        return _send_anchors(table, text_col, block, buckets)

    def match(key, table):
        return _match_anchors(table)

    sent = chunks.groupBy(CHUNK).applyInArrow(send, ANCHORS)
    hits = sent.groupBy("bucket").applyInArrow(match, "chunk long, bucket int, hits binary")

    def send_windows(key, left, right):
        return _send_windows(left, right, text_col, block, window, buckets)

    def match_windows(key, table):
        return _match_windows(table)

    windows = chunks.groupBy(CHUNK).cogroup(hits.groupBy(CHUNK)).applyInArrow(send_windows, WINDOWS)
    repeats = windows.groupBy("bucket").applyInArrow(match_windows, "chunk long, a binary, b binary")
    schema = StructType([f for f in docs.schema if f.name != text_col or not digest])
    schema = schema.add("n_words", LongType()).add("n_removed", LongType())
    if digest:
        schema = schema.add("kept_sha256", StringType())
    cut = partial(_cut, text=text_col, window=window, digest=digest, schema=to_arrow_schema(schema))

    def finish(key, left, right):
        return cut(left, right)

    return chunks.groupBy(CHUNK).cogroup(repeats.groupBy(CHUNK)).applyInArrow(finish, schema)
