"""Vectorised tokenising and hashing of UTF-8 text in Arrow batches.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Words and runs of words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library keeps freed memory as it likes
    _libc = None
#: Bytes of text handled at once; a longer document is handled whole, on its own.
SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Every ASCII byte that is no letter or digit; bytes of other characters count as letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Multipliers of the hashes, and the seeds of two independent word hashes.
ODD, TWIST = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
SEEDS = (0xA0761D6478BD642F, 0x2545F4914F6CDD1D)
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64
BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def trim() -> None:
    """Gives freed memory back: workers are reused, so what one stage leaves behind would count against the next."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@dataclass
class Words:
    """Words of consecutive documents. hash, start and end are by word; first holds each document's first word and an end."""

    raw: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def string_parts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks() if text.num_chunks != 1 else text.chunk(0)
    text = pc.fill_null(text.cast(pa.large_string()), "")
    _, offs, data = text.buffers()
    offs = np.frombuffer(offs, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together, or of one document."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def tokenise(data: np.ndarray, offs: np.ndarray, lower: bool = False, separators: np.ndarray = SPACE) -> Words:
    raw = data[offs[0] : offs[-1]]
    raw, n = LOWER[raw] if lower else raw, len(raw)
    edge = (offs - offs[0]).astype(np.int64)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(raw, np.zeros(0, U), none, none, np.zeros(len(offs), np.int64))
    space = separators[raw]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[edge[:-1][edge[:-1] < n]] = True
    after[edge[1:][edge[1:] > 0] - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return Words(raw, word_hash(raw, start, end), start, end, np.searchsorted(start, edge))


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """64-bit hashes of the byte ranges: eight bytes at a time through a nonlinear mixer, long ones by BLAKE2."""
    size, eight = end - start, lanes(raw)
    h = mix(size.astype(U) * ODD + U(seed))
    h = mix(h ^ (eight[start] & BELOW[np.minimum(size, 8)]))
    at, live = 8, np.flatnonzero(size > 8)
    while len(live) and at < LONG_WORD:
        h[live] = mix(h[live] * TWIST ^ (eight[start[live] + at] & BELOW[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    key = seed.to_bytes(8, "little")
    for k in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(raw[start[k] : end[k]], digest_size=8, key=key).digest()
        h[k] = int.from_bytes(digest, "little")
    return h


def prefixes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of at least `size` bytes, and the hash of their first `size` bytes."""
    at = np.flatnonzero(w.end - w.start >= size)
    return at, word_hash(w.raw, w.start[at], w.start[at] + size)


def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of the sequence of two hashed parts."""
    return mix(x * TWIST + y)


def grams(w: Words, size: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words, by its first word, and which of them lie within one document.

    Runs of 1, 2, 4, ... words are joined from two halves, and those of the binary digits of size to one run.
    """
    part = w.hash if words is None else words
    n = len(part)
    if n < size:
        return np.zeros(0, U), np.zeros(0, bool)
    out, done, length = None, 0, 1
    while True:
        if size & length:
            m = n - done - length + 1
            out = part if out is None else join(out[:m], part[done : done + m])
            done += length
        if 2 * length > size:
            break
        part = join(part[:-length], part[length:])
        length *= 2
    last = np.repeat(w.first[1:], w.counts)
    return mix(out + U(size)), np.arange(size, n + 1) <= last[: n - size + 1]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (document, hash), sorted by both.

    A document of fewer words has its whole sequence as one; one without words none.
    """
    doc = w.doc
    g, ok = grams(w, size)
    at, h = doc[: len(g)][ok], g[ok]
    counts = w.counts
    for k in range(1, size):
        few = np.flatnonzero(counts == k)
        if len(few):
            whole, _ = grams(w, k)
            at, h = np.concatenate([at, few]), np.concatenate([h, whole[w.first[few]]])
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return at[new], h[new]
