"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman scores the copies.

All word n-grams of an item are its seeds, however common: which of them an edited copy keeps is not known beforehand.
Around each seed hit the document is aligned with the item word by word if enough of the item's words are there, so
edited and paraphrased copies score by how much of the item they keep.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnquery.llm.hashing import NOT_ALNUM, Words, grams, slices, string_parts, tokenise, trim
from tarnquery.llm.session import bound_batches

#: Bytes of items held by a task at once; a larger benchmark is worked through in blocks of that size.
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Pairs of a hit and an item that a task looks at together, unless one document alone has more.
EXPANDED = 1 << 20


@dataclass
class Items:
    """Items of a block: their words, and their n-grams as (gram, item, offset) sorted by gram."""

    ids: list
    words: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(ids: list, texts: list, n: int) -> Items:
        data, offs = string_parts(pa.array(texts, pa.string()))
        w = tokenise(data, offs, lower=True, separators=NOT_ALNUM)
        doc = w.doc
        parts = [(g[ok], doc[: len(g)][ok], np.flatnonzero(ok)) for g, ok in [grams(w, n)]]
        for k in range(1, n):  # items of fewer words are one gram
            few = np.flatnonzero(w.counts == k)
            parts.append((grams(w, k)[0][w.first[few]], few, w.first[few]))
        gram, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, item, at = gram[order], item[order], at[order]
        return Items(ids, np.split(w.hash, w.first[1:-1]), gram, item, at - w.first[item])


def _hits(w: Words, items: Items, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, first matching row of items) of each gram of the documents that some item has."""
    doc, found = w.doc, []
    short = np.array(sorted({len(x) for x in items.words if 0 < len(x) < n}), int)
    for size in (*short, n):
        g, ok = grams(w, int(size))
        if len(g) and len(items.gram):
            at = np.minimum(np.searchsorted(items.gram, g), len(items.gram) - 1)
            hit = np.flatnonzero(ok & (items.gram[at] == g))
            found.append((doc[hit], hit, at[hit]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment of the item in the text: score as a share of a full match, and the word after it in text."""
    best, end = 0, 0
    if not len(item) or not len(text):
        return 0.0, 0
    row, ramp = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1) * -GAP
    for word in item:
        new = np.zeros(len(text) + 1, np.int64)
        np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best / (MATCH * len(item)), end


def _blocks(sizes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of hits of at most about EXPANDED rows together, none ending within a document; ends: each one's last hits."""
    total, out, at = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    while at < len(sizes):
        to = np.searchsorted(total, total[at] + EXPANDED, "right") - 1
        fits = ends[(ends > at) & (ends <= max(to, at + 1))]
        to = int(fits[-1]) if len(fits) else int(ends[ends > at][0])
        out.append((at, to))
        at = to
    return out


def _aligned(w: Words, doc: np.ndarray, word: np.ndarray, rows: np.ndarray, items: Items, known: list, sizes: np.ndarray, threshold: float):
    """The best (score, end) of each (document, item) over the stretches of text around its hits."""
    item = items.item[rows]
    # an alignment that reaches the threshold has at most as many words more than the item as the item has
    slack = sizes[item]
    lo = np.maximum(word - items.offset[rows] - slack, w.first[doc])
    hi = np.minimum(word - items.offset[rows] + sizes[item] + slack, w.first[doc + 1])
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    key = doc * len(sizes) + item
    start, best = 0, {}
    while start < len(key):
        end, top = start + 1, hi[start]
        while end < len(key) and key[end] == key[start] and lo[end] <= top and top - lo[start] < 8 * sizes[item[start]]:
            top = max(top, hi[end])
            end += 1
        k, words = int(item[start]), w.hash[lo[start] : top]
        present = known[k][np.isin(known[k], words)]
        if np.isin(items.words[k], present).sum() >= threshold * sizes[k]:
            score, stop = align(items.words[k], words)
            if score >= threshold and score > best.get((int(doc[start]), k), (0, 0))[0]:
                best[int(doc[start]), k] = (score, int(lo[start] + stop - w.first[doc[start]]))
        start = end
    return best


def _leaks(batches, items: Items, n: int, threshold: float, item_type: pa.DataType):
    sizes = np.array([len(x) for x in items.words], np.int64)
    known = [np.unique(x) for x in items.words]
    for batch in batches:
        data, offs = string_parts(batch.column(1))
        out = ([], [], [], [])
        for a, b in slices(offs):
            w = tokenise(data, offs[a : b + 1], lower=True, separators=NOT_ALNUM)
            doc, word, at = _hits(w, items, n)
            order = np.argsort(doc, kind="stable")
            doc, word, at = doc[order], word[order], at[order]
            many = np.searchsorted(items.gram, items.gram[at], "right") - at  # every item that shares the gram
            ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
            for x, y in _blocks(many, ends) if len(doc) else ():
                m = many[x:y]
                rows = np.repeat(at[x:y], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                best = _aligned(w, np.repeat(doc[x:y], m), np.repeat(word[x:y], m), rows, items, known, sizes, threshold)
                for (d, k), (score, stop) in best.items():
                    for column, v in zip(out, (a + d, k, score, stop), strict=True):
                        column.append(v)
        ids = batch.column(0).take(pa.array(out[0], pa.int64()))
        found = pa.array([items.ids[k] for k in out[1]], item_type)
        columns = [ids, found, pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "end_word"])
    trim()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5
) -> DataFrame:
    """(doc_id, item_id, score, end_word) of each document that holds an item, or an edited copy of one.

    Words are runs of letters and digits, A-Z lower-cased. score is the best local alignment (2 a match, -1 a mismatch
    or gap) as a share of a full match; end_word is where that ends in the document. Items and texts that are null or
    without words never match; an item of fewer than n words is its own seed. A copy without a run of n words in common
    with the item is not found. Repeated rows of docs each give their rows, repeated items count once; other columns of
    either table are ignored, whatever their names. A benchmark beyond BLOCK_BYTES is worked through in blocks, each
    over all documents.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bound_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    bench = benchmark.where(F.length("text") > 0).select("item_id", "text").distinct()
    item_type = bench.schema["item_id"].dataType
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, item_id {item_type.simpleString()}, score double, end_word long"
    blocks = max(1, -(-(bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for block in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.orderBy("item_id", "text").collect()
        items = Items.of([r.item_id for r in rows], [r.text for r in rows], n)
        leaks = partial(_leaks, items=items, n=n, threshold=threshold, item_type=to_arrow_type(item_type))
        part = given.mapInArrow(leaks, schema)
        found = part if found is None else found.union(part)
    return found
