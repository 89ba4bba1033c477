"""Resampling towards a target distribution: hashed word runs, their gain in the target over the corpus, and a Gumbel draw.

Identical texts are collapsed first by grouping full texts: features and weight are worked out once a text, and counts
weigh by its copies. Weights are then joined back to the documents, whose noise comes from their own ids.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnquery.llm.hashing import NOT_ALNUM, Words, slices, string_parts, tokenise, trim
from tarnquery.llm.session import bound_batches, join_small, written

#: The table of CRC-32 by byte.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, np.uint32(0xEDB88320) ^ (CRC >> np.uint32(1)), CRC >> np.uint32(1)).astype(np.uint32)
#: Words of more bytes than this are summed one by one.
LONG = 48
#: A text of more than one in so many documents is hot: there are at most as many, so they are sent to all executors.
HOT = 1000


def _byte(c: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    return CRC[(c ^ b) & np.uint32(0xFF)] ^ (c >> np.uint32(8))


def _long(w: Words) -> np.ndarray:
    return np.flatnonzero(w.end - w.start > LONG)


def word_sums(w: Words) -> np.ndarray:
    """CRC-32 of each word, a byte of all words at a time."""
    out, size = np.full(len(w.start), 0xFFFFFFFF, np.uint32), w.end - w.start
    live, at = np.flatnonzero(size <= LONG), 0
    while len(live):
        out[live] = _byte(out[live], w.raw[w.start[live] + at])
        at += 1
        live = live[size[live] > at]
    out ^= np.uint32(0xFFFFFFFF)
    for k in _long(w):
        out[k] = zlib.crc32(w.raw[w.start[k] : w.end[k]])
    return out


def _shifted(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What sums become of as many zero bytes."""
    c, live, at = c.copy(), np.flatnonzero((by > 0) & (by <= LONG)), 0
    while len(live):
        c[live] = _byte(c[live])
        at += 1
        live = live[by[live] > at]
    return c


def run_sums(w: Words, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, CRC-32) of all runs of 1 to `longest` consecutive words joined by a space, repeats counted.

    The sum of a joined text is that of its second part exclusive-or the first part's, moved on by the second's length.
    """
    words, doc, size = word_sums(w), w.doc, w.end - w.start
    docs, sums, run = [doc], [words], words
    for k in range(1, longest):
        n = max(0, len(words) - k)
        spaced = ~_byte(~run[:n], 0x20)
        run = _shifted(spaced, size[k:]) ^ words[k:]
        one = doc[:n] == doc[k:]
        for i in _long(w):
            # a long last word: its run is summed from the text
            if i >= k and one[i - k]:
                said = b" ".join(w.raw[w.start[j] : w.end[j]].tobytes() for j in range(i - k, i + 1))
                run[i - k] = zlib.crc32(said)
        docs.append(doc[:n][one])
        sums.append(run[one])
    return np.concatenate(docs), np.concatenate(sums)


def _bucket_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _features(batches, longest: int, buckets: int):
    """Rows (digest, copies, text) as (digest, copies, n_words, n_features, data): data are the buckets of the features."""
    for batch in batches:
        data, offs = string_parts(batch.column(2))
        for a, b in slices(offs):
            w = tokenise(data, offs[a : b + 1], lower=True, separators=NOT_ALNUM)
            doc, sums = run_sums(w, longest)
            order = np.argsort(doc, kind="stable")
            found = (sums[order] % np.uint32(buckets)).astype(_bucket_type(buckets))
            counts = np.bincount(doc, minlength=b - a)
            edges = np.concatenate([[0], np.cumsum(counts)])
            packed = pa.array([found[edges[k] : edges[k + 1]].tobytes() for k in range(b - a)], pa.binary())
            part = batch.slice(a, b - a)
            rest = [pa.array(w.counts, pa.int64()), pa.array(counts, pa.int64()), packed]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *rest], ["digest", "copies", "n_words", "n_features", "data"])
    trim()


def _unpacked(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows of a batch, and where each row's begin and the last one's end."""
    kind = np.dtype(_bucket_type(buckets))
    sizes = np.array([len(x.as_buffer()) for x in column], np.int64) // kind.itemsize
    found = np.frombuffer(b"".join(x.as_buffer() for x in column), kind)
    return found, np.concatenate([[0], np.cumsum(sizes)])


def _bucket_counts(batches, buckets: int):
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        found, edges = _unpacked(batch.column(1), buckets)
        copies = np.repeat(batch.column(0).to_numpy(), np.diff(edges))
        # whole numbers, as sums of doubles would be off beyond 2^53
        order = np.argsort(found, kind="stable")
        at = np.flatnonzero(np.diff(found[order].astype(np.int64), prepend=-1))
        if len(at):
            total[found[order][at]] += np.add.reduceat(copies[order], at)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])


def _weights(batches, gains: np.ndarray):
    for batch in batches:
        found, edges = _unpacked(batch.column("data"), len(gains))
        sums = np.concatenate([[0], np.cumsum(gains[found])])
        n = np.diff(edges)
        weight = np.where(n > 0, (sums[edges[1:]] - sums[edges[:-1]]) // np.maximum(n, 1), 0)
        kept = [batch.column(c) for c in ("digest", "copies", "n_words", "n_features")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(weight, pa.int64())], ["digest", "copies", "n_words", "n_features", "weight"])


def text_features(docs: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """The different texts as (digest, copies, n_words, n_features, data), written."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("said")).groupBy("said").agg(F.count("*").alias("copies"))
    rows = texts.select(F.sha2("said", 256).alias("digest"), "copies", "said")
    kind = "digest string, copies long, n_words long, n_features long, data binary"
    return written(rows.mapInArrow(partial(_features, longest=longest, buckets=buckets), kind), "features")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all documents fall in each bucket: one number a bucket comes to the driver."""
    parts = features.select("copies", "data").mapInArrow(partial(_bucket_counts, buckets=buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Of each bucket the logarithm of its smoothed share in the target over that in the source, in thousandths, floored."""
    n = len(source)
    most, least = float(int(target.sum()) + n), float(int(source.sum()) + n)
    return np.array([math.floor(1000 * math.log(float(t + 1) * least / (float(s + 1) * most))) for t, s in zip(target.tolist(), source.tolist())], np.int64)


def noise(id_text: Column, seed: int) -> Column:
    """A floored Gumbel variate in thousandths, from the first 32 bits of a digest of seed and id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", longest: int = 2, buckets: int = 10_000,
    least_words: int = 20, percent: int = 25, seed: int = 7,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs: how target-like its text is, and its place in the draw.

    A text's weight is the floored mean gain of its features, 0 without any; its score adds noise by id. Of the rows of
    at least `least_words` words, the `percent` percent with the highest scores are drawn and numbered from 1; rank is
    null for others. Ties go to the smaller id, null ids last, then to fewer features; rows equal in all this are numbered
    in any order. Null texts count as empty. Ids may be of any type that orders; a null id counts as an empty text in the
    noise. Other columns aren't read, so none can clash. An empty table gives no rows; an empty target counts as an even one.

    The driver holds two numbers a bucket. A text's rows are never in one task: hot texts' weights are sent to all
    executors, at most HOT of them, others are joined by digest. Rows are ordered among those of equal score only; scores
    are whole numbers of a range that grows with the logarithm of the corpus, and noise spreads equal texts over them.
    """
    features = text_features(docs, text, longest, buckets)
    wanted = bucket_counts(text_features(target, text, longest, buckets), buckets)
    gain = gains(wanted, bucket_counts(features, buckets))
    kind = "digest string, copies long, n_words long, n_features long, weight long"
    weighed = written(features.mapInArrow(partial(_weights, gains=gain), kind), "weights")

    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    total = weighed.agg(F.sum("copies")).first()[0] or 0
    known = ("n_words", "n_features", "weight")
    hot = weighed.where(F.col("copies") * HOT > total).select("digest", F.struct(*known).alias("hot"))
    rest = weighed.where(F.col("copies") * HOT <= total).select(F.col("digest").alias("key"), F.struct(*known).alias("rest"))
    rows = written(rows.join(F.broadcast(hot), "digest", "left"), "digests")
    rest = rows.where(F.col("hot").isNull()).join(rest, F.col("digest") == F.col("key")).select("id", F.col("rest").alias("w"))
    rows = rows.where(F.col("hot").isNotNull()).select("id", F.col("hot").alias("w")).union(rest).select("id", "w.*")
    score = F.col("weight") + noise(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    scored = written(rows.select("id", "n_words", "n_features", "weight", score.alias("score")), "scored")

    fits = F.col("n_words") >= least_words
    by_score = scored.where(fits).groupBy("score").agg(F.count("*").alias("n"))
    sums = by_score.agg(F.sum("n")).first()[0] or 0
    drawn = percent * sums // 100
    above = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above"))
    above = written(above.where(F.col("above") < drawn), "above")
    within = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    marked = join_small(scored, above, "score", "left").withColumn("may", fits & F.col("above").isNotNull())
    placed = marked.where("may").withColumn("rank", (F.col("above") + F.row_number().over(within)).cast("long"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = marked.where(~F.col("may")).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).select("id", "n_features", "weight", "score", "rank")
