"""A search index in tables: postings by term with positions, in blocks with the most that a row of theirs can score."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnquery.operators.cells import slices
from tarnquery.operators.similarity import terms

#: Parameters of BM25; letters of a term that tell its folder; items of a block; blocks that set the bar for all others.
K1, B, HEAD, BLOCK, FIRST = 1.2, 0.75, 2, 4096, 16


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, len, term, at) of rows (id, t): the different words of each list, with their places."""
    for batch in batches:
        sizes = pc.list_value_length(batch["t"]).to_numpy(zero_copy_only=False).astype(np.int64)
        for rows in slices(sizes, 1 << 19):
            part, n = batch.slice(rows.start, rows.stop - rows.start), sizes[rows]
            words = part["t"].flatten().dictionary_encode()
            if not len(words):
                continue
            key = np.repeat(np.arange(len(n)), n) * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            item, word = np.divmod(key[starts], len(words.dictionary))
            places = (np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n))[order]
            at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(places, pa.int32()))
            columns = [part["id"].take(pa.array(item)), pa.array(n[item], pa.int32()), words.dictionary.take(pa.array(word)), at]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "len", "term", "at"])


class SearchIndex:
    """Folders below path: postings (head, term, id, block, tf, len, at), blocks (head, term, block, n, most), stats.

    Terms of a query are found through the folder of their first letters and, within its sorted files, by pushed
    filters, so a search reads the postings of its words only. A term's postings are as many rows as items hold it,
    dealt by range, so a common term fills no task.
    """

    def __init__(self, spark: SparkSession, path: str):
        stats = spark.read.parquet(f"{path}/stats")
        kind = stats.schema["no_id"].dataType.simpleString()
        read = lambda c, fields: spark.read.schema(f"term string, {fields}, head string").parquet(f"{path}/{c}")
        self.postings = read("postings", f"id {kind}, block int, tf long, len int, at array<int>")
        self.blocks = read("blocks", "block int, n long, most double")
        self.stats = stats.first()

    @classmethod
    def build(cls, items: DataFrame, path: str) -> SearchIndex:
        """Indexes items (id, text). Null texts have no terms, as do texts without letters or digits; ids are unique."""
        spark, kind = items.sparkSession, items.schema["id"].dataType.simpleString()
        split = items.select("id", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("t"))
        docs = items.count()
        blocks = max(1, docs // BLOCK)
        # an item's terms are grouped within its batch, so postings are dealt out once, as short rows
        rows = split.mapInArrow(_postings, f"id {kind}, len int, term string, at array<int>")
        ranged = rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
        ranged = ranged.select("term", "id", block, F.size("at").cast("long").alias("tf"), "len", "at", F.left("term", F.lit(HEAD)).alias("head"))
        ranged.write.partitionBy("head").parquet(f"{path}/postings")
        written = spark.read.schema(ranged.schema).parquet(f"{path}/postings")
        # every term of a text is in some posting, so texts needn't be split again for their mean length
        mean = F.coalesce(F.sum("tf") / F.lit(docs), F.lit(0.0)).alias("mean")
        stats = written.agg(F.lit(docs).cast("long").alias("docs"), mean, F.lit(None).cast(kind).alias("no_id"))
        stats.write.parquet(f"{path}/stats")
        known = spark.read.parquet(f"{path}/stats").first()
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(known["mean"] or 1.0)))
        held = written.groupBy("head", "term", "block").agg(F.count("*").alias("n"), F.max(weight).alias("most"))
        held.repartitionByRange("head", "term").sortWithinPartitions("head", "term").write.partitionBy("head").parquet(f"{path}/blocks")
        return cls(spark, path)

    def _of(self, table: DataFrame, words: Sequence[str]) -> DataFrame:
        return table.where(F.col("head").isin(*{w[:HEAD] for w in words}) & F.col("term").isin(*words))

    def _scores(self, postings: DataFrame, idf: dict[str, float]) -> DataFrame:
        """(id, score) of items that hold all the words."""
        factor = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])[F.col("term")]
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(self.stats["mean"] or 1.0)))
        by = postings.groupBy("id").agg(F.sum(factor * weight).alias("score"), F.count("*").alias("k"))
        return by.where(F.col("k") == len(idf)).select("id", "score")

    def top(self, words: Sequence[str], n: int = 50) -> DataFrame:
        """(id, score) of the n best items with all the words, ties by id.

        The blocks that may score best set a bar: the n-th best score in them. Then only blocks that can reach it are
        read. A word that no item holds leaves nothing.
        """
        words = sorted({w.lower() for w in words})
        held = self._of(self.blocks, words)
        df = {r.term: r.n for r in held.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        nothing = self._scores(self.postings.limit(0), {"": 0.0})
        if not words or len(df) < len(words):
            return nothing
        idf = {w: math.log((self.stats.docs - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in words}
        bound = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])[F.col("term")] * F.col("most")
        bounds = held.groupBy("block").agg(F.sum(bound).alias("bound"), F.count("*").alias("k")).where(F.col("k") == len(words))
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        if not first:
            return nothing
        postings = self._of(self.postings, words)
        seen = self._scores(postings.where(F.col("block").isin(*first)), idf).orderBy(F.desc("score")).limit(n).collect()
        bar = seen[-1].score - 1e-9 if len(seen) == n else 0.0
        hits = self._scores(postings.join(bounds.where(F.col("bound") >= bar).select("block"), "block"), idf)
        return hits.orderBy(F.desc(F.round("score", 9)), "id").limit(n)

    def phrase(self, words: Sequence[str]) -> DataFrame:
        """(id, n): items in which the words follow each other, and how often."""
        words = [w.lower() for w in words]

        def starts_of(k: int, word: str):
            return F.first(F.when(F.col("term") == word, F.transform("at", lambda p: p - k)), ignorenulls=True)

        starts = [starts_of(k, w) for k, w in enumerate(words)]
        by = self._of(self.postings, words).groupBy("id").agg(F.count("*").alias("k"), *[s.alias(f"s{k}") for k, s in enumerate(starts)])
        met = reduce(F.array_intersect, [F.col(f"s{k}") for k in range(len(words))])
        return by.where(F.col("k") == len(set(words))).select("id", F.size(met).alias("n")).where("n > 0")

    def prefix(self, start: str) -> DataFrame:
        """(term, df): the terms that start so, and how many items hold each."""
        start = start.lower()
        near = F.col("head") == start if len(start) == HEAD else F.col("head") == start[:HEAD] if len(start) > HEAD else F.col("head").startswith(start)
        return self.blocks.where(near & F.col("term").startswith(start)).groupBy("term").agg(F.sum("n").alias("df"))
