"""The corpus pipeline: a list of stages over documents, each written and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnquery.llm.decontaminate import find_leaks
from tarnquery.llm.minhash import near_duplicates
from tarnquery.llm.mixing import mix_to_targets
from tarnquery.llm.session import join_small, written
from tarnquery.llm.substring import remove_repeats
from tarnquery.llm.toxicity import ToxicityModel

#: No SQL expresses a trained classifier, sketches and alignments; the stages are tested against brute force.
ORACLE_SQL = None


#: The columns of documents that stages work on; others only go along.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def aside(docs: DataFrame) -> DataFrame:
    """docs with other columns under names that no stage uses; the same plan where there are none."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in COLUMNS else f"__{k}") for k, c in enumerate(docs.columns)])


def back(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that aside put away, under their own names again."""
    return docs.select(*[F.col(c if c in COLUMNS else f"__{k}").alias(c) for k, c in enumerate(columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go. It learns from the labels of rows that aren't held out."""
    model = ToxicityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(model.score(aside(docs)).where(F.col("score") < 0.5), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    found = near_duplicates(docs, shingle=5, percent=80)
    drop = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    return join_small(docs, drop, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur more than once go; texts without any stay as they are."""
    found = remove_repeats(aside(docs), window=35)
    cut = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    names = aside(docs).columns
    return back(found.select(*[cut if c == "n_chars" else F.col(c) for c in names]), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    leaks = written(find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct(), "leaks")
    return join_small(docs, leaks, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words and so how often."""
    return mix_to_targets(docs).where(F.col("taken") > 0)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("source_mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
