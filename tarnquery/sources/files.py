"""File sources and sinks of the repository: JSON stores, queues, error logs, URL lists, exports and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "id STRING, topic STRING, post_title STRING, key_knowledge_content STRING, infographic_summary STRING, source_link STRING, notes_applications STRING, extraction_date STRING, category STRING, course_references ARRAY<STRING>"
TASK = "id STRING, url STRING, priority STRING, status STRING, created_at STRING, started_at STRING, completed_at STRING, retry_count INT, max_retries INT, error_message STRING, result MAP<STRING,STRING>, metadata MAP<STRING,STRING>"
ERROR = "id STRING, error_type STRING, error_message STRING, severity STRING, occurred_at STRING, context MAP<STRING,STRING>, stack_trace STRING, recovery_action STRING, recovery_attempted BOOLEAN, recovery_successful BOOLEAN, retry_count INT, resolved_at STRING"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_repository(spark: SparkSession, path: str) -> DataFrame:
    """SRC1, SRC2: items of a JSON repository; missing fields get defaults. A corrupt file holds no items."""
    items = _json(spark, path, f"items ARRAY<STRUCT<{_struct(ITEM)}>>").select(F.explode("items").alias("i")).select("i.*")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("infographic_summary", "notes_applications")]
    courses = F.coalesce("course_references", F.array().cast("array<string>")).alias("course_references")
    plain = [c for c in items.columns if c not in ("infographic_summary", "notes_applications", "course_references", "extraction_date", "category")]
    return items.select(*plain, *texts, courses, F.try_to_timestamp("extraction_date").cast("timestamp_ntz").alias("extraction_date"), F.coalesce("category", F.lit("Other")).alias("category"))


def read_queue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC3: tasks of a queue file, and the entries that lack what a task needs."""
    tasks = _json(spark, path, f"tasks MAP<STRING, STRUCT<{_struct(TASK)}>>").select(F.explode("tasks").alias("key", "t")).select("key", "t.*")
    ok = F.col("id").isNotNull() & F.col("url").isNotNull()
    return tasks.where(ok).drop("key"), tasks.where(~ok)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: the records of an error log."""
    return _json(spark, path, f"error_records MAP<STRING, STRUCT<{_struct(ERROR)}>>").select(F.explode(F.map_values("error_records")).alias("e")).select("e.*")


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {k}" for n, k in (part.strip().split(" ", 1) for part in ddl.split(", ")))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: one URL for each line that isn't blank."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("url")).where("url <> ''")


def write_partitioned(items: DataFrame, path: str, by: list[str]) -> None:
    """A folder for each value of the columns in by, a few files each."""
    items.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_export(df: DataFrame, path: str, kind: str = "json") -> None:
    """json, csv or parquet; arrays become joined texts in csv."""
    if kind == "csv":
        df = df.select(*[F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: Column, keep_first: dict[str, Column] | None = None) -> DataFrame:
    """stored with the rows of new in place of those with the same keys; the last by order wins within new.

    keep_first gives columns that merge over all rows of a key instead, such as the first time it was seen.
    """
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys)
    last = both.withColumn("__rank", F.row_number().over(w.orderBy(F.desc("__new"), order.desc())))
    for name, merged in (keep_first or {}).items():
        last = last.withColumn(name, merged.over(w))
    return last.where("__rank = 1").drop("__rank", "__new")


def snapshot(tables: dict[str, DataFrame], path: str, when: str) -> DataFrame:
    """Writes the tables below path; returns and writes the manifest, a row for each."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, when, spark.read.parquet(f"{path}/{name}").count()))
    manifest = spark.createDataFrame(rows, "name string, at string, n long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {r.name: spark.read.parquet(f"{path}/{r.name}") for r in spark.read.json(f"{path}/manifest").collect()}
