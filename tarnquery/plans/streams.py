"""Streaming queries, run over the event log with a file source until all that is there has been read; and file round trips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnquery.operators import tasks
from tarnquery.plans.registry import query, table
from tarnquery.plans.repository import ITEMS, items
from tarnquery.plans.rules import _STATE_SQL, TRANSITIONS_SQL
from tarnquery.sources import files
from tarnquery.sources.shared import new_folder
from tarnquery.streaming import events as E
from tarnquery.streaming import timers


def stream(spark, sf_dir):
    return E.event_stream(spark, f"{sf_dir}/events.parquet")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS since, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf_dir):
    """STR8, STR14: counts by hour and type, kept up to date; windows older than the watermark leave the state."""
    counts = E.windowed_counts(stream(spark, sf_dir))
    return E.run_to_table(counts, new_folder(spark, "counts"), "update", ("since", "event_type")).withColumn("since", stamp("since"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_process_once(spark, sf_dir):
    """STR11: each key once."""
    return E.run_to_table(E.process_once(stream(spark, sf_dir), ["user_id", "event_type"]), new_folder(spark, "once"), "append")


@query("""
    WITH s AS (SELECT user_id, event_id, ts, value >= 20 AS firing FROM events), l AS (SELECT *, lag(firing) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s)
    SELECT user_id, event_id, CASE WHEN firing THEN 'fired' ELSE 'resolved' END AS change FROM l WHERE firing <> coalesce(was, false)
""")
def stream_alerts(spark, sf_dir):
    """STR6: stateful alerts, the same as the batch query's."""
    return E.fold_to_table(stream(spark, sf_dir), new_folder(spark, "alerts"), E.alert_step)


@query(TRANSITIONS_SQL)
def stream_task_states(spark, sf_dir):
    """STR9, STR12: tasks through their states as events arrive, failures retried after a growing delay; the same as
    the batch query's."""
    return E.fold_to_table(stream(spark, sf_dir), new_folder(spark, "tasks"), E.task_step)


#: What a stream has given out: all that is due by its watermark, an hour behind the last event.
BY_WATERMARK = "us <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events)"


def by_watermark(rows, events, late: int = 3600):
    """Rows (us, ...) that a stream of these events has given out."""
    until = events.agg((F.floor(F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 1000) * 1000 - late * timers.SECOND).alias("until"))
    return rows.join(F.broadcast(until), F.col("us") <= F.col("until")).drop("until")


RETRIES_SQL = f"""
    WITH s AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, {_STATE_SQL} AS state FROM events),
    w AS (SELECT *, CAST(count(*) FILTER (state = 'failed') OVER u AS BIGINT) AS attempts, lead(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next
        FROM s WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    t AS (SELECT *, CASE WHEN state = 'failed' AND attempts <= 3 THEN us + CAST(least(pow(2, attempts), 60) AS BIGINT) * 1000000 END AS due FROM w),
    r AS (SELECT user_id, event_id, us, CASE WHEN due IS NULL THEN state ELSE 'retrying' END AS to_state, attempts, 1 AS k FROM t
        UNION ALL SELECT user_id, NULL, due, 'queued', attempts, 0 FROM t WHERE due IS NOT NULL AND coalesce(next >= due, true)),
    c AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY user_id ORDER BY us, k, event_id), 'new') AS from_state FROM r)
    SELECT user_id, event_id, us, from_state, to_state, attempts FROM c WHERE {BY_WATERMARK}
"""


@query(RETRIES_SQL)
def task_retries(spark, sf_dir):
    """STR9, STR12, PIP8: tasks through their states, and those that come back by themselves after their delay."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return by_watermark(tasks.with_retries(tasks.task_states(e)), e)


@query(RETRIES_SQL)
def stream_task_retries(spark, sf_dir):
    """STR9, STR12, PIP8: the same as a stream: a timer in the state starts each retry, rows are put in order by event time."""
    rows = stream(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id", tasks.state_of(F.col("event_type")).alias("state"))
    found = timers.timed(rows, timers.TaskTimers(), "event_id long, us long, from_state string, to_state string, attempts long")
    with timers.timers_kept(spark):
        return E.run_to_table(found, new_folder(spark, "retries"), "append").withColumnRenamed("key", "user_id")


#: Alerts that hold: of which readings, which of them are bad, and for how long in seconds.
HOLD_RULES = (("queue", "click", ">", 60.0, 900), ("disk", "view", "<", 10.0, 900))


def _hold_sql(name: str, kind: str, sign: str, limit: float, hold: int) -> str:
    return f"""SELECT '{name}' AS alert, user_id, us, change FROM (
        WITH r AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, coalesce(value {sign} {limit}, false) AS bad FROM events WHERE event_type = '{kind}'),
        l AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM r),
        c AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS broke FROM l WHERE bad <> was),
        f AS (SELECT * FROM c WHERE bad AND coalesce(broke >= us + {hold}000000, true))
        SELECT user_id, us + {hold}000000 AS us, 'fired' AS change FROM f UNION ALL SELECT user_id, broke, 'resolved' FROM f WHERE broke IS NOT NULL
    ) WHERE us <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events WHERE event_type = '{kind}')"""


HOLD_SQL = " UNION ALL ".join(_hold_sql(*rule) for rule in HOLD_RULES)


def readings(events, kind: str, sign: str, limit: float):
    bad = F.col("value") > limit if sign == ">" else F.col("value") < limit
    return events.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), "ts", "event_id", F.coalesce(bad, F.lit(False)).alias("bad"))


@query(HOLD_SQL)
def hold_alerts(spark, sf_dir):
    """STR3, STR5: alerts that fire once readings of a queue or a disk have been bad for a quarter of an hour, and resolve."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = []
    for name, kind, sign, limit, hold in HOLD_RULES:
        rows = readings(e, kind, sign, limit)
        parts.append(by_watermark(tasks.held(rows, hold), rows).select(F.lit(name).alias("alert"), F.col("key").alias("user_id"), "us", "change"))
    return parts[0].unionByName(parts[1])


@query(HOLD_SQL)
def stream_hold_alerts(spark, sf_dir):
    """STR3, STR5: the same as streams: an alert is pending in the state until its timer fires it or a reading breaks it."""
    parts = []
    for name, kind, sign, limit, hold in HOLD_RULES:
        found = timers.timed(readings(stream(spark, sf_dir), kind, sign, limit), timers.HoldAlerts(hold), "us long, change string")
        with timers.timers_kept(spark):
            done = E.run_to_table(found, new_folder(spark, f"held-{name}"), "append")
        parts.append(done.select(F.lit(name).alias("alert"), F.col("key").alias("user_id"), "us", "change"))
    return parts[0].unionByName(parts[1])


@query("""
    WITH r AS (SELECT user_id, event_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    i AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END AS more FROM r)
    SELECT user_id, event_id, round(sum(more) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) / 86400.0, 9) AS per_second FROM i
""")
def counter_rate_resets(spark, sf_dir):
    """STR3, STR7, WIN9: growth by second of a counter over the last day; a reading below the one before means that it began anew at 0."""
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").withColumns({"before": F.lag("value").over(w.orderBy("ts", "event_id")), "us": F.unix_micros(F.col("ts").cast("timestamp"))})
    more = F.when(F.col("before").isNull(), 0.0).when(F.col("value") >= F.col("before"), F.col("value") - F.col("before")).otherwise(F.col("value"))
    day = F.sum("more").over(w.orderBy("us").rangeBetween(-86400 * timers.SECOND, 0))
    return r.withColumn("more", more).select("user_id", "event_id", F.round(day / 86400.0, 9).alias("per_second"))


@query("""
    WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark, sf_dir):
    """Session windows of users, a batch run of the streaming plan: as a stream the last sessions would still be open."""
    return E.sessions(table(spark, sf_dir, "events")).withColumn("since", stamp("since"))


@query("SELECT page_id, url FROM pages WHERE trim(url) <> ''")
def url_list_source(spark, sf_dir):
    """SRC5: URLs by line, written and read back."""
    path = new_folder(spark, "urls")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pages.select(F.concat(F.lit("  "), "url", F.lit(" \n"))).write.text(path)
    return files.read_urls(spark, path).distinct().join(pages, "url").select("page_id", "url")


@query(f"WITH {ITEMS} SELECT category, topic, id, array_to_string(courses, ', ') AS courses FROM items")
def repository_round_trip(spark, sf_dir):
    """SNK1, SNK4, SNK5, SNK7, SRC2: items written by category and topic, and read back."""
    path = new_folder(spark, "repository")
    files.write_partitioned(items(spark, sf_dir).select("id", "courses", "category", "topic"), path, ["category", "topic"])
    return spark.read.parquet(path).select("category", "topic", "id", F.array_join("courses", ", ").alias("courses"))


@query("""
    WITH o AS (SELECT user_id, min(ts) AS first_seen, max(value) AS v, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY user_id), w AS (SELECT user_id, min(ts) AS first_seen, max(value) AS v, count(*) AS n FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY user_id)
    SELECT coalesce(w.user_id, o.user_id) AS user_id, strftime(least(coalesce(w.first_seen, o.first_seen), coalesce(o.first_seen, w.first_seen)), '%Y-%m-%d %H:%M:%S') AS first_seen, coalesce(w.v, o.v) AS v, CAST(coalesce(o.n, 0) + coalesce(w.n, 0) AS BIGINT) AS n FROM o FULL JOIN w ON o.user_id = w.user_id
""")
def upsert_merge(spark, sf_dir):
    """SNK2: an upsert that keeps the first time a key was seen and adds up its accesses."""
    e = table(spark, sf_dir, "events")
    by = lambda df: df.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("value").alias("v"), F.count("*").alias("n"))
    merged = files.upsert(by(e.where("event_id % 2 = 0")), by(e.where("event_id % 2 = 1 AND user_id % 3 = 0")), ["user_id"], F.col("v"), {"first_seen": F.min("first_seen"), "n": F.sum("n")})
    return merged.select("user_id", stamp("first_seen").alias("first_seen"), "v", "n")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels")
def backup_manifest(spark, sf_dir):
    """SNK6, SNK19: a snapshot with its manifest, restored."""
    path = new_folder(spark, "backup")
    files.snapshot({"documents": table(spark, sf_dir, "documents").select("doc_id"), "labels": table(spark, sf_dir, "labels")}, path, "2024-01-31")
    one = lambda n, df: df.agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    back = files.restore(spark, path)
    return one("documents", back["documents"]).union(one("labels", back["labels"]))


#: Rows of one JSON store.
STORE = 1000


def write_stores(rows, key: str, collected, name: str, path: str) -> None:
    """JSON stores of up to STORE consecutive keys each, a file for each; a store holds `collected` under a name."""
    stores = rows.groupBy(F.floor(F.col(key) / STORE)).agg(F.to_json(F.struct(collected.alias(name))).alias("value"))
    stores.select("value").write.option("maxRecordsPerFile", 1).text(path)


def by_id(record):
    return F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), record)))


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id, lang AS topic, CASE WHEN doc_id % 5 = 0 THEN 'Other' ELSE coalesce(source, 'Other') END AS category,
        text AS content, '' AS notes, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS courses FROM documents
""")
def repository_store(spark, sf_dir):
    """SRC1, SRC2: items in JSON stores, some without category or courses, loaded with defaults for what is missing."""
    path, even = new_folder(spark, "stores"), F.col("doc_id") % 2 == 0
    item = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("topic"), F.col("text").alias("key_knowledge_content"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("category"), F.when(even, F.array(F.lit("c"))).alias("course_references"),
    )
    write_stores(table(spark, sf_dir, "documents"), "doc_id", F.collect_list(item), "items", path)
    return files.read_repository(spark, path).select(
        "id", "topic", "category", F.col("key_knowledge_content").alias("content"), F.col("notes_applications").alias("notes"),
        F.size("course_references").alias("courses"),
    )


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS status, CAST(event_id % 4 AS INTEGER) AS retries, event_id % 10 = 0 AS broken FROM events")
def queue_store(spark, sf_dir):
    """SRC3: tasks in queue files; those without a URL are told apart and the rest is loaded."""
    path = new_folder(spark, "queues")
    url = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    task = F.struct(
        F.col("event_id").cast("string").alias("id"), url.alias("url"), F.col("event_type").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"),
    )
    write_stores(table(spark, sf_dir, "events"), "event_id", by_id(task), "tasks", path)
    ok, broken = (t.select("id", "status", F.col("retry_count").alias("retries")) for t in files.read_queue(spark, path))
    return ok.withColumn("broken", F.lit(False)).union(broken.withColumn("broken", F.lit(True)))


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CASE WHEN value >= 20 THEN 'high' ELSE 'low' END AS severity, event_id % 3 = 0 AS attempted FROM events")
def error_store(spark, sf_dir):
    """SRC4: the records of error logs."""
    path = new_folder(spark, "errors")
    record = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("error_type"),
        F.when(F.col("value") >= 20, "high").otherwise("low").alias("severity"), (F.col("event_id") % 3 == 0).alias("recovery_attempted"),
    )
    write_stores(table(spark, sf_dir, "events"), "event_id", by_id(record), "error_records", path)
    return files.read_errors(spark, path).select("id", F.col("error_type").alias("kind"), "severity", F.col("recovery_attempted").alias("attempted"))
