"""Queries for rules of operation: retention, monitoring checks, rates and limits, task transitions, full statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnquery.operators import tasks
from tarnquery.operators.containment import contained
from tarnquery.operators.similarity import similarity, word_set
from tarnquery.plans.operations import AS_OF, ERRORS, errors, events, stamp
from tarnquery.plans.registry import query, table
from tarnquery.sources.shared import new_folder

NOW_SQL = f"TIMESTAMP '{AS_OF}'"


def ago(amount: int, unit: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '{amount}' {unit}")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('purchase', 'error', 'signup')")
def task_retention(spark, sf_dir):
    """FLT16: tasks that are completed, failed or cancelled go."""
    return events(spark, sf_dir).where(~F.col("event_type").isin("purchase", "error", "signup")).select("event_id", "event_type")


@query(f"""
    WITH c AS (SELECT user_id, max(ts) AS last_used, count(*) AS uses FROM events GROUP BY user_id),
    waiting AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND ts >= {NOW_SQL} - INTERVAL 10 DAY)
    SELECT user_id, uses, last_used < {NOW_SQL} - INTERVAL 2 DAY AND uses < 12 AS content_goes,
        last_used < {NOW_SQL} - INTERVAL 1 DAY AND user_id NOT IN (SELECT user_id FROM waiting) AS url_goes FROM c
""")
def cache_retention(spark, sf_dir):
    """FLT12: old content that was seldom used goes, and old addresses that no waiting task needs."""
    e = events(spark, sf_dir)
    c = e.groupBy("user_id").agg(F.max("ts").alias("last_used"), F.count("*").alias("uses"))
    waiting = e.where((F.col("event_type") == "signup") & (F.col("ts") >= ago(10, "DAY"))).select("user_id").distinct()
    c = c.join(waiting.withColumn("waits", F.lit(True)), "user_id", "left")
    old = F.col("last_used")
    return c.select(
        "user_id", "uses", ((old < ago(2, "DAY")) & (F.col("uses") < 12)).alias("content_goes"),
        ((old < ago(1, "DAY")) & F.col("waits").isNull()).alias("url_goes"),
    )


@query(f"""
    SELECT event_type, count(*) AS files, count(*) FILTER (
        event_type = 'view' AND ts < {NOW_SQL} - INTERVAL 7 DAY OR event_type = 'click' AND ts < {NOW_SQL} - INTERVAL 14 DAY) AS removed
    FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type
""")
def file_retention(spark, sf_dir):
    """FLT13: temporary files older than N days go, backups only when older than 2 N days."""
    kind = F.col("event_type")
    goes = ((kind == "view") & (F.col("ts") < ago(7, "DAY"))) | ((kind == "click") & (F.col("ts") < ago(14, "DAY")))
    files = events(spark, sf_dir).where(kind.isin("view", "click"))
    return files.groupBy("event_type").agg(F.count("*").alias("files"), F.count_if(goes).alias("removed"))


@query(f"WITH {ERRORS} SELECT event_id, severity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM r WHERE ts >= {NOW_SQL} - INTERVAL 48 HOUR")
def alert_history(spark, sf_dir):
    """FLT15: alerts of the last hours."""
    return errors(spark, sf_dir).where(F.col("ts") >= ago(48, "HOUR")).select("event_id", "severity", stamp().alias("at"))


#: Metrics of a day, and where each becomes a warning and critical. The disk's share is of what is free: less is worse.
CHECKS = (
    ("cpu", "avg(value)", 15.0, 25.0), ("memory", "max(value)", 150.0, 250.0), ("disk_used", "100 - min(value)", 90.0, 99.9),
    ("response_time", "avg(CASE WHEN event_type = 'click' THEN value END)", 15.0, 25.0),
    ("error_rate", "1.0 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*)", 0.05, 0.15),
    ("pii_rate", "1.0 * sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) / count(*)", 0.1, 0.3),
    ("queue", "1.0 * sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)", 50.0, 100.0),
)


@query(f"""
    WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e, _, _ in CHECKS)} FROM events GROUP BY ALL),
    m AS (UNPIVOT d ON {', '.join(n for n, *_ in CHECKS)} INTO NAME metric VALUE v),
    t(metric, warn, critical) AS (VALUES {', '.join(f"('{n}', {w}, {c})" for n, _, w, c in CHECKS)})
    SELECT day, m.metric AS metric, round(v, 6) AS value, CASE WHEN v >= critical THEN 'critical' ELSE 'warning' END AS level
    FROM m JOIN t ON m.metric = t.metric WHERE v >= warn
""")
def monitor_checks(spark, sf_dir):
    """MON1: seven metrics of each day against their thresholds; those that cross one are alerts."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    d = events(spark, sf_dir).groupBy(day).agg(*[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e, _, _ in CHECKS])
    m = d.unpivot("day", [n for n, *_ in CHECKS], "metric", "v")
    limits = F.create_map(*[x for n, _, w, c in CHECKS for x in (F.lit(n), F.struct(F.lit(w).alias("warn"), F.lit(c).alias("critical")))])
    m = m.withColumn("limit", limits[F.col("metric")]).where("v >= limit.warn")
    level = F.when(F.col("v") >= F.col("limit.critical"), "critical").otherwise("warning")
    return m.select("day", "metric", F.round("v", 6).alias("value"), level.alias("level"))


@query("""
    WITH e AS (SELECT epoch(time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01')) AS w, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL),
    r AS (SELECT w, sum(errors) OVER (ORDER BY w RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW) / 3600.0 > 0.0006 AS bad FROM e),
    g AS (SELECT w, bad, row_number() OVER (ORDER BY w) - row_number() OVER (PARTITION BY bad ORDER BY w) AS grp FROM r)
    SELECT CAST(min(w) AS BIGINT) AS since, CAST(max(w) AS BIGINT) AS until FROM g WHERE bad GROUP BY grp HAVING max(w) - min(w) >= 600
""")
def rate_alerts(spark, sf_dir):
    """STR3: the error rate of the last hour, in steps of ten minutes, above a threshold for at least so long.

    Windows are over steps of time that hold anything, one row each however many events there are.
    """
    step = F.unix_timestamp(F.window("ts", "10 minutes")["start"].cast("timestamp")).alias("w")
    e = events(spark, sf_dir).groupBy(step).agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    hour = Window.orderBy("w").rangeBetween(-3000, 0)
    r = e.select("w", (F.sum("errors").over(hour) / 3600.0 > 0.0006).alias("bad"))
    island = F.row_number().over(Window.orderBy("w")) - F.row_number().over(Window.partitionBy("bad").orderBy("w"))
    found = r.withColumn("grp", island).where("bad").groupBy("grp").agg(F.min("w").alias("since"), F.max("w").alias("until"))
    return found.where("until - since >= 600").select("since", "until")


@query("""
    WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
    w AS (SELECT event_id, user_id, t, count(*) OVER m AS in_minute, min(t) OVER m AS first_m, count(*) OVER d AS in_day, min(t) OVER d AS first_d FROM e
        WINDOW m AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
    SELECT event_id, user_id, in_minute, in_day,
        round(greatest(CASE WHEN in_minute >= 2 THEN 60 - (t - first_m) / 1000000.0 ELSE 0 END, CASE WHEN in_day >= 3 THEN 86400 - (t - first_d) / 1000000.0 ELSE 0 END), 3) AS wait_s FROM w
""")
def rate_limit_wait(spark, sf_dir):
    """STR1: requests of the last minute and of the last day, and how long the next one has to wait."""
    e = events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    back = lambda s: Window.partitionBy("user_id").orderBy("t").rangeBetween(-s * 1_000_000, 0)
    minute, day = back(60), back(86400)
    e = e.select(
        "event_id", "user_id", "t", F.count("*").over(minute).alias("in_minute"), F.min("t").over(minute).alias("first_m"),
        F.count("*").over(day).alias("in_day"), F.min("t").over(day).alias("first_d"),
    )

    def wait(n: str, most: int, first: str, seconds: int) -> Column:
        return F.when(F.col(n) >= most, seconds - (F.col("t") - F.col(first)) / 1_000_000.0).otherwise(0.0)

    longest = F.greatest(wait("in_minute", 2, "first_m", 60), wait("in_day", 3, "first_d", 86400))
    return e.select("event_id", "user_id", "in_minute", "in_day", F.round(longest, 3).alias("wait_s"))


_STATE_SQL = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"


TRANSITIONS_SQL = f"""
    WITH s AS (SELECT event_id, user_id, ts, {_STATE_SQL} AS state FROM events),
    w AS (SELECT *, lag(state) OVER u AS before, CAST(sum(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) OVER u AS BIGINT) AS attempts FROM s WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, coalesce(before, 'new') AS from_state, CASE WHEN state = 'failed' AND attempts <= 3 THEN 'retrying' ELSE state END AS to_state, attempts,
        CASE WHEN state = 'failed' AND attempts <= 3 THEN least(CAST(power(2, attempts) AS BIGINT), 60) END AS retry_after_s,
        coalesce(before, 'new') NOT IN ('completed') OR state = 'queued' AS allowed FROM w
"""


@query(TRANSITIONS_SQL)
def task_transitions(spark, sf_dir):
    """PIP6, PIP8, STR9, STR12 in batch form: each event of a task as a change of state, failures retried after a growing delay
    while attempts last, and whether the change is allowed: a completed task only queues again."""
    return tasks.task_changes(tasks.task_states(events(spark, sf_dir)))


@query(f"""
    WITH {ERRORS} SELECT 'all' AS scope, 'total' AS name, count(*) AS n FROM r
    UNION ALL SELECT 'all', 'last_day', count(*) FROM r WHERE ts >= {NOW_SQL} - INTERVAL 24 HOUR
    UNION ALL SELECT 'all', 'last_hour', count(*) FROM r WHERE ts >= {NOW_SQL} - INTERVAL 1 HOUR
    UNION ALL SELECT 'type', error_type, count(*) FROM r GROUP BY error_type
    UNION ALL SELECT 'severity', severity, count(*) FROM r GROUP BY severity
""")
def error_stats_by(spark, sf_dir):
    """AGG13: errors in all, of the last day and hour, by type and by severity, in one pass."""
    e = errors(spark, sf_dir)
    since = lambda unit, n: (F.col("ts") >= ago(n, unit)).alias(f"in_{unit}")
    groups = e.select("error_type", "severity", since("DAY", 1), since("HOUR", 1))
    groups = groups.groupingSets([[], ["error_type"], ["severity"]], "error_type", "severity")
    by = groups.agg(F.count("*").alias("n"), F.count_if("in_DAY").alias("day"), F.count_if("in_HOUR").alias("hour"), F.grouping_id().alias("g"))
    one = F.when(F.col("g") == 1, F.array(F.struct(F.lit("type").alias("scope"), F.col("error_type").alias("name"), F.col("n"))))
    one = one.when(F.col("g") == 2, F.array(F.struct(F.lit("severity").alias("scope"), F.col("severity").alias("name"), F.col("n"))))
    whole = [F.struct(F.lit("all").alias("scope"), F.lit(n).alias("name"), F.col(c).alias("n")) for n, c in (("total", "n"), ("last_day", "day"), ("last_hour", "hour"))]
    return by.select(F.explode(one.otherwise(F.array(*whole))).alias("x")).select("x.*")


@query("""
    WITH s AS (SELECT CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'cached' ELSE 'failed' END AS status, count(*) AS n
        FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY ALL)
    SELECT status, n, round(100.0 * n / sum(n) OVER (), 6) AS percent, round(100.0 * sum(n) FILTER (status = 'cached') OVER () / greatest(sum(n) OVER (), 1), 6) AS hit_rate FROM s
""")
def cache_status(spark, sf_dir):
    """AGG10: entries by status, and the hit rate: the share of entries that are cached."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    q = F.col("quality")
    status = F.when(q.isNull(), "pending").when(q == 1, "cached").otherwise("failed").alias("status")
    s = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").groupBy(status).agg(F.count("*").alias("n"))
    whole = s.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("status") == "cached", F.col("n")).otherwise(0)).alias("hits"))
    share = lambda c: F.round(100.0 * F.col(c) / F.greatest("total", F.lit(1)), 6)
    return s.crossJoin(F.broadcast(whole)).select("status", "n", share("n").alias("percent"), share("hits").alias("hit_rate"))


@query("""
    WITH t AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), top AS (SELECT 'topic' AS part, lang AS name, n, row_number() OVER (ORDER BY n DESC, lang) AS rank FROM t),
    latest AS (SELECT 'latest' AS part, source AS name, doc_id AS n, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM documents)
    SELECT part, name, n, rank FROM top WHERE rank <= 5 UNION ALL SELECT part, name, n, rank FROM latest WHERE rank <= 5
    UNION ALL SELECT 'categories', 'all', count(DISTINCT source), 1 FROM documents
    UNION ALL SELECT 'mode', source, n, 1 FROM (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 1)
""")
def executive_summary(spark, sf_dir):
    """AGG26: the five most common topics, the five latest items, how many categories, and the most common one."""
    d = table(spark, sf_dir, "documents")

    def ranked(df: DataFrame, part: str, name: str) -> DataFrame:
        # at most five rows are left to number
        rank = F.row_number().over(Window.orderBy(F.desc("n"), name)).cast("long")
        return df.select(F.lit(part).alias("part"), F.col(name).alias("name"), "n", rank.alias("rank"))

    by = lambda c: d.groupBy(c).agg(F.count("*").alias("n"))
    top = ranked(by("lang").orderBy(F.desc("n"), "lang").limit(5), "topic", "lang")
    latest = ranked(d.select("source", F.col("doc_id").alias("n")).orderBy(F.desc("n")).limit(5), "latest", "source")
    mode = ranked(by("source").orderBy(F.desc("n"), "source").limit(1), "mode", "source")
    count = d.agg(F.count_distinct("source").alias("n")).select(F.lit("categories").alias("part"), F.lit("all").alias("name"), "n", F.lit(1).cast("long").alias("rank"))
    return top.union(latest).union(mode).union(count)


@query("""
    SELECT lang AS topic, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER ()) AS topic_share,
        round(100.0 * count(*) FILTER (n_chars >= 500) / count(*)) AS knowledge_rate FROM documents GROUP BY lang
""")
def topic_shares(spark, sf_dir):
    """AGG30: each topic's share of the items, and the share of its items that hold enough knowledge, in per cent."""
    by = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("topic"))
    by = by.agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 500).alias("long"))
    total = by.agg(F.sum("n").alias("total"))
    share = lambda a, b: F.round(100.0 * F.col(a) / F.col(b))
    return by.crossJoin(F.broadcast(total)).select("topic", "n", share("n", "total").alias("topic_share"), share("long", "n").alias("knowledge_rate"))


@query("""
    WITH t AS (SELECT DISTINCT source, lang AS topic FROM documents),
    c AS (SELECT t.source, t.topic, d.doc_id AS candidate, row_number() OVER (PARTITION BY t.source, t.topic ORDER BY d.doc_id DESC) AS rank
        FROM t JOIN documents d ON d.source = t.source AND contains(d.lang, t.topic) QUALIFY rank <= 21),
    p AS (SELECT d.doc_id, candidate, row_number() OVER (PARTITION BY d.doc_id ORDER BY candidate DESC) AS rank
        FROM documents d JOIN c ON d.source = c.source AND d.lang = c.topic AND d.doc_id <> c.candidate)
    SELECT doc_id, candidate, rank FROM p WHERE rank <= 20
""")
def newest_candidates(spark, sf_dir):
    """WIN4, JN5, JN6: for each item the 20 newest others of its category whose topic contains its own.

    The newest 21 of each category and topic are found once, so an item meets 21 rows, not its category. Spark keeps
    the top rows of each task before the shuffle, as one category may hold a third of all items.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("topic"))
    topics = d.select("source", "topic").distinct()
    best = F.slice(F.sort_array(F.collect_list("doc_id"), asc=False), 1, 21).alias("best")
    newest = F.row_number().over(Window.partitionBy("source", "topic").orderBy(F.desc("doc_id")))
    newest = d.withColumn("place", newest).where("place <= 21").drop("place")
    pairs = topics.join(newest.withColumnRenamed("topic", "other"), "source").where(F.contains("other", "topic"))
    lists = pairs.groupBy("source", "topic").agg(best)
    met = d.join(lists, ["source", "topic"])
    others = F.slice(F.filter("best", lambda c: c != F.col("doc_id")), 1, 20)
    met = met.select("doc_id", F.posexplode(others).alias("pos", "candidate"))
    return met.select("doc_id", "candidate", (F.col("pos") + 1).cast("long").alias("rank"))


#: Ids up to which they are sent to all tasks.
FEW = 500_000
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))"


@query(f"""
    WITH d AS (SELECT doc_id, source, split_part(lower(text), ' ', 1) AS topic, length(text) AS len, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
    c AS (SELECT a.doc_id, b.doc_id AS candidate, a.words AS wa, b.words AS wb, a.len AS la, b.len AS lb, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id DESC) AS place
        FROM d a JOIN d b ON a.source = b.source AND contains(b.topic, a.topic) AND a.doc_id <> b.doc_id QUALIFY place <= 20),
    s AS (SELECT doc_id, candidate, place, len(list_intersect(wa, wb)) AS shared, len(wa) AS na, len(wb) AS nb, la, lb FROM c WHERE len(wa) > 0 AND len(wb) > 0)
    SELECT doc_id, candidate, place, round(0.7e0 * (shared / (na + nb - shared)) + 0.3e0 * (least(la, lb) / greatest(la, lb)), 6) AS score
    FROM s WHERE 0.7e0 * (shared / (na + nb - shared)) + 0.3e0 * (least(la, lb) / greatest(la, lb)) >= 0.5 - 1e-12
""")
def similar_candidates(spark, sf_dir):
    """JN6, SIM1, WIN4: of the 20 newest others of an item's category whose topic contains its own those that are similar.

    The newest 21 of each topic stand for it, topics meet through an index of grams, and a pair's word sets are fetched
    only if lengths and sizes leave the score within reach.
    """
    text = F.col("text")
    topic = F.substring_index(F.lower(text), " ", 1)
    given = table(spark, sf_dir, "documents").where(text.isNotNull())
    d, path = given.select("doc_id", "source", topic.alias("topic"), F.length(text).alias("len"), F.size(word_set(text)).alias("n")), new_folder(spark, "topics")
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    topics = d.select("source", "topic").distinct()
    pairs = contained(topics, topics.withColumnRenamed("topic", "other"), "source", "topic", "other")
    newest = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("candidate")))
    ids = d.select("source", F.col("topic").alias("other"), F.col("doc_id").alias("candidate"), F.col("len").alias("len_b"), F.col("n").alias("n_b"))
    ids = ids.withColumn("k", newest(["source", "other"])).where("k <= 21").drop("k")
    lists = pairs.join(ids, ["source", "other"]).withColumn("k", newest(["source", "topic"])).where("k <= 21")
    lists = lists.groupBy("source", "topic").agg(F.sort_array(F.collect_list(F.struct("candidate", "len_b", "n_b")), asc=False).alias("best"))
    met = d.select("doc_id", "source", "topic", F.col("len").alias("len_a"), F.col("n").alias("n_a")).join(lists, ["source", "topic"])
    others = F.slice(F.filter("best", lambda c: c["candidate"] != F.col("doc_id")), 1, 20)
    met = met.select("doc_id", "len_a", "n_a", F.posexplode(others).alias("at", "c")).select("doc_id", "len_a", "n_a", "at", "c.*")
    ratio = F.least("len_a", "len_b") / F.greatest("len_a", "len_b")
    most = F.lit(0.7) * F.least("n_a", "n_b") / F.greatest("n_a", "n_b") + F.lit(0.3) * ratio
    met = met.where((F.col("n_a") > 0) & (F.col("n_b") > 0)).where(most >= 0.5 - 1e-9)
    path = new_folder(spark, "met")
    met.write.parquet(path)
    met = spark.read.schema(met.schema).parquet(path)
    needed = met.select("doc_id").union(met.select("candidate")).distinct()
    # few items have a partner within reach: up to a bound their ids are sent to all tasks, and other items' words stay
    few = needed.limit(FEW + 1).count() <= FEW
    words = given.select("doc_id", F.transform(word_set(text), lambda w: F.xxhash64(w)).alias("words"))
    words = words.join(F.broadcast(needed) if few else needed, "doc_id", "left_semi")
    full = met.join(words.withColumnRenamed("words", "wa"), "doc_id").join(words.select(F.col("doc_id").alias("candidate"), F.col("words").alias("wb")), "candidate")
    score = similarity(F.col("wa"), F.col("wb"), F.col("len_a"), F.col("len_b"))
    full = full.select("doc_id", "candidate", (F.col("at") + 1).cast("long").alias("place"), score.alias("score"))
    return full.where(F.col("score") >= 0.5 - 1e-12).withColumn("score", F.round("score", 6))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type AS category, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL")
def month_folders(spark, sf_dir):
    """SNK4: items written in folders by month, and an index of each folder read back from them."""
    path = new_folder(spark, "months")
    e = events(spark, sf_dir).select("event_id", F.col("event_type").alias("category"), F.date_format("ts", "yyyy-MM").alias("month"))
    e.write.partitionBy("month").parquet(path)
    back = spark.read.schema("event_id long, category string, month string").parquet(path)
    return back.groupBy("month", "category").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
    SELECT 'documents' AS name, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents UNION ALL SELECT 'pages', count(*), CAST(sum(page_id) AS BIGINT) FROM pages
    UNION ALL SELECT 'labels', count(*), CAST(sum(doc_id) AS BIGINT) FROM labels
""")
def cache_export(spark, sf_dir):
    """SNK1, SNK7, SNK19: three tables written as JSON, each over what was there before, and read back with their counts."""
    path, out = new_folder(spark, "export"), None
    for name, key in (("documents", "doc_id"), ("pages", "page_id"), ("labels", "doc_id")):
        rows = table(spark, sf_dir, name)
        for _ in range(2):  # a second export replaces the first
            rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
        back = spark.read.schema(rows.schema).json(f"{path}/{name}")
        one = back.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(key).alias("id_sum"))
        out = one if out is None else out.union(one)
    return out
