"""Queries over events: queue, errors, retries, latencies, limits, alerts and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnquery.functions import classify as C
from tarnquery.operators.histograms import histogram_quantile
from tarnquery.operators.ranges import looking_back, places
from tarnquery.plans.registry import query, table
from tarnquery.plans.texts import sql

#: Queries that ask for "now" are anchored, so that reruns agree.
AS_OF = "2024-01-31 00:00:00"
#: The error type of an event by its JSON counter, and a message for it.
TYPES = ("ScrapingError", "APIError", "ProcessingError", "StorageError", "ValidationError", "ConfigurationError")
MESSAGES = ("request timeout", "rate limit reached", "connection lost", "unauthorized", "item not found", "malformed reply", "disk full")
K = "CAST(props->>'$.k' AS INTEGER)"
ERRORS = f"""e AS (SELECT event_id, ts, user_id, value, {K} AS k, [{', '.join(map(sql, TYPES))}][{K} % 6 + 1] AS error_type, [{', '.join(map(sql, MESSAGES))}][event_id % 7 + 1] AS message FROM events WHERE event_type = 'error'),
    r AS (SELECT *, CASE error_type WHEN 'ConfigurationError' THEN 'critical' WHEN 'APIError' THEN 'high' WHEN 'StorageError' THEN 'high' WHEN 'ValidationError' THEN 'low' ELSE 'medium' END AS severity FROM e)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the counter of their JSON properties."""
    return table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k INT")["k"])


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as records with type, message and severity."""
    e = events(spark, sf_dir).where("event_type = 'error'")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("k") % 6 + 1).cast("int"))
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 7 + 1).cast("int"))
    e = e.select("event_id", "ts", "user_id", "value", "k", kind.alias("error_type"), message.alias("message"))
    return e.withColumn("severity", C.lookup(F.col("error_type"), C.TYPE_SEVERITY, "medium"))


def stamp(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("SELECT event_type AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def status_distribution(spark, sf_dir):
    """AGG11: tasks by status."""
    by = events(spark, sf_dir).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("t")))).select("status", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("percent"))


@query("""
    SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed,
        round(100.0 * count(*) FILTER (event_type = 'purchase') / greatest(count(*), 1), 6) AS success_rate, round(avg(value) FILTER (event_type = 'purchase'), 6) AS mean, round(sum(value) FILTER (event_type = 'purchase'), 4) AS spent,
        (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds FROM events
""")
def batch_stats(spark, sf_dir):
    """AGG12, DAT3, MTH3: success rate, mean and total time, length of the run."""
    done = F.col("event_type") == "purchase"
    return events(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"),
        F.round(100.0 * F.count_if(done) / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"), F.round(F.avg(F.when(done, F.col("value"))), 6).alias("mean"),
        F.round(F.sum(F.when(done, F.col("value"))), 4).alias("spent"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"))


@query(f"""
    WITH {ERRORS} SELECT count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 25 HOUR AND k % 2 = 0) AS attempted,
        round(coalesce(100.0 * count(*) FILTER (k % 2 = 0 AND k % 4 = 0) / nullif(count(*) FILTER (k % 2 = 0), 0), 0), 6) AS recovery_rate, count(*) FILTER (severity = 'critical') AS critical, max_by(event_id, ts) FILTER (severity = 'critical') AS last_critical FROM r
""")
def error_stats(spark, sf_dir):
    """Totals, recent ones, recovery rate and critical errors in one pass."""
    e = errors(spark, sf_dir)
    tried = F.col("k") % 2 == 0
    return e.agg(
        F.count("*").alias("total"), F.count_if(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '24' HOUR")).alias("last_day"),
        F.count_if((F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '25' HOUR")) & tried).alias("attempted"),
        F.round(F.coalesce(100.0 * F.count_if(tried & (F.col("k") % 4 == 0)) / F.nullif(F.count_if(tried), F.lit(0)), F.lit(0.0)), 6).alias("recovery_rate"),
        F.count_if(F.col("severity") == "critical").alias("critical"), F.max_by(F.when(F.col("severity") == "critical", F.col("event_id")), F.when(F.col("severity") == "critical", F.col("ts"))).alias("last_critical"))


@query(f"WITH {ERRORS} SELECT error_type, CASE " + " ".join(f"WHEN contains(message, {sql(w)}) THEN {sql(n)}" for n, w in C.MESSAGE_PATTERNS) + " ELSE 'other' END AS pattern, count(*) AS n FROM r GROUP BY ALL")
def error_patterns(spark, sf_dir):
    """AGG14: errors by type and the first pattern of their message."""
    pattern = C.first_rule(F.col("message"), [(n, (w,)) for n, w in C.MESSAGE_PATTERNS], "other")
    return errors(spark, sf_dir).groupBy("error_type", pattern.alias("pattern")).agg(F.count("*").alias("n"))


@query(f"WITH {ERRORS} SELECT coalesce(error_type, 'all') AS error_type, coalesce(severity, 'all') AS severity, count(*) AS n FROM r WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR GROUP BY GROUPING SETS ((error_type), (severity))")
def error_summary_grouping_sets(spark, sf_dir):
    """AGG15: the last week's errors by type and by severity."""
    e = errors(spark, sf_dir).where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '168' HOUR"))
    by = e.groupingSets([["error_type"], ["severity"]], "error_type", "severity").agg(F.count("*").alias("n"))
    return by.select(F.coalesce("error_type", F.lit("all")).alias("error_type"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


@query(f"WITH {ERRORS} SELECT error_type, count(*) AS n FROM r GROUP BY error_type ORDER BY n DESC, error_type LIMIT 5")
def most_common_errors(spark, sf_dir):
    """AGG16, SRT4: the five most common errors."""
    return errors(spark, sf_dir).groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(5)


@query("SELECT event_type AS endpoint, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, min(value) AS least FROM events GROUP BY event_type")
def endpoint_stats(spark, sf_dir):
    """AGG17: response times by endpoint."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("endpoint")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"))


@query(f"WITH {ERRORS} SELECT severity, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, row_number() OVER (PARTITION BY severity ORDER BY ts DESC, event_id) AS rank FROM r QUALIFY rank <= 5")
def last_security_events(spark, sf_dir):
    """AGG18: the last five of each severity."""
    w = Window.partitionBy("severity").orderBy(F.desc("ts"), "event_id")
    return errors(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("severity", "event_id", stamp().alias("at"), "rank")


@query("SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean FROM events")
def last_n_avg(spark, sf_dir):
    """AGG19, WIN5: the mean of the last hundred responses."""
    e = events(spark, sf_dir).select("event_type", "event_id", "ts", "value")
    e = looking_back(places(e, ["event_type"], [F.col("ts"), F.col("event_id")]), 99)
    w = Window.partitionBy("event_type", "block").orderBy("place").rowsBetween(-99, 0)
    return e.withColumn("mean", F.round(F.avg("value").over(w), 9)).where("own").select("event_type", "event_id", "mean")


@query(f"SELECT event_type || ':' || ({K} % 3) AS endpoint, count(*) AS requests, count(*) FILTER (value >= 50) AS errors, round(coalesce(100.0 * count(*) FILTER (value >= 50) / nullif(count(*), 0), 0), 6) AS error_rate FROM events GROUP BY ALL")
def request_counters(spark, sf_dir):
    """AGG19, EVT3: requests and errors by endpoint."""
    bad = F.col("value") >= 50
    key = F.concat_ws(":", "event_type", (F.col("k") % 3).cast("string"))
    return events(spark, sf_dir).groupBy(key.alias("endpoint")).agg(F.count("*").alias("requests"), F.count_if(bad).alias("errors"), F.round(100.0 * F.count_if(bad) / F.count("*"), 6).alias("error_rate"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'labelled', count(*) FROM labels WHERE quality = 1")
def cache_counts(spark, sf_dir):
    """Rows of each table and of a status (AGG10 in full: cache_status)."""
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    t = lambda n: table(spark, sf_dir, n)
    return one("documents", t("documents")).union(one("pages", t("pages"))).union(one("labels", t("labels"))).union(one("labelled", t("labels").where("quality = 1")))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS processed, count(*) FILTER (event_type = 'purchase') AS extracted FROM events GROUP BY ALL")
def timeline(spark, sf_dir):
    """AGG31: processed and extracted by day."""
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("processed"), F.count_if(F.col("event_type") == "purchase").alias("extracted"))


@query("SELECT user_id, round(100.0 * count(*) FILTER (event_type IN ('purchase', 'error')) / count(*), 6) AS progress FROM events GROUP BY user_id")
def queue_progress(spark, sf_dir):
    """AGG32: share of finished tasks by batch."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(100.0 * F.count_if(F.col("event_type").isin("purchase", "error")) / F.count("*"), 6).alias("progress"))


@query("""
    WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate, avg(value) AS response_time FROM events GROUP BY ALL)
    SELECT day, CASE WHEN error_rate >= 0.15 OR response_time >= 25 THEN 'critical' WHEN error_rate >= 0.05 OR response_time >= 15 THEN 'warning' ELSE 'healthy' END AS status FROM m
""")
def health_rollup(spark, sf_dir):
    """AGG33: the most severe threshold that a day's metrics cross; thresholds are a parameter."""
    by = events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("error_rate"), F.avg("value").alias("response_time"))
    over = lambda e, r: (F.col("error_rate") >= e) | (F.col("response_time") >= r)
    return by.select("day", F.when(over(0.15, 25), "critical").when(over(0.05, 15), "warning").otherwise("healthy").alias("status"))


#: Metric, warning and critical thresholds, by name.
THRESHOLDS = (("response_time", 12.0, 25.0), ("error_rate", 0.05, 0.15), ("queue_size", 50.0, 100.0))


@query("""
    WITH m AS (SELECT user_id, avg(value) AS response_time, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate, CAST(count(*) AS DOUBLE) AS queue_size FROM events GROUP BY user_id),
    u AS (UNPIVOT m ON response_time, error_rate, queue_size INTO NAME metric VALUE x),
    t(metric, warn, crit) AS (VALUES ('response_time', 12.0, 25.0), ('error_rate', 0.05, 0.15), ('queue_size', 50.0, 100.0))
    SELECT user_id, u.metric, CASE WHEN x >= crit THEN 'critical' ELSE 'warning' END AS level FROM u JOIN t ON u.metric = t.metric WHERE x >= warn
""")
def threshold_checks(spark, sf_dir):
    """MON1: metrics against a table of thresholds."""
    m = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("response_time"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("error_rate"), F.count("*").cast("double").alias("queue_size"))
    u = m.unpivot("user_id", ["response_time", "error_rate", "queue_size"], "metric", "x")
    t = spark.createDataFrame(list(THRESHOLDS), "metric string, warn double, crit double")
    return u.join(F.broadcast(t), "metric").where("x >= warn").select("user_id", "metric", F.when(F.col("x") >= F.col("crit"), "critical").otherwise("warning").alias("level"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place, o_orderstatus FROM orders")
def priority_queue_order(spark, sf_dir):
    """WIN6: the order of a queue by priority, then arrival."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    order = [F.col(c) for c in ("o_orderpriority", "o_orderdate", "o_orderkey")]
    return places(orders, ["o_orderstatus"], order).select("o_orderkey", "place", "o_orderstatus")


@query("""
    WITH s AS (SELECT user_id, event_id, ts, value >= 20 AS firing FROM events), l AS (SELECT *, lag(firing) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s)
    SELECT user_id, event_id, CASE WHEN firing THEN 'fired' ELSE 'resolved' END AS change FROM l WHERE firing <> coalesce(was, false)
""")
def alert_transitions(spark, sf_dir):
    """WIN8, STR6: where an alert fires or resolves."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = events(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("value") >= 20).alias("firing"))
    s = s.withColumn("was", F.coalesce(F.lag("firing").over(w), F.lit(False))).where("firing <> was")
    return s.select("user_id", "event_id", F.when(F.col("firing"), "fired").otherwise("resolved").alias("change"))


@query("""
    WITH c AS (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events),
    l AS (SELECT *, lag(total) OVER w AS before, lag(ts) OVER w AS since FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, round((total - before) / nullif(CAST(epoch_us(ts) - epoch_us(since) AS DOUBLE) / 3600000000, 0), 4) AS per_hour FROM l
""")
def counter_rate(spark, sf_dir):
    """WIN9, STR7: growth of a counter by hour since the check before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = events(spark, sf_dir).select("user_id", "event_id", "ts", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    hours = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / F.lit(3600e6)
    return c.select("user_id", "event_id", F.round((F.col("total") - F.lag("total").over(w)) / F.nullif(hours, F.lit(0.0)), 4).alias("per_hour"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) > 2 AS rejected FROM events")
def rate_limit_fixed(spark, sf_dir):
    """STR2: requests beyond a limit within a fixed window of a client."""
    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return events(spark, sf_dir).select("event_id", "user_id", (F.row_number().over(w) > 2).alias("rejected"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS in_day FROM events")
def rate_limit_sliding(spark, sf_dir):
    """Requests within the day before each (STR1 in full: rate_limit_wait)."""
    e = events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return e.select("event_id", "user_id", F.count("*").over(day).alias("in_day"))


@query("""
    WITH h AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY ALL),
    b AS (SELECT w, CAST(errors AS DOUBLE) / n > 0.05 AS bad FROM h), g AS (SELECT w, bad, row_number() OVER (ORDER BY w) - row_number() OVER (PARTITION BY bad ORDER BY w) AS grp FROM b)
    SELECT strftime(min(w), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS windows FROM g WHERE bad GROUP BY grp HAVING count(*) >= 2
""")
def window_rate_alerts(spark, sf_dir):
    """STR5: runs of windows in which the error rate stays above a threshold."""
    h = events(spark, sf_dir).groupBy(F.window("ts", "6 hours")["start"].alias("w")).agg((F.count_if(F.col("event_type") == "error") / F.count("*") > 0.05).alias("bad"))
    # one row for each window of time, however many events: the run's number fits one task
    g = h.withColumn("grp", F.row_number().over(Window.orderBy("w")) - F.row_number().over(Window.partitionBy("bad").orderBy("w")))
    return g.where("bad").groupBy("grp").agg(F.min("w").alias("w"), F.count("*").alias("windows")).where("windows >= 2").select(stamp("w").alias("since"), "windows")


#: Upper bounds of the buckets of a histogram; the last one is open.
BUCKETS = (1, 2.5, 5, 7.5, 10, 15, 20, 25, 30, 40, 50, 75, 100)


@query(f"""
    WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, list_min(list_filter([{", ".join(f"{b}e0" for b in BUCKETS)}, 'inf'::DOUBLE], lambda b: value <= b)) AS le FROM events WHERE value IS NOT NULL),
    n AS (SELECT day, le, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY day ORDER BY le) AS upto, sum(n) OVER (PARTITION BY day) AS total FROM n),
    f AS (SELECT * FROM c WHERE upto >= 0.95e0 * total QUALIFY row_number() OVER (PARTITION BY day ORDER BY le) = 1),
    b AS (SELECT day, total, le, n, upto - n AS below, coalesce(list_max(list_filter([{", ".join(f"{b}e0" for b in BUCKETS)}], lambda b: b < le)), 0) AS low FROM f),
    q AS (SELECT day, total, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * ((0.95e0 * total - below) / n) END AS p95 FROM b)
    SELECT day, CAST(total AS BIGINT) AS n, round(p95, 6) AS p95, p95 > 30 AS slow FROM q
""")
def latency_quantile(spark, sf_dir):
    """STR4: the 95th percentile of a day out of a histogram: counts by bucket, which add up however they were taken, and a
    straight line within the bucket that holds it. What lies in the open bucket counts as its lower bound."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return histogram_quantile(events(spark, sf_dir).select(day, "value"), "day", "value", BUCKETS, 0.95).select(
        "day", "n", F.round("at", 6).alias("p95"), (F.col("at") > 30).alias("slow")
    )


@query("""
    WITH spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS TIMESTAMP) AS hour), h AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'purchase')
    SELECT strftime(spine.hour, '%Y-%m-%d %H:00:00') AS hour FROM spine LEFT JOIN h ON spine.hour = h.hour WHERE h.hour IS NULL
""")
def absence_alert(spark, sf_dir):
    """STR5: hours without a sign of life."""
    spine = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-31', INTERVAL '1' HOUR)) AS hour")
    seen = events(spark, sf_dir).where("event_type = 'purchase'").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    return spine.join(seen, "hour", "left_anti").select(F.date_format("hour", "yyyy-MM-dd HH:00:00").alias("hour"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state, max(event_id) AS last_id, count(*) AS changes FROM events GROUP BY user_id")
def task_state(spark, sf_dir):
    """The last state of each task (STR9: task_transitions)."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("event_id").alias("last_id"), F.count("*").alias("changes"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def process_once(spark, sf_dir):
    """STR11: each key is processed once."""
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


POLICY = "(VALUES " + ", ".join(f"({sql(t)}, {n}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for t, n, a, b in C.RETRY_POLICIES) + ")"


@query(f"""
    WITH {ERRORS}, p(t, most, base, longest) AS (SELECT * FROM {POLICY})
    SELECT event_id, least(coalesce(p.base, 1.0) * pow(2, k % 7), coalesce(p.longest, 10.0)) AS delay, k % 7 < coalesce(p.most, 2) AS retry,
        least(pow(2, k % 7), 60) AS network_delay, least(5 * (k % 7 + 1), 30) AS api_delay, least(10 * pow(2, k % 7), 300) AS limit_delay FROM r LEFT JOIN p ON p.t = r.error_type
""")
def backoff_schedule(spark, sf_dir):
    """MTH1, MTH2, MTH4, MTH5: delays of a retry by the error's policy, and whether it may be retried."""
    p = spark.createDataFrame(list(C.RETRY_POLICIES), "error_type string, most int, base double, longest double")
    e = errors(spark, sf_dir).withColumn("n", F.col("k") % 7).join(F.broadcast(p), "error_type", "left")
    return e.select(
        "event_id", F.least(F.coalesce("base", F.lit(1.0)) * F.pow(F.lit(2.0), "n"), F.coalesce("longest", F.lit(10.0))).alias("delay"), (F.col("n") < F.coalesce("most", F.lit(2))).alias("retry"),
        F.least(F.pow(F.lit(2.0), "n"), F.lit(60.0)).alias("network_delay"), F.least(5 * (F.col("n") + 1), F.lit(30)).alias("api_delay"), F.least(10 * F.pow(F.lit(2.0), "n"), F.lit(300.0)).alias("limit_delay"))


CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(error_type), {sql('|'.join(w))}) THEN {sql(c)}" for c, w in C.ERROR_CATEGORIES) + " ELSE 'unknown' END"
ACTION = "CASE " + " ".join(f"WHEN regexp_matches(message, {sql('|'.join(w))}) THEN {sql(a)}" for a, w in C.RECOVERY_WORDS) + " " + " ".join(f"WHEN error_type = {sql(t)} THEN {sql(a)}" for t, a in C.TYPE_RECOVERY) + " ELSE 'retry' END"


@query(f"""
    WITH {ERRORS}, c AS (SELECT event_id, error_type, severity, {CATEGORY} AS category, {ACTION} AS action FROM r)
    SELECT event_id, error_type, severity, category, CASE WHEN category IN ('configuration', 'authentication', 'api', 'storage') THEN 'high' WHEN category IN ('network', 'rate_limiting') THEN 'medium' ELSE 'low' END AS category_severity, action FROM c
""")
def error_records(spark, sf_dir):
    """EVT1, CLS8, CLS9: a record of each error with category, severity and recovery action."""
    category = C.error_category(F.col("error_type"))
    return errors(spark, sf_dir).select("event_id", "error_type", "severity", category.alias("category"), C.category_severity(category).alias("category_severity"), C.recovery_action(F.col("error_type"), F.col("message")).alias("action"))


@query(f"WITH {ERRORS} SELECT error_type, count(*) AS kept FROM r WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY GROUP BY error_type")
def error_retention(spark, sf_dir):
    """FLT14: errors younger than the retention time, recounted."""
    return errors(spark, sf_dir).where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '10' DAY")).groupBy("error_type").agg(F.count("*").alias("kept"))


@query(f"SELECT event_id, event_type FROM events WHERE NOT (event_type IN ('purchase', 'error') AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY")
def cleanup_retention(spark, sf_dir):
    """What stays after old finished tasks are dropped, within a window of time."""
    day = lambda n: F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '{n}' DAY")
    e = events(spark, sf_dir).where(~(F.col("event_type").isin("purchase", "error") & (F.col("ts") < day(20))) & (F.col("ts") < day(15)))
    return e.select("event_id", "event_type")


@query(f"SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' OR (event_type = 'error' AND {K} % 2 = 0)")
def batch_export(spark, sf_dir):
    """SNK8: completed tasks, and failed ones where asked for."""
    return events(spark, sf_dir).where((F.col("event_type") == "purchase") | ((F.col("event_type") == "error") & (F.col("k") % 2 == 0))).select("event_id", "user_id", "value")


@query(f"WITH {ERRORS} SELECT event_id, error_type, message, severity FROM r")
def error_report(spark, sf_dir):
    """SNK9: errors without their context."""
    return errors(spark, sf_dir).drop("ts", "user_id", "value", "k")


@query("SELECT 'requests_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_text(spark, sf_dir):
    """SNK16: counters in the text format of a metrics endpoint."""
    by = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return by.select(F.format_string('requests_total{type="%s"} %d', "event_type", "n").alias("line"))


@query(f"SELECT {K} % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_props_agg(spark, sf_dir):
    """JSN1: a JSON property as a grouping key."""
    return events(spark, sf_dir).groupBy((F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, '{\"event\":\"' || event_type || '\",\"user\":' || user_id || ',\"at\":\"' || strftime(ts, '%Y-%m-%d') || '\"}' AS entry FROM events")
def log_events(spark, sf_dir):
    """EVT2, STR14: structured log entries."""
    return events(spark, sf_dir).select("event_id", F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user"), F.date_format("ts", "yyyy-MM-dd").alias("at"))).alias("entry"))


@query("SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def task_durations(spark, sf_dir):
    """DAT3: days between two dates of a task."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", days.alias("days"))


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark, sf_dir):
    """SRC6: a full scan with a pushed filter and a grouped summary."""
    t = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS skipped,
        (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS runtime FROM events GROUP BY user_id
""")
def worker_runs(spark, sf_dir):
    """PIP6, PIP8: counters and runtime of each run of a worker."""
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy("user_id").agg(F.count_if(kind == "purchase").alias("success"), F.count_if(kind == "error").alias("failed"), F.count_if(~kind.isin("purchase", "error")).alias("skipped"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("runtime"))


@query("""
    SELECT 'items' AS part, 'total' AS name, count(*) AS n FROM documents UNION ALL SELECT 'category', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'topic', lang, count(*) FROM documents GROUP BY lang
    UNION ALL SELECT 'status', event_type, count(*) FROM events GROUP BY event_type
""")
def status_facade(spark, sf_dir):
    """PIP10: the repository's summary and the queue's status as rows."""
    d = table(spark, sf_dir, "documents").groupingSets([[], ["source"], ["lang"]], "source", "lang").agg(F.count("*").alias("n"), F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"))
    parts = F.when(F.col("gs") == 0, "category").when(F.col("gl") == 0, "topic").otherwise("items")
    d = d.select(parts.alias("part"), F.when(F.col("gs") == 0, F.col("source")).when(F.col("gl") == 0, F.col("lang")).otherwise("total").alias("name"), "n")
    return d.unionByName(events(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")).withColumn("part", F.lit("status")))
