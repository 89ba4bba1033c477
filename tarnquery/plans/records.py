"""Queries over records: JSON columns, checks of posts, advice, paths, log lines, counters by the way, queue files."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tarnquery.functions import jsons as J
from tarnquery.functions import pii as P
from tarnquery.plans.privacy import FOUND_SQL, SUMS_SQL
from tarnquery.plans.registry import query, table
from tarnquery.plans.streams import by_id, write_stores
from tarnquery.plans.texts import sql
from tarnquery.sources.queues import queue_stream
from tarnquery.sources.shared import new_folder
from tarnquery.streaming import events as E


@query("""
    SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE coalesce(lang, 'unknown') END AS lang, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars END AS chars,
        CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST(doc_id * 7 % 100 AS INTEGER) END AS likes, coalesce(array_to_string(string_split(text, ' ')[1:3], ' | '), '') AS courses,
        doc_id + doc_id + 1 AS ids, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS INTEGER) AS keywords FROM documents
""")
def json_columns(spark, sf_dir):
    """JSN1: metadata, engagement, courses, ids and keywords as JSON text in a table, read back as VARIANT by path and type.

    Some rows lack a column, hold what isn't JSON or a value of another type; they get defaults.
    """
    d, path = table(spark, sf_dir, "documents"), new_folder(spark, "json")
    n, words = F.col("doc_id"), F.slice(F.split("text", " "), 1, 3)
    rows = d.select(
        "doc_id",
        F.when(n % 9 == 0, "{broken").otherwise(F.to_json(F.struct("lang", F.struct(F.col("n_chars").alias("chars")).alias("size")))).alias("metadata"),
        F.when(n % 4 == 0, '{"likes": "many"}').otherwise(F.to_json(F.struct((n * 7 % 100).alias("likes")))).alias("engagement"),
        F.to_json(words).alias("courses"), F.to_json(F.array(n, n + 1)).alias("ids"), F.when(n % 5 != 0, '["a", "b"]').alias("keywords"),
    )
    rows.write.parquet(path)
    v = spark.read.schema(rows.schema).parquet(path).select("doc_id", *[J.parsed(F.col(c)).alias(c) for c in ("metadata", "engagement", "courses", "ids", "keywords")])
    total = F.aggregate(J.items(F.col("ids"), "bigint"), F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select(
        "doc_id", J.field(F.col("metadata"), "$.lang", "string", "unknown").alias("lang"), J.field(F.col("metadata"), "$.size.chars", "bigint", 0).alias("chars"),
        J.field(F.col("engagement"), "$.likes", "int", 0).alias("likes"), F.array_join(J.items(F.col("courses"), "string"), " | ").alias("courses"),
        total.alias("ids"), F.size(J.items(F.col("keywords"), "string")).alias("keywords"),
    )


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS status, CAST(event_id % 4 AS INTEGER) AS retries, event_id % 10 = 0 AS broken FROM events")
def stream_queue_files(spark, sf_dir):
    """SRC3, STR8: queue files as a stream that reads each once; tasks without a URL are told apart."""
    path = new_folder(spark, "queues")
    url = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    task = F.struct(F.col("event_id").cast("string").alias("id"), url.alias("url"), F.col("event_type").alias("status"), (F.col("event_id") % 4).cast("int").alias("retry_count"))
    write_stores(table(spark, sf_dir, "events"), "event_id", by_id(task), "tasks", path)
    done = E.run_to_table(queue_stream(spark, path), new_folder(spark, "tasks"), "append")
    return done.select("id", "status", F.col("retry_count").alias("retries"), F.col("problem").isNotNull().alias("broken"))


@query(f"""{FOUND_SQL}, {SUMS_SQL}, c AS (
    SELECT 'items' AS counter, count(*) AS n FROM documents UNION ALL SELECT 'items_with_matches', count(*) FILTER (n > 0) FROM texts
    UNION ALL SELECT 'matches', CAST(sum(n) AS BIGINT) FROM texts UNION ALL SELECT 'sanitized', count(*) FILTER (needed) FROM texts
    UNION ALL SELECT 'high_risk', count(*) FILTER (risk = 'high') FROM texts
    UNION ALL SELECT 'requests', count(*) FROM events UNION ALL SELECT 'request_errors', count(*) FILTER (event_type = 'error') FROM events
    UNION ALL SELECT 'cache_hits', count(*) FILTER (event_type = 'view') FROM events
    UNION ALL SELECT 'queue_size', count(*) FILTER (event_type = 'signup') - count(*) FILTER (event_type = 'purchase') FROM events)
    SELECT counter, n FROM c
""")
def counters_by_the_way(spark, sf_dir):
    """EVT3, AGG21: counters of items, matches, requests, cache and queue, observed while the rows are written for their own sake."""
    count = lambda test, name: F.count_if(test).alias(name)
    f, kind = F.col("found"), F.col("event_type")
    texts, log = Observation("texts"), Observation("log")
    clean = table(spark, sf_dir, "documents").withColumn("found", P.matches(F.col("text"))).observe(
        texts, F.count(F.lit(1)).alias("items"), count(F.size(f) > 0, "items_with_matches"), F.coalesce(F.sum(F.size(f).cast("long")), F.lit(0)).alias("matches"),
        count(P.should_sanitize(f), "sanitized"), count(P.risk(f) == "high", "high_risk"),
    )
    clean.select("doc_id", P.sanitize(F.col("text"), f, "placeholder").alias("text")).write.parquet(new_folder(spark, "clean"))
    queue = (F.count_if(kind == "signup") - F.count_if(kind == "purchase")).alias("queue_size")
    seen = table(spark, sf_dir, "events").observe(log, F.count(F.lit(1)).alias("requests"), count(kind == "error", "request_errors"), count(kind == "view", "cache_hits"), queue)
    seen.write.parquet(new_folder(spark, "log"))
    return spark.createDataFrame([(k, int(v)) for o in (texts, log) for k, v in o.get.items()], "counter string, n long")


@query("""
    SELECT event_id, CASE event_type WHEN 'error' THEN 'security' WHEN 'purchase' THEN 'business' WHEN 'view' THEN 'metric' ELSE 'request' END AS kind,
        CASE event_type WHEN 'error' THEN '{"event":"Security event","severity":"' || CASE WHEN value >= 20 THEN 'high' ELSE 'low' END || '","user":' || user_id || '}'
            WHEN 'purchase' THEN '{"event":"Business event","event_type":"purchase","user":' || user_id || '}'
            WHEN 'view' THEN '{"event":"Performance metric","metric":"view","value":' || CAST(floor(value) AS BIGINT) || '}'
            ELSE '{"event":"HTTP request","path":"/' || event_type || '","status_code":' || CASE WHEN value >= 50 THEN 500 ELSE 200 END || ',"response_time_us":' || CAST(floor(value * 1000) AS BIGINT) || '}' END AS line FROM events
""")
def log_lines(spark, sf_dir):
    """EVT2: requests, business events, security events and metrics, each as a line of JSON."""
    kind, value = F.col("event_type"), F.col("value")
    line = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    security = line(event=F.lit("Security event"), severity=F.when(value >= 20, "high").otherwise("low"), user=F.col("user_id"))
    business = line(event=F.lit("Business event"), event_type=F.lit("purchase"), user=F.col("user_id"))
    metric = line(event=F.lit("Performance metric"), metric=F.lit("view"), value=F.floor(value))
    status = F.when(value >= 50, 500).otherwise(200)
    request = line(event=F.lit("HTTP request"), path=F.concat(F.lit("/"), kind), status_code=status, response_time_us=F.floor(value * 1000))
    said = F.when(kind == "error", security).when(kind == "purchase", business).when(kind == "view", metric).otherwise(request)
    name = F.when(kind == "error", "security").when(kind == "purchase", "business").when(kind == "view", "metric").otherwise("request")
    return table(spark, sf_dir, "events").select("event_id", name.alias("kind"), said.alias("line"))


#: What a post, its images and its engagement must have: a rule's SQL says when it is broken; the first broken one counts.
POST_RULES = (
    ("no url", "coalesce(url, '') = ''"), ("no text", "coalesce(html, '') = ''"), ("no author", "page_id % 7 = 0"),
    ("image without url", "page_id % 11 = 0"), ("image without name", "page_id % 13 = 0"), ("negative engagement", "page_id % 17 = 3"),
)


@query(f"SELECT page_id, CASE {' '.join(f'WHEN {test} THEN {sql(name)}' for name, test in POST_RULES)} END AS problem FROM pages")
def post_quarantine(spark, sf_dir):
    """VAL1: posts with images and engagement; the first rule that a post breaks, in rows of nested records."""
    n = F.col("page_id")
    image = F.struct(F.when(n % 11 != 0, "http://i/1.png").otherwise("").alias("url"), F.when(n % 13 != 0, "1.png").alias("filename"))
    counts = F.struct(n.alias("likes"), F.lit(0).alias("comments"), F.when(n % 17 == 3, -1).otherwise(0).alias("shares"), F.lit(0).alias("reactions"))
    posts = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.col("html").alias("body_text"), F.when(n % 7 != 0, "someone").alias("author"), F.array(image).alias("images"), counts.alias("engagement"),
    )
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    negative = F.least(*[F.col(f"engagement.{c}") for c in ("likes", "comments", "shares", "reactions")]) < 0
    tests = (none(F.col("url")), none(F.col("body_text")), none(F.col("author")), F.exists("images", lambda i: none(i["url"])), F.exists("images", lambda i: none(i["filename"])), negative)
    problem = F.coalesce(*[F.when(t, name) for t, (name, _) in zip(tests, POST_RULES)])
    return posts.select("page_id", problem.alias("problem"))


#: Advice by confidence, and for items without a category.
ADVICE = (("confidence < 0.4", "name the topic by more specific words"), ("confidence < 0.4", "keep to one subject"), ("confidence < 0.2", "the text is general or mixed"),
          ("confidence < 0.2", "split it into several"), ("category = 'Other'", "name the field or industry"), ("category = 'Other'", "say more about the use"))


@query(f"""
    WITH c AS (SELECT doc_id, CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence, CASE WHEN doc_id % 4 = 0 THEN 'Other' ELSE source END AS category FROM documents)
    SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {test} THEN {sql(said)} END" for test, said in ADVICE)}], lambda x: x IS NOT NULL), '; ') AS advice FROM c
""")
def category_advice(spark, sf_dir):
    """CLS7: what would make an item's category surer, by bands of confidence and for items without one."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", ((n % 10).cast("double") / 10).alias("confidence"), F.when(n % 4 == 0, "Other").otherwise(F.col("source")).alias("category"))
    return d.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(F.expr(test), said) for test, said in ADVICE])), "; ").alias("advice"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#\\s]+[^\\s]*$') AND regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/:?#]*)', 1) <> '' AS webhook_ok FROM pages")
def webhook_valid(spark, sf_dir):
    """VAL5: addresses that a webhook can have: a web scheme and a host."""
    url = F.col("url")
    ok = url.rlike(r"^https?://[^/?#\s]+[^\s]*\z") & (F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/:?#]*)", 1) != "")
    return table(spark, sf_dir, "pages").select("page_id", ok.alias("webhook_ok"))


@query("""
    SELECT doc_id, 'images/by_category/' || left(regexp_replace(regexp_replace(coalesce(source, 'Other') || ' & ' || lang, '[<>:"/\\\\|?*&]', '', 'g'), '\\s+', '_', 'g'), 50) || '/' ||
        lpad(CAST(doc_id AS VARCHAR), CAST(greatest(6, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '_1.jpg' AS path FROM documents
""")
def image_paths(spark, sf_dir):
    """SNK20: where an item's image is kept: a folder by its cleaned category."""
    name = F.concat(F.coalesce("source", F.lit("Other")), F.lit(" & "), F.col("lang"))
    folder = F.left(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*&]', ""), r"\s+", "_"), F.lit(50))
    number = F.col("doc_id").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(6), F.length(number)), F.lit("0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("images/by_category/"), folder, F.lit("/"), padded, F.lit("_1.jpg")).alias("path"))


CUTOFF = "2024-01-16 00:00:00"


@query(f"""
    WITH u AS (SELECT user_id, max(ts) AS seen, count(*) AS uses, max_by(event_type, event_id) AS status FROM events GROUP BY user_id)
    SELECT 'queue' AS cache, event_id AS id FROM events WHERE NOT coalesce(event_type IN ('purchase', 'error') AND ts < TIMESTAMP '{CUTOFF}', false)
    UNION ALL SELECT 'content', user_id FROM u WHERE NOT (seen < TIMESTAMP '{CUTOFF}' + INTERVAL 13 DAY AND uses < 60)
    UNION ALL SELECT 'url', user_id FROM u WHERE NOT (seen < TIMESTAMP '{CUTOFF}' + INTERVAL 14 DAY AND status NOT IN ('signup', 'view') AND user_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0))
""")
def cache_cleanup(spark, sf_dir):
    """FLT12: what is left of queue, content and URL cache after a cleanup: finished tasks that are old go, content that is old
    and little used, and old URLs that no item refers to and no task works on."""
    e = table(spark, sf_dir, "events")
    old = lambda c, days=0: F.col(c) < F.lit(CUTOFF).cast("timestamp_ntz") + F.make_interval(days=F.lit(days))
    by = e.groupBy("user_id").agg(F.max("ts").alias("seen"), F.count("*").alias("uses"), F.max_by("event_type", "event_id").alias("status"))
    kept = lambda df, go: df.where(~F.coalesce(go, F.lit(False)))
    row = lambda df, name, c: df.select(F.lit(name).alias("cache"), F.col(c).alias("id"))
    queue = kept(e, F.col("event_type").isin("purchase", "error") & old("ts"))
    content = kept(by, old("seen", 13) & (F.col("uses") < 60))
    used = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("used")).distinct()
    urls = kept(by.join(used, F.col("user_id") == F.col("used"), "left"), old("seen", 14) & ~F.col("status").isin("signup", "view") & F.col("used").isNull())
    return row(queue, "queue", "event_id").unionByName(row(content, "content", "user_id")).unionByName(row(urls, "url", "user_id"))
