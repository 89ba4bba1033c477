"""Reads of the repository: distributions, filters, search, top-k and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnquery.operators.ranges import looking_back, places
from tarnquery.plans.registry import query, table


@query("""
    SELECT source AS category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent
    FROM documents GROUP BY source ORDER BY n DESC, category
""")
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, AGG2, SRT5: items and share by category, largest first."""
    docs = table(spark, sf_dir, "documents")
    by = docs.groupBy(F.col("source").alias("category")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent")).orderBy(F.desc("n"), "category")


#: Items of the repository: documents with a creation day, and up to three long words as course references.
ITEMS = """items AS (
    SELECT doc_id AS id, text AS content, source AS category, lang AS topic, n_chars, CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS day,
        left(text, 40) AS title, list_filter(string_split(lower(text), ' '), lambda w: length(w) > 11)[1:3] AS courses FROM documents)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int"))
    courses = F.slice(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 11), 1, 3)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("category"), F.col("lang").alias("topic"), "n_chars", day.alias("day"),
        F.left("text", F.lit(40)).alias("title"), courses.alias("courses"))


def day_text(c: str = "day"):
    return F.date_format(c, "yyyy-MM-dd")


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


@query(f"WITH {ITEMS}, c AS (SELECT category, count(*) AS n FROM items GROUP BY ALL) SELECT (SELECT count(*) FROM items) AS total, (SELECT category FROM c ORDER BY n DESC, category LIMIT 1) AS most_common, count(*) AS categories, round(count(*) / 7.0, 6) AS diversity FROM c")
def category_stats(spark, sf_dir):
    """AGG2: total, most common category (of equals the first by name) and diversity."""
    c = items(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    first = F.min_by("category", F.struct(-F.col("n"), "category"))
    return c.agg(F.sum("n").alias("total"), first.alias("most_common"), F.count("*").alias("categories"), F.round(F.count("*") / F.lit(7.0), 6).alias("diversity"))


@query(f"WITH {ITEMS} SELECT topic, category, count(*) AS n FROM items GROUP BY ALL ORDER BY n DESC, topic, category LIMIT 10")
def top_topics(spark, sf_dir):
    """AGG3: the ten most frequent topics."""
    return items(spark, sf_dir).groupBy("topic", "category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic", "category").limit(10)


@query(f"WITH {ITEMS} SELECT strftime(min(day), '%Y-%m-%d') AS earliest, strftime(max(day), '%Y-%m-%d') AS latest FROM items")
def date_range(spark, sf_dir):
    """AGG4, DAT1: first and last day."""
    return items(spark, sf_dir).agg(F.date_format(F.min("day"), "yyyy-MM-dd").alias("earliest"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("latest"))


@query(f"WITH {ITEMS} SELECT count(*) AS total, count(DISTINCT category) AS categories, count(DISTINCT topic) AS topics, CAST(sum(len(courses)) AS BIGINT) AS courses, count(*) FILTER (len(courses) > 0) AS with_courses, CAST(sum(length(content)) AS BIGINT) AS characters FROM items")
def repository_totals(spark, sf_dir):
    """AGG6, AGG26, AGG30, ARR1: totals of the repository."""
    return items(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_distinct("category").alias("categories"), F.count_distinct("topic").alias("topics"), F.sum(F.size("courses").cast("long")).alias("courses"),
        F.count_if(F.size("courses") > 0).alias("with_courses"), F.sum(F.length("content").cast("long")).alias("characters"))


@query(f"WITH {ITEMS} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM items WHERE day >= DATE '2024-02-29' - 30 GROUP BY ALL")
def daily_activity(spark, sf_dir):
    """AGG7, DAT2, DAT4: items by day over the 30 days before an anchor."""
    anchor = F.date_sub(F.lit("2024-02-29").cast("date"), 30)
    return items(spark, sf_dir).where(F.col("day") >= anchor).groupBy(day_text().alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT id, category, strftime(day, '%Y-%m-%d') AS day FROM items ORDER BY items.day DESC, id LIMIT 10")
def recent_items(spark, sf_dir):
    """SRT1: the ten newest items."""
    return items(spark, sf_dir).select("id", "category", "day").orderBy(F.desc("day"), "id").limit(10).withColumn("day", day_text())


@query(f"WITH {ITEMS} SELECT id, title FROM items WHERE category = 'src3' AND contains(lower(topic), 'e')")
def filter_category(spark, sf_dir):
    """FLT1, FLT2: by category, and by part of the topic."""
    return items(spark, sf_dir).where((F.col("category") == "src3") & F.lower("topic").contains("e")).select("id", "title")


@query(f"WITH {ITEMS} SELECT id, category FROM items WHERE contains(lower(title), 'thing') OR contains(lower(topic), 'thing') OR contains(lower(content), 'thing') OR contains(lower(category), 'thing')")
def substring_search(spark, sf_dir):
    """FLT3: any of four fields contains the words."""
    found = [F.lower(c).contains("thing") for c in ("title", "topic", "content", "category")]
    return items(spark, sf_dir).where(found[0] | found[1] | found[2] | found[3]).select("id", "category")


@query(f"""
    WITH {ITEMS}, f AS (SELECT * FROM items WHERE (contains(lower(title), 'th') OR contains(lower(content), 'th') OR len(list_filter(courses, lambda c: contains(c, 'th'))) > 0)
        AND category IN ('src0', 'src1', 'src2') AND topic = 'en' AND length(content) > 500)
    SELECT id, category, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 20
""")
def filtered_search(spark, sf_dir):
    """FLT4: search with filters; the total stands beside the first page."""
    found = F.lower("title").contains("th") | F.lower("content").contains("th") | F.exists("courses", lambda c: c.contains("th"))
    f = items(spark, sf_dir).where(found & F.col("category").isin("src0", "src1", "src2") & (F.col("topic") == "en") & (F.length("content") > 500))
    return f.select("id", "category").orderBy("id").limit(20).join(F.broadcast(f.agg(F.count("*").alias("total"))))


@query(f"WITH {ITEMS} SELECT CASE WHEN length(content) < 200 THEN 'short' WHEN length(content) <= 500 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM items GROUP BY ALL")
def length_buckets(spark, sf_dir):
    """FLT5: items by length of their content."""
    n = F.length("content")
    return items(spark, sf_dir).groupBy(F.when(n < 200, "short").when(n <= 500, "medium").otherwise("long").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT id, title, category, coalesce(nullif(topic, ''), 'unknown') AS topic FROM items WHERE id = 42")
def item_lookup(spark, sf_dir):
    """FLT6, LKP1: one item by its key, with defaults."""
    return items(spark, sf_dir).where("id = 42").select("id", "title", "category", F.coalesce(F.nullif("topic", F.lit("")), F.lit("unknown")).alias("topic"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AND source <> 'src19'")
def delete_items(spark, sf_dir):
    """FLT7: what is left after deleting by key and by value."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where("source <> 'src19'").select("doc_id").join(gone, "doc_id", "left_anti")


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS good, count(*) FILTER (quality = 0 OR toxic = 1) AS bad, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def quality_split(spark, sf_dir):
    """FLT8, SET5: labelled and unlabelled items in one pass."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    count = lambda e: F.count_if(F.expr(e))
    return d.agg(count("quality = 1 AND toxic = 0").alias("good"), count("quality = 0 OR toxic = 1").alias("bad"), count("quality IS NULL").alias("unlabelled"))


@query(f"WITH {ITEMS} SELECT id, title, category, (SELECT count(*) FROM items WHERE topic = 'en') AS total FROM items WHERE topic = 'en' ORDER BY items.day DESC, id LIMIT 20 OFFSET 40")
def paginated_items(spark, sf_dir):
    """PRJ1, PRJ2: a page in a total order, with the total before paging."""
    en = items(spark, sf_dir).where("topic = 'en'")
    page = en.orderBy(F.desc("day"), "id").offset(40).limit(20).select("id", "title", "category")
    return page.join(F.broadcast(en.agg(F.count("*").alias("total"))))


@query("SELECT page_id, CASE WHEN length(url) > 40 THEN left(url, 40) || '...' ELSE url END AS shown FROM pages")
def url_truncate(spark, sf_dir):
    """PRJ3: long URLs cut for display."""
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.length("url") > 40, F.concat(F.left("url", F.lit(40)), F.lit("..."))).otherwise(F.col("url")).alias("shown"))


@query("SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '5' THEN 'Low' ELSE 'Normal' END AS priority FROM orders")
def priority_labels(spark, sf_dir):
    """PRJ4: a label for each priority, Normal by default."""
    label = F.create_map(*[F.lit(x) for x in ("1", "Critical", "2", "High", "5", "Low")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(label[F.left("o_orderpriority", F.lit(1))], F.lit("Normal")).alias("priority"))


@query(f"WITH {ITEMS} SELECT category, id, strftime(day, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY category ORDER BY items.day DESC, id) AS rank FROM items QUALIFY rank <= 5")
def topn_per_category(spark, sf_dir):
    """WIN1: the five newest of each category."""
    rows = items(spark, sf_dir).select("category", "id", "day")
    return ranked(rows, ["category"], [F.desc("day"), "id"]).where("rank <= 5").withColumn("day", day_text())


@query(f"""
    WITH {ITEMS} SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY items.day, id) AS place,
        coalesce(strftime(items.day, '%Y-%m') <> lag(strftime(items.day, '%Y-%m')) OVER (PARTITION BY category ORDER BY items.day, id), true) AS new_month FROM items
""")
def month_sections(spark, sf_dir):
    """WIN2: running index within a category, and where a month begins."""
    rows = items(spark, sf_dir).select("id", "category", "day", F.date_format("day", "yyyy-MM").alias("month"))
    rows = looking_back(places(rows, ["category"], [F.col("day"), F.col("id")]), 1)
    before = F.lag("month").over(Window.partitionBy("category", "block").orderBy("place"))
    rows = rows.withColumn("new_month", F.coalesce(F.col("month") != before, F.lit(True)))
    return rows.where("own").select("id", "category", "place", "new_month")


@query("SELECT doc_id, md5(text) AS text_hash FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def keep_first_dedup(spark, sf_dir):
    """WIN3, JN8: the first of equal texts, by a grouped minimum instead of a window."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT url, max(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 100000, url FROM pages WHERE page_id % 2 = 0) GROUP BY url")
def keep_last_dedup(spark, sf_dir):
    """SET3, SNK12, SNK2: append, then keep the last of each link."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    both = pages.unionByName(pages.where("page_id % 2 = 0").withColumn("page_id", F.col("page_id") + 100000))
    return both.groupBy("url").agg(F.max("page_id").alias("page_id"), F.count("*").alias("copies"))


@query(f"WITH {ITEMS} SELECT id, category, unnest(courses) AS course FROM items")
def course_explode(spark, sf_dir):
    """AGG23: a row for each course reference."""
    return items(spark, sf_dir).select("id", "category", F.explode("courses").alias("course"))


@query(f"WITH {ITEMS}, e AS (SELECT id, category, unnest(courses) AS course FROM items) SELECT category, course, min(id) AS first_id FROM e GROUP BY ALL")
def course_first_per_category(spark, sf_dir):
    """AGG24: each course of a category once, with its first item."""
    return items(spark, sf_dir).select("id", "category", F.explode("courses").alias("course")).groupBy("category", "course").agg(F.min("id").alias("first_id"))


@query(f"WITH {ITEMS} SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent, array_to_string(list_sort(list_distinct(list(topic)))[1:3], ', ') AS topics FROM items GROUP BY category")
def category_report(spark, sf_dir):
    """AGG22, SNK10, SNK11: the summary sheet: count, share and up to three topics of a category."""
    by = items(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("topic")), 1, 3), ", ").alias("topics"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"), "topics")


@query(f"""
    WITH {ITEMS}, r AS (SELECT category, id, title, row_number() OVER (PARTITION BY category ORDER BY items.day DESC, id) AS rank FROM items)
    SELECT category, string_agg(CASE WHEN length(title) > 30 THEN left(title, 27) || '...' ELSE title END, ' | ' ORDER BY rank) AS titles FROM r WHERE rank <= 3 GROUP BY category
""")
def report_titles(spark, sf_dir):
    """AGG22, AGG25, SNK13, SNK21: the first titles of each category, cut and joined in order."""
    top = ranked(items(spark, sf_dir).select("category", "id", "title", "day"), ["category"], [F.desc("day"), "id"]).where("rank <= 3")
    cut = F.when(F.length("title") > 30, F.concat(F.left("title", F.lit(27)), F.lit("..."))).otherwise(F.col("title"))
    rows = F.array_sort(F.collect_list(F.struct("rank", cut.alias("t"))))
    return top.groupBy("category").agg(F.array_join(F.transform(rows, lambda r: r["t"]), " | ").alias("titles"))


@query(f"WITH {ITEMS} SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, min(id) AS first_id, CAST(sum(id) AS BIGINT) AS ids FROM items GROUP BY ALL")
def month_index(spark, sf_dir):
    """SNK4, SNK5: what the index file of each month holds."""
    return items(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("id").alias("ids"))


@query(f"WITH {ITEMS}, f AS (SELECT * FROM items WHERE topic IN ('en', 'de')) SELECT 'items-by-topics-en-de-' || count(*) || '-20240229.csv' AS filename, count(*) AS total FROM f")
def export_filename(spark, sf_dir):
    """SNK18: a filtered export and its file name."""
    f = items(spark, sf_dir).where(F.col("topic").isin("en", "de")).agg(F.count("*").alias("total"))
    return f.select(F.format_string("items-by-topics-en-de-%d-20240229.csv", "total").alias("filename"), "total")


@query("SELECT source, max(CAST(regexp_extract(f, '_v(\\d+)', 1) AS INTEGER)) + 1 AS next FROM (SELECT source, source || '_v' || (doc_id % 50) || '.csv' AS f FROM documents) GROUP BY source")
def next_version(spark, sf_dir):
    """SNK14: the next version of a file name."""
    name = F.concat("source", F.lit("_v"), (F.col("doc_id") % 50).cast("string"), F.lit(".csv"))
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.max(F.regexp_extract(name, r"_v(\d+)", 1).cast("int")) + 1).alias("next"))


SAFE = lambda x: rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[<>:"/\\|?*]', '_', 'g'), '[^\w\s_.-]', '', 'g'), '\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g')"""


@query(f"WITH {ITEMS}, s AS (SELECT id, day, {SAFE('title')} AS t FROM items) SELECT id, 'item_' || strftime(day, '%Y%m%d') || '_' || left(CASE WHEN t = '' THEN 'untitled' ELSE t END, 30) || '_' || left(CAST(id AS VARCHAR), 8) || '.txt' AS filename FROM s")
def file_names(spark, sf_dir):
    """SNK15, SNK20, VAL4: safe file names from an item's fields."""
    x = F.regexp_replace("title", r'[<>:"/\\|?*]', "_")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^\w\s_.-]", ""), r"\s+", "_"), r"^[._]+|[._]+$", "")
    part = F.left(F.when(x == "", "untitled").otherwise(x), F.lit(30))
    return items(spark, sf_dir).select("id", F.concat(F.lit("item_"), F.date_format("day", "yyyyMMdd"), F.lit("_"), part, F.lit("_"), F.left(F.col("id").cast("string"), F.lit(8)), F.lit(".txt")).alias("filename"))


RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"{n}{k}" for n in ("COM", "LPT") for k in range(1, 10)])


@query(f"SELECT doc_id, f AS filename, f <> '' AND NOT regexp_matches(f, '[<>:\"/\\\\|?*]') AND upper(f) NOT IN ({', '.join(repr(r) for r in RESERVED)}) AS valid FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'com1' ELSE coalesce(string_split(text, ' ')[2], '') END AS f FROM documents)")
def filename_valid(spark, sf_dir):
    """VAL3: names that a file system takes; a text's second word, or an empty name."""
    name = F.when(F.col("doc_id") % 11 == 0, "com1").otherwise(F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"))
    return d.withColumn("valid", (F.col("filename") != "") & ~F.col("filename").rlike(r'[<>:"/\\|?*]') & ~F.upper("filename").isin(*RESERVED))


@query("SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(text) > 10000 THEN 'too long' WHEN coalesce(source, '') = '' THEN 'no category' END AS problem FROM documents")
def item_quarantine(spark, sf_dir):
    """VAL1, VAL2: the first rule that an item breaks; rows with a problem go to quarantine."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(F.length("text") > 10000, "too long").when(F.coalesce("source", F.lit("")) == "", "no category").alias("problem"))


@query(r"""
    SELECT doc_id, length(k) >= 20 AND NOT regexp_matches(lower(k), 'your_.*_key_here|replace_with_.*|enter_your_.*|api_key_here|xxx+|test_key') AS key_ok,
        length(k) >= 32 AND CAST(regexp_matches(k, '[A-Z]') AS INTEGER) + CAST(regexp_matches(k, '[a-z]') AS INTEGER) + CAST(regexp_matches(k, '[0-9]') AS INTEGER) + CAST(regexp_matches(k, '[!@#$%^&*()_+=\[\]{}|;:,.<>?-]') AS INTEGER) >= 3 AS strong,
        regexp_matches(k || '@example.com', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS email_ok
    FROM (SELECT doc_id, text AS k FROM documents)
""")
def credentials_valid(spark, sf_dir):
    """VAL5: format tests of keys and addresses."""
    k = F.col("text")
    kinds = sum((k.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]", r"[!@#$%^&*()_+=\[\]{}|;:,.<>?-]")), F.lit(0))
    placeholder = F.lower(k).rlike("your_.*_key_here|replace_with_.*|enter_your_.*|api_key_here|xxx+|test_key")
    email = F.concat(k, F.lit("@example.com")).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z")
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length(k) >= 20) & ~placeholder).alias("key_ok"), ((F.length(k) >= 32) & (kinds >= 3)).alias("strong"), email.alias("email_ok"))


@query("SELECT source AS directory, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(max(n_chars) AS BIGINT) AS largest FROM documents GROUP BY source")
def storage_sizes(spark, sf_dir):
    """AGG27: files and bytes by directory."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("directory")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.max("n_chars").alias("largest"))


#: Escapes of JSON strings: the backslash first, then what has a short form, then the other control characters.
SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
OTHER_CONTROLS = tuple((chr(k), f"\\u{k:04x}") for k in range(32) if chr(k) not in "\n\r\t\b\f")


def json_string(x):
    """A JSON string as Python's json.dumps(ensure_ascii=False) writes it; null for null."""
    out = x
    for c, escape in SHORT_ESCAPES:
        out = F.replace(out, F.lit(c), F.lit(escape))
    full = out
    for c, escape in OTHER_CONTROLS:
        full = F.replace(full, F.lit(c), F.lit(escape))
    out = F.when(x.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), full).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def _json_sql(c: str) -> str:
    """The SQL of json_string."""
    out = c
    for k, escape in SHORT_ESCAPES + OTHER_CONTROLS:
        out = f"replace({out}, chr({ord(k)}), '{escape}')"
    return f"coalesce('\"' || {out} || '\"', 'null')"


HASHED_SQL = f"""
    SELECT doc_id, left(sha256('{{"content":' || {_json_sql("text")} || ',"source":' || {_json_sql("source")} || ',"topic":' || {_json_sql("lang")} || '}}'), 16) AS content_hash FROM documents
"""


@query(HASHED_SQL, name="content_hash_all")
@query(HASHED_SQL)
def content_hash(spark, sf_dir):
    """HSH1, JSN1: 16 hexadecimal digits of the hash of every item's canonical JSON, whatever its characters."""
    fields = (("content", "text"), ("source", "source"), ("topic", "lang"))
    parts = [x for k, (name, c) in enumerate(fields) for x in (F.lit(f'{"," if k else "{"}"{name}":'), json_string(F.col(c)))]
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.left(F.sha2(F.concat(*parts, F.lit("}")), 256), F.lit(16)).alias("content_hash"))


@query("SELECT count(DISTINCT left(sha256(regexp_extract(url, '://([^/]*)', 1)), 16)) AS hashes, count(*) AS urls FROM pages")
def distinct_hashes(spark, sf_dir):
    """SET6: distinct hashes of repeated keys."""
    return table(spark, sf_dir, "pages").agg(F.count_distinct(F.left(F.sha2(F.regexp_extract("url", "://([^/]*)", 1), 256), F.lit(16))).alias("hashes"), F.count("*").alias("urls"))


@query(f"""
    WITH {ITEMS}, e AS (SELECT 'event' AS kind, event_id AS id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 5), i AS (SELECT 'item' AS kind, id, CAST(day AS TIMESTAMP) AS ts FROM items ORDER BY day DESC, id LIMIT 3)
    SELECT kind, id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT * FROM e UNION ALL SELECT * FROM i)
""")
def activity_feed(spark, sf_dir):
    """SET7: the last five events and the last three items."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "ts").orderBy(F.desc("ts"), "id").limit(5)
    i = items(spark, sf_dir).select(F.lit("item").alias("kind"), "id", F.col("day").cast("timestamp_ntz").alias("ts")).orderBy(F.desc("ts"), "id").limit(3)
    return e.unionByName(i).select("kind", "id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"WITH {ITEMS} SELECT id, array_to_string(list_filter([title, topic, category, array_to_string(courses, ', ')], lambda x: x <> ''), ' | ') AS joined FROM items")
def item_concat(spark, sf_dir):
    """PIP5: an item's fields as one text, without empty ones."""
    fields = F.array("title", "topic", "category", F.array_join("courses", ", "))
    return items(spark, sf_dir).select("id", F.array_join(F.filter(fields, lambda x: x != ""), " | ").alias("joined"))


@query("SELECT event_id, 'failed' || CASE WHEN user_id % 2 = 0 THEN ' (URL: u' || user_id || ')' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' (Status: ' || CAST(400 + event_id % 100 AS VARCHAR) || ')' ELSE '' END AS message FROM events")
def error_messages(spark, sf_dir):
    """TXT26: error messages with the details that are known."""
    url = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("(URL: u"), F.col("user_id").cast("string"), F.lit(")")))
    status = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("(Status: "), (400 + F.col("event_id") % 100).cast("string"), F.lit(")")))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.lit("failed"), url, status).alias("message"))
