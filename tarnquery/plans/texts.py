"""Queries over texts and URLs: cleaning, sentences, insights, summaries, courses, classification, URL algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnquery.functions import classify as C
from tarnquery.functions import html as H
from tarnquery.functions import text as T
from tarnquery.functions import urls as U
from tarnquery.plans.registry import query, table


def sql(pattern: str) -> str:
    """A SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"


STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
SENTENCES = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: {STRIP('s')}), lambda s: s <> '')"
WORDS = lambda x: rf"CASE WHEN {STRIP(x)} = '' THEN 0 ELSE len(regexp_split_to_array({STRIP(x)}, '\s+')) END"
FLUFF = lambda s: f"(regexp_matches(lower({s}), {sql(T.any_of(T.FLUFF))}) OR ({WORDS(s)}) < 4 OR regexp_matches({s}, '[!?]{{2,}}'))"
INDICATOR = lambda s, n=9: f"regexp_matches(lower({s}), {sql(T.any_of(T.INDICATORS[:n]))})"
SQUEEZE = lambda x: STRIP(rf"regexp_replace({x}, '\s+', ' ', 'g')")
CLEAN = SQUEEZE(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '#\w+', '', 'g'), '@\w+', '', 'g'), '{T.URL}', '', 'g')")
CUT = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE left({x}, {n - 3}) || '...' END"
KNOWLEDGE = f"list_filter({SENTENCES('text')}, lambda s: NOT {FLUFF('s')} AND ({INDICATOR('s')} OR length(s) > 20))"
KSENT = f"list_filter({SENTENCES('text')}, lambda s: length(s) >= 20 AND NOT regexp_matches(lower(s), {sql(T.any_of(T.FLUFF[:7]))}) AND ({INDICATOR('s', 8)} OR length(s) > 50))[1:5]"
INSIGHT = f"list_filter({SENTENCES('text')}, lambda s: length(s) >= 20 AND (regexp_matches(lower(s), {sql('|'.join(T.INSIGHTS))}) OR (length(s) > 50 AND NOT {FLUFF('s')})))"
RANKED = lambda n: f"list_transform(list_sort(list_transform({INSIGHT}, lambda s, i: {{'n': -length(s), 'i': i, 's': s}}))[1:{n}], lambda r: r.s)"
MATCHES = lambda x, patterns: "list_concat(" + ", ".join(f"regexp_extract_all(lower({x}), {sql(p)}, 1)" for p in patterns[:2]) + ")" if len(patterns) == 2 else "flatten([" + ", ".join(f"regexp_extract_all(lower({x}), {sql(p)}, 1)" for p in patterns) + "])"
HITS = lambda x, words: "(" + " + ".join(f"CAST(contains(lower({x}), {sql(w)}) AS INTEGER)" for w in words) + ")"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query(f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    """TXT1: white space squeezed, tags, mentions and URLs gone."""
    return docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, CAST(len({SENTENCES('text')}) AS BIGINT) AS n, {SENTENCES('text')}[1] AS first FROM documents")
def sentence_split(spark, sf_dir):
    """TXT2: sentences of a text."""
    s = T.sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0)).alias("first"))


@query(f"SELECT doc_id, CAST(len(list_filter({SENTENCES('text')}, lambda s: {FLUFF('s')})) AS BIGINT) AS fluff, CAST(len(list_filter({SENTENCES('text')}, lambda s: {INDICATOR('s')})) AS BIGINT) AS indicated FROM documents")
def fluff_filter(spark, sf_dir):
    """TXT3, TXT4: sentences that are fluff, and those with a knowledge indicator."""
    s = T.sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(s, lambda x: T.is_fluff(x))).cast("long").alias("fluff"), F.size(F.filter(s, lambda x: T.has_indicator(x))).cast("long").alias("indicated"))


@query(f"SELECT doc_id, array_to_string({KNOWLEDGE}, '. ') AS knowledge FROM documents")
def knowledge_filter(spark, sf_dir):
    """TXT5: the sentences worth keeping."""
    return docs(spark, sf_dir).select("doc_id", T.knowledge_text(F.col("text")).alias("knowledge"))


@query(f"SELECT doc_id, array_to_string({KSENT}, ' ') AS knowledge FROM documents")
def knowledge_sentences(spark, sf_dir):
    """TXT6, SRT3: the first five knowledge sentences."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.knowledge_sentences(F.col("text")), " ").alias("knowledge"))


@query(f"SELECT doc_id, array_to_string({RANKED(5)}, ' | ') AS insights FROM documents")
def key_insights(spark, sf_dir):
    """TXT7, SRT2: the five longest insights, in the text's order where equal."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.key_insights(F.col("text")), " | ").alias("insights"))


@query(f"WITH b AS (SELECT doc_id, text, array_to_string({RANKED(3)}, '. ') AS best FROM documents), c AS (SELECT doc_id, CASE WHEN best <> '' THEN best ELSE text END AS x FROM b) SELECT doc_id, {CUT('x', 200)} AS summary FROM c")
def summary(spark, sf_dir):
    """TXT8: joined insights or the text's start, at most 200 characters."""
    return docs(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(f"""
    WITH k AS (SELECT doc_id, ({KSENT})[1:3] AS s FROM documents), n AS (
        SELECT doc_id, s, CASE WHEN len(s) = 0 OR length(s[1]) > 200 THEN 0 WHEN len(s) = 1 OR length(s[1]) + length(s[2]) > 200 THEN 1
            WHEN len(s) = 2 OR length(s[1]) + length(s[2]) + length(s[3]) > 200 THEN 2 ELSE 3 END AS n FROM k)
    SELECT doc_id, CASE WHEN n = 0 THEN '' ELSE array_to_string(s[1:n], '. ') || '.' END AS summary FROM n
""")
def summary_greedy(spark, sf_dir):
    """TXT9: whole sentences while they fit in 200 characters."""
    return docs(spark, sf_dir).select("doc_id", T.greedy_summary(T.knowledge_sentences(F.col("text"))).alias("summary"))


TOPICS = ((r"(?:the|der|que|les)\s+(?:of|and|die|las)\s+([^.!?]+)",), (r"\b(?:that|das)\s+([^.!?]+)",))
TOPIC_SQL = f"list_filter(list_transform(flatten([{', '.join(f'regexp_extract_all(text, {sql(p)}, 1)' for ps in TOPICS for p in ps)}]), lambda s: {STRIP('s')}), lambda s: length(s) > 10 AND length(s) < 200)"


@query(f"""
    WITH m AS (SELECT doc_id, text, {TOPIC_SQL} AS found, list_filter(({SENTENCES('text')})[1:3], lambda s: length(s) > 20) AS plain FROM documents),
    c AS (SELECT doc_id, text, CASE WHEN len(found) > 0 THEN found ELSE plain END[1:2] AS s FROM m)
    SELECT doc_id, CASE WHEN len(s) > 0 THEN (CASE WHEN length(array_to_string(s, '. ')) > 300 THEN left(array_to_string(s, '. '), 300) || '...' ELSE array_to_string(s, '. ') END)
        WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary FROM c
""")
def topic_summary(spark, sf_dir):
    """TXT10: what patterns of a topic find, else the first sentences, else the text's start. Patterns are a parameter."""
    t = F.col("text")
    found = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), 1) for ps in TOPICS for p in ps]))
    found = F.filter(F.transform(found, T.strip), lambda s: (F.length(s) > 10) & (F.length(s) < 200))
    plain = F.filter(F.slice(T.sentences(t), 1, 3), lambda s: F.length(s) > 20)
    best = F.array_join(F.slice(F.when(F.size(found) > 0, found).otherwise(plain), 1, 2), ". ")
    long = lambda x, n: F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)
    return docs(spark, sf_dir).select("doc_id", F.when(best != "", long(best, 300)).otherwise(long(t, 200)).alias("summary"))


#: The invented prose has no courses, so a sentence made of a text's first words stands before the whole text.
COURSE_TEXT = "'A course on ' || left(text, 30) || '. Learn ' || lang || ' basics training! Certification in ' || source || ' and more. ' || text"
COURSES_SQL = f"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({MATCHES('t', T.COURSES)}, lambda c: {STRIP('c')}), lambda c: length(c) > 3))), ', ') AS courses
    FROM (SELECT doc_id, {COURSE_TEXT} AS t FROM documents)
"""


@query(COURSES_SQL, name="course_refs_all")
@query(COURSES_SQL)
def course_refs(spark, sf_dir):
    """TXT11, TXT13, SET2: course references of whole texts, distinct and sorted."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.course_refs(F.expr(COURSE_TEXT)), ", ").alias("courses"))


WIDE = SQUEEZE(rf"regexp_replace({STRIP('c')}, '[^\w\s&-]', '', 'g')")
COURSES_WIDE_SQL = rf"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform({MATCHES('t', T.COURSES_WIDE)}, lambda c: {WIDE}),
        lambda c: length(c) BETWEEN 3 AND 100 AND NOT regexp_matches(c, '^\d+$') AND c NOT IN ({', '.join(map(sql, T.NO_COURSE))})))), ', ') AS courses
    FROM (SELECT doc_id, {COURSE_TEXT} AS t FROM documents)
"""


@query(COURSES_WIDE_SQL, name="course_refs_wide_all")
@query(COURSES_WIDE_SQL)
def course_refs_wide(spark, sf_dir):
    """TXT12: course references of whole texts by seven patterns, cleaned and filtered."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.course_refs_wide(F.expr(COURSE_TEXT)), ", ").alias("courses"))


COURSE_LIST_SQL = f"""
    WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'None' ELSE text END AS c FROM documents)
    SELECT doc_id, CASE WHEN lower(c) IN ('none', 'n/a', '') THEN '' ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(c, '[,;]'), lambda c: {STRIP('c')}), lambda c: length(c) > 3 AND length(c) < 100), ' | ') END AS courses FROM t
"""


@query(COURSE_LIST_SQL, name="course_list_all")
@query(COURSE_LIST_SQL)
def course_list(spark, sf_dir):
    """TXT14: the list of courses that a whole text is."""
    c = F.when(F.col("doc_id") % 7 == 0, "None").otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.parse_courses(c), " | ").alias("courses"))


@query(f"""
    WITH f AS (SELECT doc_id, text, string_split(text, '.')[1] AS f FROM documents)
    SELECT doc_id, CASE WHEN text = '' THEN 'Post' WHEN length(f) > 10 THEN {CUT(STRIP('f'), 100)} WHEN length(text) > 100 THEN {CUT('text', 100)} ELSE {STRIP('text')} END AS title FROM f
""")
def title_from_content(spark, sf_dir):
    """TXT18: a title from the first sentence."""
    return docs(spark, sf_dir).select("doc_id", T.title(F.col("text")).alias("title"))


@query("""
    WITH t AS (SELECT event_id, CAST(user_id AS VARCHAR) || CASE WHEN event_id % 4 = 0 THEN '.5K likes' WHEN event_id % 4 = 1 THEN ' comments' WHEN event_id % 4 = 2 THEN 'M' ELSE ' shares' END AS t FROM events)
    SELECT event_id, t AS shown, CAST(round(CASE event_id % 4 WHEN 0 THEN 1000 * CAST(regexp_extract(t, '^[0-9.]+') AS DOUBLE) WHEN 2 THEN 1000000 * CAST(regexp_extract(t, '^[0-9.]+') AS DOUBLE) ELSE CAST(regexp_extract(t, '^[0-9.]+') AS DOUBLE) END) AS BIGINT) AS n FROM t
""")
def engagement_parse(spark, sf_dir):
    """TXT19: counts such as 1.2K."""
    k = F.col("event_id") % 4
    shown = F.concat(F.col("user_id").cast("string"), F.when(k == 0, ".5K likes").when(k == 1, " comments").when(k == 2, "M").otherwise(" shares"))
    return table(spark, sf_dir, "events").select("event_id", shown.alias("shown"), T.engagement(shown).alias("n"))


@query("SELECT doc_id, 'Extract the key knowledge of this text:' || chr(10) || left(text, 1000) || chr(10) || 'Answer in ' || lang || '.' AS prompt FROM documents")
def prompt_template(spark, sf_dir):
    """TXT20, SRC13: prompts for an annotator; the annotator itself is a mapInPandas hook."""
    return docs(spark, sf_dir).select("doc_id", F.format_string("Extract the key knowledge of this text:\n%s\nAnswer in %s.", F.left("text", F.lit(1000)), "lang").alias("prompt"))


REPLY = "'KNOWLEDGE: ' || text || chr(10) || 'more of it' || chr(10) || 'TOPIC: ' || lang || chr(10) || 'SUMMARY: ' || source"


@query(f"""
    SELECT doc_id, {SQUEEZE("text || ' more of it'")} AS knowledge, lang AS topic, '' AS courses, source AS summary FROM documents
""")
def reply_sections(spark, sf_dir):
    """TXT16: sections of an annotator's reply, with continuation lines."""
    reply = F.expr(REPLY.replace("chr(10)", "char(10)"))
    return docs(spark, sf_dir).select("doc_id", *[T.reply_section(reply, n.upper()).alias(n) for n in ("knowledge", "topic", "courses", "summary")])


@query("""
    WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'AI & Machine Learning' WHEN 1 THEN 'saas' WHEN 2 THEN 'Gardening' ELSE 'course content' END AS c,
        CASE doc_id % 3 WHEN 0 THEN '0.9' WHEN 1 THEN 'high' ELSE '0.35' END AS f FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'AI & Machine Learning' WHEN 1 THEN 'SaaS & Business' WHEN 2 THEN 'Other' ELSE 'Course Content' END AS category,
        round(CASE WHEN doc_id % 4 = 2 THEN 0.3 ELSE coalesce(TRY_CAST(f AS DOUBLE), 0.5) * CASE WHEN doc_id % 4 = 1 THEN 0.8 ELSE 1 END END, 6) AS confidence FROM r
""")
def reply_category(spark, sf_dir):
    """TXT17, ARR2: the category named by a reply; a partial name counts 0.8, none 0.3, a bad number 0.5."""
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN 'AI & Machine Learning' WHEN 1 THEN 'saas' WHEN 2 THEN 'Gardening' ELSE 'course content' END")
    sure = F.expr("CASE doc_id % 3 WHEN 0 THEN '0.9' WHEN 1 THEN 'high' ELSE '0.35' END")
    reply = F.concat(F.lit("CATEGORY: "), name, F.lit("\nCONFIDENCE: "), sure)
    said, number = F.regexp_extract(reply, r"CATEGORY:\s*([^\n]*)", 1), F.regexp_extract(reply, r"CONFIDENCE:\s*([^\n]*)", 1).try_cast("double")
    number = F.coalesce(number, F.lit(0.5))
    exact, partial = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(C.CATEGORIES):
        exact = F.when(F.lower(said) == c.lower(), c).otherwise(exact)
        partial = F.when(F.lit(c.lower()).contains(F.lower(said)) | F.lower(said).contains(c.lower()), c).otherwise(partial)
    confidence = F.when(exact.isNotNull(), number).when(partial.isNotNull(), number * 0.8).otherwise(0.3)
    return docs(spark, sf_dir).select("doc_id", F.coalesce(exact, partial, F.lit("Other")).alias("category"), F.round(confidence, 6).alias("confidence"))


@query(f"""
    WITH w AS (SELECT source, unnest(list_filter(regexp_split_to_array({STRIP('lower(text)')}, '\\s+'), lambda w: length(w) > 3 AND w NOT IN ({', '.join(map(sql, T.STOP_WORDS))}))) AS word FROM documents),
    c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL)
    SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 10
""")
def keyword_top10(spark, sf_dir):
    """AGG28, TXT24, SRT4: the ten most frequent keywords of each category."""
    counts = docs(spark, sf_dir).select("source", F.explode(T.keywords(F.col("text"))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    return top_k(counts, ["source"], [F.desc("n"), F.asc("word")], 10)


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
    WITH k AS (SELECT doc_id, {KNOWLEDGE} AS s FROM documents), j AS (SELECT doc_id, array_to_string(s, '. ') AS t FROM k),
    p AS (SELECT doc_id, t, regexp_split_to_array(t, '[.!?]+') AS parts FROM j)
    SELECT doc_id, length(t) >= 50 AND len(list_filter(parts, lambda s: {FLUFF('s')})) <= 0.5 * len(parts) AS valid FROM p
""")
def extraction_valid(spark, sf_dir):
    """VAL6: extracted knowledge is long enough and mostly no fluff."""
    kept = docs(spark, sf_dir).select("doc_id", T.knowledge_text(F.col("text")).alias("t")).withColumn("parts", F.split("t", r"[.!?]+"))
    return kept.select("doc_id", ((F.length("t") >= 50) & (F.size(F.filter("parts", lambda x: T.is_fluff(x))) <= 0.5 * F.size("parts"))).alias("valid"))


SCORE = lambda c: f"CAST({HITS('text', C.SYLLABLES[c][0])} * 2 + {HITS('text', C.SYLLABLES[c][1])} AS DOUBLE) / ({0.1 * sum(map(len, C.SYLLABLES[c]))} + ({WORDS('text')}) * CAST(0.01 AS DOUBLE))"
BEST = f"list_max([{', '.join(f'''{{'score': {SCORE(c)}, 'k': {-k}, 'name': {sql(c)}}}''' for k, c in enumerate(C.SYLLABLES))}])"


@query(f"""
    WITH b AS (SELECT doc_id, text, {BEST} AS b FROM documents)
    SELECT doc_id, CASE WHEN b.score <= 0 OR least(b.score / 10, 1) < 0.2 THEN 'Other' ELSE b.name END AS category, round(CASE WHEN b.score <= 0 THEN 0.1 ELSE least(b.score / 10, 1) END, 6) AS confidence FROM b
""")
def rule_category(spark, sf_dir):
    """CLS1: weighted keyword scores against lexicon and text size, with a lexicon that fits the invented prose."""
    c = F.col("text")
    top = C.weighted_class(c, C.SYLLABLES)
    return docs(spark, sf_dir).select("doc_id", top["category"].alias("category"), F.round(top["confidence"], 6).alias("confidence"))


COUNT_BEST = lambda lex: f"list_max([{', '.join(f'''{{'score': {HITS('text', w)}, 'k': {-k}, 'name': {sql(c)}}}''' for k, (c, w) in enumerate(lex.items()))}])"


@query(f"WITH b AS (SELECT doc_id, {COUNT_BEST(C.COUNTED)} AS b FROM documents) SELECT doc_id, CASE WHEN b.score > 0 THEN b.name ELSE 'General' END AS topic FROM b")
def keyword_scores(spark, sf_dir):
    """CLS2, CLS3: the class with most keywords."""
    return docs(spark, sf_dir).select("doc_id", C.counted_class(F.col("text")).alias("topic"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), {sql('|'.join(w))}) THEN {sql(c)}" for c, w in C.FIRST_MATCH.items()) + " ELSE 'Other' END AS category FROM documents")
def first_match_category(spark, sf_dir):
    """CLS4, CLS5: the first class with a keyword."""
    return docs(spark, sf_dir).select("doc_id", C.first_class(F.col("text")).alias("category"))


@query(f"""
    WITH b AS (SELECT doc_id, text, {BEST} AS b, CASE doc_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.2 END AS sure FROM documents),
    r AS (SELECT doc_id, sure, CASE WHEN b.score <= 0 OR least(b.score / 10, 1) < 0.2 THEN 'Other' ELSE b.name END AS rule, CASE WHEN b.score <= 0 THEN 0.1 ELSE least(b.score / 10, 1) END AS c FROM b)
    SELECT doc_id, CASE WHEN sure >= 0.4 THEN 'annotated' ELSE rule END AS category, round(CASE WHEN sure >= 0.4 THEN sure ELSE c END, 6) AS confidence,
        CASE WHEN CASE WHEN sure >= 0.4 THEN sure ELSE c END < 0.2 THEN 4 WHEN CASE WHEN sure >= 0.4 THEN sure ELSE c END < 0.4 THEN 2 ELSE 0 END + CASE WHEN sure IS NULL OR sure < 0.4 THEN CASE WHEN rule = 'Other' THEN 2 ELSE 0 END ELSE 0 END AS suggestions FROM r
""")
def hybrid_category(spark, sf_dir):
    """CLS6, CLS7: an annotator's class if sure enough, else the rules'; how many suggestions its confidence earns."""
    sure = F.expr("CAST(CASE doc_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.2 END AS DOUBLE)")
    rule = C.weighted_class(F.col("text"), C.SYLLABLES)
    use = F.coalesce(sure >= 0.4, F.lit(False))
    category, confidence = F.when(use, "annotated").otherwise(rule["category"]), F.when(use, sure).otherwise(rule["confidence"])
    hints = F.when(confidence < 0.2, 4).when(confidence < 0.4, 2).otherwise(0) + F.when(category == "Other", 2).otherwise(0)
    return docs(spark, sf_dir).select("doc_id", category.alias("category"), F.round(confidence, 6).alias("confidence"), hints.alias("suggestions"))


@query(f"""
    SELECT doc_id, len({SENTENCES('c')}) AS sentences, array_to_string(list_filter({SENTENCES('c')}, lambda s: NOT {FLUFF('s')} AND ({INDICATOR('s')} OR length(s) > 20)), '. ') AS knowledge,
        length(text) AS original_length FROM (SELECT doc_id, text, {CLEAN} AS c FROM documents)
""")
def extract_knowledge(spark, sf_dir):
    """PIP1: clean, split, filter in one projection."""
    d = docs(spark, sf_dir).withColumn("c", T.clean_text(F.col("text")))
    return d.select("doc_id", F.size(T.sentences(F.col("c"))).cast("long").alias("sentences"), T.knowledge_text(F.col("c")).alias("knowledge"), F.length("text").cast("long").alias("original_length"))


@query(f"""
    WITH p AS (SELECT doc_id, text, {KSENT} AS s, {COUNT_BEST(C.COUNTED)} AS b FROM documents),
    t AS (SELECT doc_id, array_to_string(s, ' ') AS knowledge, CASE WHEN b.score > 0 THEN b.name ELSE 'General' END AS topic FROM p)
    SELECT doc_id, topic, CASE {' '.join(f"WHEN regexp_matches(lower(topic), {sql('|'.join(w))}) THEN {sql(c)}" for c, w in C.FIRST_MATCH.items())} ELSE 'Other' END AS category,
        length(knowledge) >= 30 AND topic <> 'General' AS valid FROM t
""")
def process_post(spark, sf_dir):
    """PIP2, VAL7: the rule path of processing a post, and whether the extraction counts as valid."""
    t = F.col("text")
    d = docs(spark, sf_dir).select("doc_id", F.array_join(T.knowledge_sentences(t), " ").alias("knowledge"), C.counted_class(t).alias("topic"))
    return d.select("doc_id", "topic", C.first_class(F.col("topic")).alias("category"), ((F.length("knowledge") >= 30) & (F.col("topic") != "General")).alias("valid"))


@query(r"""
    WITH w AS (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    SELECT page_id, CASE WHEN title = '' THEN 'Article' ELSE title END AS title, len(regexp_extract_all(html, '<p[^>]*>')) AS paragraphs, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS links FROM w
""")
def html_fields(spark, sf_dir):
    """SRC8, SRC9: title with a default, paragraphs and links of a page's HTML."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.when(title == "", "Article").otherwise(title).alias("title"), count(r"<p[^>]*>").alias("paragraphs"), count(r'<a\s[^>]*href="([^"]*)"').alias("links"))


#: Where the fields of a page are found, in order.
SELECTORS = {
    "title": ("h1", ".title", "title"), "author": (".author", "a[rel=author]", "[itemprop=author]"),
    "content": ("article", "main", "[role=main]", ".content"), "body": ("body",),
}
_ENTITIES = "replace(" * len(H.ENTITIES) + "{}" + "".join(f", {sql(a)}, {sql(b)})" for a, b in H.ENTITIES)
_BREAKS = "(?:" + "|".join(H.BREAKS) + ")"


def _text_sql(x: str) -> str:
    """The text of well-formed HTML: breaks become blanks, other tags go."""
    dark = rf"regexp_replace({x}, '(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)>', '', 'g')"
    bare = rf"regexp_replace(regexp_replace({dark}, '(?i)</?{_BREAKS}\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
    return rf"trim(regexp_replace({_ENTITIES.format(bare)}, '[\s\x{{a0}}]+', ' ', 'g'))"


@query(rf"""
    WITH p AS (SELECT page_id, {_text_sql("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, {_text_sql("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS t,
        {_text_sql("regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1)")} AS article, {_text_sql("regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1)")} AS body,
        regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS links FROM pages)
    SELECT page_id, coalesce(nullif(h1, ''), nullif(t, ''), 'Article') AS title, 'Unknown' AS author, coalesce(nullif(article, ''), left(body, 1000)) AS content,
        article <> '' AS selected, array_to_string(links, ' ') AS links, 0 AS images FROM p
""")
def page_content(spark, sf_dir):
    """SRC8, SRC9, SRC10: title, author and content of a page by lists of selectors, the first 1,000 characters of the body
    where none fits; its links and images."""
    page = table(spark, sf_dir, "pages").select("page_id", H.fields(F.col("html"), SELECTORS).alias("f"), H.elements(F.col("html"), "a", "href").alias("a"), H.elements(F.col("html"), "img", "src", "alt").alias("img"))
    links = F.array_join(F.transform("a", lambda x: x["href"]), " ")
    return page.select(
        "page_id", F.coalesce("f.title", F.lit("Article")).alias("title"), F.coalesce("f.author", F.lit("Unknown")).alias("author"),
        F.coalesce("f.content", F.left("f.body", F.lit(1000))).alias("content"), F.col("f.content").isNotNull().alias("selected"),
        links.alias("links"), F.size(F.filter("img", lambda x: U.is_image_url(x["src"]))).alias("images"),
    )


@query("""
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), 1) - 1 AS i FROM pages)
    SELECT page_id, i, href, 'item_' || page_id || '_' || i || '.jpg' AS filename, NOT starts_with(href, 'data:') AND NOT contains(lower(href), 'svg') AND regexp_matches(lower(href), '\\.jpg|\\.jpeg|\\.png|\\.gif|\\.webp') AS is_image FROM a
""")
def element_scan(spark, sf_dir):
    """SRC10, SRC11: linked elements of a page by place, their file name, and whether they are images."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("i", "href"))
    return found.select("page_id", F.col("i").cast("long").alias("i"), "href", F.format_string("item_%d_%d.jpg", "page_id", "i").alias("filename"), U.is_image_url(F.col("href")).alias("is_image"))


AUTH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
SCHEME = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
DROP = ", ".join(map(sql, U.PAGES.tracking))
KEPT = f"array_to_string(list_filter(string_split({QUERY}, '&'), lambda p: regexp_matches(p, '=.') AND string_split(p, '=')[1] NOT IN ({DROP})), '&')"
CLEANED = f"""(SELECT page_id, url, CASE WHEN lower({AUTH}) IN ({', '.join(map(sql, U.PAGES.hosts()))}) THEN
    regexp_replace({SCHEME} || '://' || {AUTH} || {PATH} || CASE WHEN {KEPT} <> '' THEN '?' || {KEPT} ELSE '' END, '/$', '') END AS cleaned FROM pages)"""
POST = "regexp_extract(cleaned, '^https?://(?:www\\.)?example\\.com/[a-z]{2}/(\\d+)', 1)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query(f"SELECT page_id, cleaned FROM {CLEANED}")
def url_clean(spark, sf_dir):
    """URL2: cleaned URLs of the site's hosts."""
    return pages(spark, sf_dir).select("page_id", U.clean_url(F.col("url"), U.PAGES).alias("cleaned"))


@query(f"SELECT page_id, CASE WHEN {POST} <> '' THEN 'page' END AS type, CASE WHEN {POST} <> '' THEN {POST} END AS post_id FROM {CLEANED}")
def url_parse(spark, sf_dir):
    """URL1: type and id of a post's URL."""
    post = U.parse_url(F.col("url"), U.PAGES)
    return pages(spark, sf_dir).select("page_id", post["type"].alias("type"), post["post_id"].alias("post_id"))


@query(f"SELECT page_id, url, CASE WHEN cleaned IS NULL THEN 'not of the site' WHEN coalesce({POST}, '') = '' THEN 'no known pattern' END AS error FROM {CLEANED}")
def url_valid_split(spark, sf_dir):
    """URL3, FLT9, PIP9: valid URLs and the reason for the others, in one pass."""
    cleaned, post = U.clean_url(F.col("url"), U.PAGES), U.parse_url(F.col("url"), U.PAGES)
    return pages(spark, sf_dir).select("page_id", "url", F.when(cleaned.isNull(), "not of the site").when(post.isNull(), "no known pattern").alias("error"))


@query(f"""
    SELECT page_id, CASE WHEN {QUERY} = '' THEN url ELSE {SCHEME} || '://' || {AUTH} || {PATH} || CASE WHEN k <> '' THEN '?' || k ELSE '' END END AS normalized
    FROM (SELECT page_id, url, array_to_string(list_filter(string_split({QUERY}, '&'), lambda p: contains(p, '=') AND string_split(p, '=')[1] NOT IN ({', '.join(map(sql, U.UTM))})), '&') AS k FROM pages)
""")
def url_normalize(spark, sf_dir):
    """URL4, URL12: without campaign parameters."""
    return pages(spark, sf_dir).select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


@query("SELECT page_id, nullif(coalesce(nullif(regexp_extract(url, '/es/(\\d+)', 1), ''), nullif(regexp_extract(url, '/de/(\\d+)', 1), ''), regexp_extract(url, '/en/([^/?#]+)', 1)), '') AS post_id FROM pages")
def url_post_id(spark, sf_dir):
    """URL5: the id by the first of several patterns."""
    get = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return pages(spark, sf_dir).select("page_id", F.coalesce(*[get(p) for p in (r"/es/(\d+)", r"/de/(\d+)", r"/en/([^/?#]+)")]).alias("post_id"))


@query(f"SELECT page_id, CASE WHEN {POST} <> '' THEN 'page:' || {POST} ELSE 'url:' || md5(url) END AS key FROM {CLEANED}")
def url_cache_key(spark, sf_dir):
    """URL6: type and id, else a hash of the URL."""
    return pages(spark, sf_dir).select("page_id", U.cache_key(F.col("url"), U.PAGES).alias("key"))


@query(f"SELECT page_id, left(sha256(CASE WHEN {POST} <> '' THEN cleaned ELSE url END), 16) AS url_hash FROM {CLEANED}")
def url_hash(spark, sf_dir):
    """URL7: 16 hexadecimal digits of the cleaned or raw URL's hash."""
    return pages(spark, sf_dir).select("page_id", U.url_hash(F.col("url"), U.PAGES).alias("url_hash"))


@query(f"SELECT page_id, regexp_replace({AUTH}, '[-_]', ' ', 'g') AS hint FROM pages")
def author_hint(spark, sf_dir):
    """URL8, URL11: a readable name from an id."""
    return pages(spark, sf_dir).select("page_id", U.author_hint(U.parts(F.col("url"))["authority"]).alias("hint"))


@query(f"SELECT coalesce(nullif({AUTH}, ''), 'unknown') AS domain, count(*) AS n FROM pages GROUP BY ALL")
def domain_counts(spark, sf_dir):
    """URL9, AGG5: pages by host."""
    return pages(spark, sf_dir).groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '.png' WHEN regexp_matches(lower({PATH}), '\\.(jpg|jpeg|png|gif|webp|bmp)$') THEN '.' || regexp_extract(lower({PATH}), '\\.([a-z]+)$', 1) ELSE '.jpg' END AS extension FROM pages")
def image_extension(spark, sf_dir):
    """URL10: by file name, else by URL, else .jpg."""
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a."), F.lit("PNG"))).otherwise("noname")
    return pages(spark, sf_dir).select("page_id", U.image_extension(name, F.col("url")).alias("extension"))


@query(f"SELECT page_id, contains(url, 'example.com') AS naive, {AUTH} = 'www.example.com' AND regexp_matches({PATH}, '/en/|/es/') AS strict FROM pages")
def url_predicates(spark, sf_dir):
    """FLT10, FLT11: two cheap tests of a URL."""
    p = U.parts(F.col("url"))
    return pages(spark, sf_dir).select("page_id", F.col("url").contains("example.com").alias("naive"), ((p["authority"] == "www.example.com") & p["path"].rlike("/en/|/es/")).alias("strict"))


@query(r"SELECT page_id, CASE WHEN contains(lower(url), 'casino') OR contains(lower(url), 'bets') THEN 'Games' WHEN contains(lower(url), 'th') THEN 'Insights' ELSE 'Professional growth' END AS title, regexp_extract(url, '/(\d+)', 1) AS post_id FROM pages")
def demo_content(spark, sf_dir):
    """SRC16, PIP7: content chosen by words of the URL."""
    low = F.lower("url")
    return pages(spark, sf_dir).select("page_id", F.when(low.contains("casino") | low.contains("bets"), "Games").when(low.contains("th"), "Insights").otherwise("Professional growth").alias("title"), F.regexp_extract("url", r"/(\d+)", 1).alias("post_id"))


ALTS = "list_filter(string_split(text, '. '), lambda s: s <> '')"
ALT_TEXT = SQUEEZE("regexp_replace(regexp_replace(a, 'No alternative text description for this image', '', 'gi'), 'Image may contain:', '', 'gi')")


@query(f"""
    SELECT doc_id, array_to_string(list_transform({ALTS}, lambda a, i: 'Image ' || i || ': ' || CASE WHEN length(a) > 10 THEN (CASE WHEN length({ALT_TEXT}) > 10 THEN {ALT_TEXT} ELSE '' END) ELSE 'Visual content (infographic/chart/diagram)' END), '; ') AS insights FROM documents
""")
def image_insights(spark, sf_dir):
    """TXT15: what the alternative texts of a post's images say, numbered."""
    alts = F.filter(F.split("text", r"\. "), lambda s: s != "")
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(alts, lambda a, i: T.image_insight(a, i + 1)), "; ").alias("insights"))


@query(f"""
    WITH k AS (SELECT doc_id, lang, text, {STRIP("array_to_string(string_split(text, '.')[1:3], '. ')")} AS k FROM documents)
    SELECT doc_id, CASE WHEN k <> '' AND NOT ends_with(k, '.') THEN k || '.' ELSE k END AS knowledge,
        CASE WHEN contains(lower(text), 'thing') THEN 'Basics, Practice' WHEN contains(lower(text), 'ation') THEN 'Theory' WHEN lang = 'en' THEN 'English' ELSE 'General' END AS courses FROM k
""")
def demo_knowledge(spark, sf_dir):
    """TXT21, TXT22: knowledge of the first sentences, courses by keyword, else by category."""
    k = T.strip(F.array_join(F.slice(F.split("text", r"\."), 1, 3), ". "))
    low = F.lower("text")
    courses = F.when(low.contains("thing"), "Basics, Practice").when(low.contains("ation"), "Theory").when(F.col("lang") == "en", "English").otherwise("General")
    return docs(spark, sf_dir).select("doc_id", F.when((k != "") & ~k.endswith("."), F.concat(k, F.lit("."))).otherwise(k).alias("knowledge"), courses.alias("courses"))


TITLED_SQL = r"""
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '\p{L}+|\P{L}+'), lambda w: CASE WHEN left(w, 1) = 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END || substr(w, 2)), '') AS titled FROM documents
"""


@query(TITLED_SQL, name="title_case_all")
@query(TITLED_SQL)
def title_case(spark, sf_dir):
    """TXT23: capitals after every character that isn't a letter; a sharp s there becomes Ss."""
    return docs(spark, sf_dir).select("doc_id", T.title_case(F.col("text")).alias("titled"))


@query("""
    SELECT event_id, strftime(CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-01-31' ELSE ts END, '%Y-%m-%d %H:%M:%S') AS posted, CAST(user_id AS BIGINT) AS likes, CAST(0 AS BIGINT) AS shares FROM events
""")
def post_dates(spark, sf_dir):
    """TXT25: a post's date from its ISO attribute, else a given time, and its engagement record."""
    iso = F.when(F.col("event_id") % 5 == 0, "unknown").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    at = F.coalesce(F.try_to_timestamp(iso), F.lit("2024-01-31").cast("timestamp"))
    record = F.struct(T.engagement(F.concat(F.col("user_id").cast("string"), F.lit(" likes"))).alias("likes"), T.engagement(F.lit("")).alias("shares"))
    e = table(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("posted"), record.alias("r"))
    return e.select("event_id", "posted", "r.likes", "r.shares")


@query("SELECT p.page_id, d.doc_id IS NULL AS orphan FROM (SELECT page_id, 'item_' || (page_id * 3) || '_image.jpg' AS f FROM pages) p LEFT JOIN documents d ON CAST(regexp_extract(f, 'item_(\\d+)_', 1) AS BIGINT) = d.doc_id")
def orphan_files(spark, sf_dir):
    """VAL8: files whose name stands for no item."""
    name = F.concat(F.lit("item_"), (F.col("page_id") * 3).cast("string"), F.lit("_image.jpg"))
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(name, r"item_(\d+)_", 1).cast("long").alias("doc_id"))
    known = docs(spark, sf_dir).select("doc_id", F.lit(True).alias("known")).distinct()
    return p.join(known, "doc_id", "left").select("page_id", F.col("known").isNull().alias("orphan"))
