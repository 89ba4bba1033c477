"""Queries for personal data: counts, redaction, masks, pseudonyms, risk, and full detection with spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnquery.functions import pii as P
from tarnquery.plans.registry import query, table
from tarnquery.plans.texts import sql

BOUND = lambda p: rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"
EMAILS = f"regexp_extract_all(text, {sql(rf'\b{P.EMAIL}\b')})"
PHONES = f"regexp_extract_all(text, {sql(P.PHONE)})"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


@query(rf"SELECT doc_id, len({EMAILS}) AS emails, len({PHONES}) AS phones, len(regexp_extract_all(text, '\b\d{{3}}-\d{{2}}-\d{{4}}\b')) AS ssns, len(regexp_extract_all(text, '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b')) AS ips FROM documents")
def pii_counts(spark, sf_dir):
    """PII1, AGG20: matches of the plain patterns, counted without spans. Texts without the digits that each number holds
    aren't searched for numbers; what a match starts with is looked at first."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    digits = F.col("text").rlike(r"[0-9]{3}|[0-9]\.[0-9]")
    number = lambda first, p: F.when(digits, n(first + p)).when(F.col("text").isNotNull(), 0)
    phones, ssns, ips = number(P.FIRST["phone"], P.PHONE), number("(?=[0-9])", BOUND(r"\d{3}-\d{2}-\d{4}")), number("(?=[0-9])", BOUND(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"))
    return docs(spark, sf_dir).select("doc_id", n(P.EMAIL_END).alias("emails"), phones.alias("phones"), ssns.alias("ssns"), ips.alias("ips"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, {sql(rf'\b{P.EMAIL}\b')}, '[EMAIL_REDACTED]', 'g'), {sql(P.PHONE)}, '[PHONE_REDACTED]', 'g') AS redacted FROM documents")
def pii_redact_simple(spark, sf_dir):
    """PII12: addresses and numbers replaced by fixed words."""
    return docs(spark, sf_dir).select("doc_id", P.redact(F.col("text")).alias("redacted"))


@query(f"""
    WITH e AS (SELECT doc_id, unnest({EMAILS}) AS email FROM documents), p AS (SELECT *, string_split(email, '@')[1] AS u, string_split(email, '@')[2] AS h FROM e)
    SELECT doc_id, email, CASE WHEN length(u) > 1 THEN left(u, 1) || repeat('*', length(u) - 1) ELSE '*' END || '@' || left(h, 1) || repeat('*', length(string_split(h, '.')[1]) - 1) || '.' || regexp_extract(h, '\\.(.*)$', 1) AS masked FROM p
""")
def pii_mask_email(spark, sf_dir):
    """PII5: masked addresses."""
    e = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(BOUND(P.EMAIL)), 0)).alias("email"))
    return e.select("doc_id", "email", P.mask(F.lit("email"), F.col("email")).alias("masked"))


@query(f"WITH e AS (SELECT doc_id, unnest({EMAILS}) AS email FROM documents) SELECT doc_id, email, '[EMAIL_' || left(sha256(email), 8) || ']' AS hashed, '[EMAIL_ADDRESS]' AS placeholder FROM e")
def pii_hash(spark, sf_dir):
    """PII6, PII7: hashed addresses and placeholders."""
    e = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(BOUND(P.EMAIL)), 0)).alias("email"))
    return e.select("doc_id", "email", P.hashed(F.lit("email"), F.col("email")).alias("hashed"), P.placeholder(F.lit("email")).alias("placeholder"))


@query(f"""
    WITH e AS (SELECT doc_id, unnest({EMAILS}) AS email FROM documents), f AS (SELECT email, min(doc_id) AS first_id FROM e GROUP BY email)
    SELECT email, first_id, 'user' || row_number() OVER (ORDER BY first_id, email) || '@example.com' AS pseudonym FROM f
""")
def pii_pseudonym(spark, sf_dir):
    """PII8: one pseudonym for each address, numbered by first occurrence.

    The number is a running count within a range of ids plus the counts of the ranges before, so no task sees all
    addresses.
    """
    e = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(BOUND(P.EMAIL)), 0)).alias("email"))
    first = e.groupBy("email").agg(F.min("doc_id").alias("first_id")).withColumn("part", F.floor(F.col("first_id") / 1_000_000))
    from pyspark.sql import Window

    sizes = first.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = first.join(F.broadcast(before), "part").withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("first_id", "email")) + F.col("before"))
    return placed.select("email", "first_id", F.concat(F.lit("user"), F.col("k").cast("string"), F.lit("@example.com")).alias("pseudonym"))


@query(f"""
    WITH c AS (SELECT doc_id, source, len({EMAILS}) AS e, len({PHONES}) AS p FROM documents)
    SELECT source, count(*) FILTER (e > 0) AS high, count(*) FILTER (e = 0 AND p > 3) AS medium, count(*) FILTER (e = 0 AND p <= 3) AS low, CAST(sum(e + p) AS BIGINT) AS matches, count(*) FILTER (e + p = 0) AS safe FROM c GROUP BY source
""")
def pii_risk(spark, sf_dir):
    """Risk of the texts of each source, from counted patterns."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    c = docs(spark, sf_dir).select("source", n(BOUND(P.EMAIL)).alias("e"), n(P.PHONE).alias("p"))
    e, p = F.col("e"), F.col("p")
    return c.groupBy("source").agg(
        F.count_if(e > 0).alias("high"), F.count_if((e == 0) & (p > 3)).alias("medium"), F.count_if((e == 0) & (p <= 3)).alias("low"),
        F.sum((e + p).cast("long")).alias("matches"), F.count_if(e + p == 0).alias("safe"))


def _either(words) -> str:
    """An alternation of words in either case of ASCII letters."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


#: Characters that are parts of words beyond ASCII, and what marks an underscore of the text.
OTHER_WORD, UNDERSCORE = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]", "\\x{E000}"
_LOCAL = f"(?:[A-Za-z0-9.%+-]|_{UNDERSCORE})*@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b"
#: DuckDB's expressions know edges of ASCII words only. So characters of other words become underscores, and for addresses,
#: which may hold underscores, those of the text are marked. An address starts where a word does, or behind one.
_ADDRESS = rf"((?:[A-Za-z0-9]|_{UNDERSCORE}){_LOCAL}|\b[.%+-]{_LOCAL})|_[A-Za-z0-9_{UNDERSCORE}]*([.%+-]{_LOCAL})?"


def _raw_sql(no: int, kind: str, pattern: str, base: float) -> str:
    """Places of a pattern's matches in d (k, t, p, q): a match ends behind the pieces and matches up to it."""
    told = f"{no} AS no, {sql(kind)} AS kind, {base!r}e0 AS base"
    if kind == "email":
        bare = lambda x: f"length(replace({x}, chr(57344), ''))"
        lists = ", ".join(f"regexp_extract_all(q, {sql(_ADDRESS)}, {g}) AS g{g}" for g in (0, 1, 2))
        size, own = f"{bare('x')} + {bare('w')}", f"greatest({bare('a')}, {bare('b')})"
        rows = f"SELECT k, string_split_regex(q, {sql(_ADDRESS)}) AS pc, {lists} FROM d"
        each = "unnest(pc[:len(g0)]) AS x, unnest(g0) AS w, coalesce(unnest(g1), '') AS a, coalesce(unnest(g2), '') AS b"
    else:
        said = sql("(?i)" + pattern.replace(r"\s", P.SPACE))
        rows = f"SELECT k, string_split_regex(p, {said}) AS pc, regexp_extract_all(p, {said}) AS g0 FROM d"
        each, size, own = "unnest(pc[:len(g0)]) AS x, unnest(g0) AS w", "length(x) + length(w)", "length(w)"
    each = f"SELECT k, unnest(range(len(g0))) AS i, {each} FROM ({rows}) WHERE len(g0) > 0"
    ends = f"SELECT k, i, {own} AS n, sum({size}) OVER (PARTITION BY k ORDER BY i) AS e FROM ({each})"
    return f"SELECT k, {told}, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({ends}) WHERE n > 0"


def found_sql(rows: str) -> str:
    """CTEs that end in `kept` (k, no, kind, s, e, text, sure): the matches in rows (k, t), overlaps resolved.

    Matches that reach each other form islands, in which each is met with the one kept last.
    """
    names = _either(P.COMMON_NAMES)
    digits = "len(list_distinct(regexp_extract_all(text, '[0-9]')))"
    rules = (
        (f"kind = 'email' AND regexp_matches(text, {sql(_either(P.PLACEHOLDER_DOMAINS).replace('.', '[.]'))})", 0.1),
        (f"kind = 'email' AND regexp_matches(text, {sql(_either(P.PLACEHOLDER_WORDS))})", 0.1),
        (f"kind = 'phone' AND text IN ({', '.join(map(sql, P.FAKE_PHONES))})", 0.1),
        (f"kind = 'phone' AND {digits} <= 2", 0.3),
        (f"kind = 'person_name' AND regexp_matches(text, {sql(f'^(?:{names}) (?:{names})$')})", 1.5),
        (f"kind = 'person_name' AND NOT regexp_matches(text, {sql(f'^(?:{names}) (?:{names})$')})", 0.8),
        (f"kind = 'ip_address' AND ({' OR '.join(f'starts_with(text, {sql(x)})' for x in P.PRIVATE_NETS)})", 0.5),
        (f"regexp_matches(near, {sql(_either(P.HINTS_FOR))})", 1.2),
        (f"regexp_matches(near, {sql(_either(P.HINTS_AGAINST))})", 0.3),
    )
    sure = "base" + "".join(f" * CASE WHEN {test} THEN {factor!r}e0 ELSE 1e0 END" for test, factor in rules)
    return f"""
        d AS MATERIALIZED (SELECT k, t, regexp_replace(t, {sql(OTHER_WORD)}, '_', 'g') AS p,
            regexp_replace(replace(t, '_', '_' || chr(57344)), {sql(OTHER_WORD)}, '_', 'g') AS q FROM ({rows}) WHERE t IS NOT NULL),
        raw AS ({" UNION ALL ".join(_raw_sql(no, *x) for no, x in enumerate(P.PATTERNS))}),
        said AS (SELECT raw.*, substr(t, s + 1, e - s) AS text, substr(t, greatest(s - {P.AROUND}, 0) + 1, e + {P.AROUND} - greatest(s - {P.AROUND}, 0)) AS near
            FROM raw JOIN d ON raw.k = d.k),
        weighed AS (SELECT k, no, kind, s, e, text, least({sure}, 1e0) AS sure FROM said),
        reach AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS till
            FROM weighed WHERE sure > {P.LEAST!r}e0),
        isles AS (SELECT *, sum(CASE WHEN s < till THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e, no) AS isle FROM reach),
        n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, isle ORDER BY s, e, no) AS i FROM isles),
        f AS (
            SELECT k, isle, i, i AS last, e, sure, true AS apart FROM n WHERE i = 1
            UNION ALL
            SELECT n.k, n.isle, n.i, CASE WHEN f.e <= n.s OR n.sure > f.sure THEN n.i ELSE f.last END,
                CASE WHEN f.e <= n.s OR n.sure > f.sure THEN n.e ELSE f.e END, CASE WHEN f.e <= n.s OR n.sure > f.sure THEN n.sure ELSE f.sure END, f.e <= n.s
            FROM f JOIN n ON n.k = f.k AND n.isle = f.isle AND n.i = f.i + 1),
        stay AS (SELECT k, isle, last FROM (SELECT *, lead(apart) OVER (PARTITION BY k, isle ORDER BY i) AS next FROM f) WHERE coalesce(next, true)),
        kept AS MATERIALIZED (SELECT n.k, n.no, n.kind, n.s, n.e, n.text, n.sure FROM n JOIN stay ON n.k = stay.k AND n.isle = stay.isle AND n.i = stay.last)"""


def _tail_sql(x: str) -> str:
    return f"left({x}, 1) || repeat('*', length({x}) - 1)"


_MASK_SQL = f"""CASE
    WHEN kind = 'email' THEN (CASE WHEN length(u) > 1 THEN {_tail_sql('u')} ELSE '*' END) || '@' || {_tail_sql("h[:instr(h, '.') - 1]")} || h[instr(h, '.'):]
    WHEN kind = 'phone' AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= 4 THEN array_to_string(list_transform(range(1, length(text) + 1), lambda i:
        CASE WHEN text[i] BETWEEN '0' AND '9' AND length(regexp_replace(text[i + 1:], '[^0-9]', '', 'g')) >= 4 THEN '*' ELSE text[i] END), '')
    WHEN kind = 'person_name' THEN array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) > 1 THEN {_tail_sql('w')} ELSE '*' END), ' ')
    WHEN length(text) <= 2 THEN repeat('*', length(text)) ELSE left(text, 1) || repeat('*', length(text) - 2) || right(text, 1) END"""
_PUT_SQL = {
    "mask": "masked", "hash": "'[' || upper(kind) || '_' || left(sha256(text), 8) || ']'", "remove": "''",
    "placeholder": "CASE kind " + " ".join(f"WHEN {sql(k)} THEN {sql(v)}" for k, v in P.PLACEHOLDERS.items()) + " END",
}
MASKED_SQL = f"masked AS (SELECT *, {_MASK_SQL} AS masked FROM (SELECT *, string_split(text, '@')[1] AS u, string_split(text, '@')[-1] AS h FROM kept))"


def clean_sql(strategies=("placeholder",), least: float = 0.5) -> str:
    """CTEs behind found_sql that end in `clean` (k, t, and the text by each strategy)."""
    joined = [f"string_agg(substr(t, pe + 1, s - pe) || {_PUT_SQL[x]}, '' ORDER BY s) || substr(any_value(t), max(e) + 1) AS \"{x}\"" for x in strategies]
    return f"""{MASKED_SQL},
        cut AS (SELECT m.*, t, coalesce(lag(e) OVER (PARTITION BY m.k ORDER BY s), 0) AS pe FROM masked m JOIN d ON m.k = d.k WHERE sure >= {least!r}e0),
        built AS (SELECT k, {", ".join(joined)} FROM cut GROUP BY k),
        clean AS (SELECT d.k, d.t, {", ".join(f'coalesce("{x}", t) AS "{x}"' for x in strategies)} FROM d LEFT JOIN built ON d.k = built.k)"""


FOUND_SQL = f"WITH RECURSIVE {found_sql('SELECT doc_id AS k, text AS t FROM documents')}"
_HIGH = "kind IN ('ssn', 'credit_card') AND sure >= {}"
#: What is known of each text with matches.
SUMS_SQL = f"""
    sums AS (SELECT k, count(*) AS n, bool_or({_HIGH.format(0.7)}) AS high_7, bool_or({_HIGH.format(0.5)}) AS high_5, bool_or(sure >= 0.6) AS sure_6,
        CASE WHEN bool_or(sure >= 0.8) THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS risk FROM kept GROUP BY k),
    texts AS (SELECT doc_id, coalesce(risk, 'low') AS risk, coalesce(n, 0) AS n, coalesce(high_7, false) AS must_not_store,
        coalesce(high_5 OR risk = 'high' OR sure_6, false) AS needed FROM documents LEFT JOIN sums ON k = doc_id)"""


def found(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("found", P.matches(F.col("text")))


@query(f"{FOUND_SQL}, {SUMS_SQL} SELECT doc_id, risk, n = 0 AS is_safe, must_not_store, needed AS should_sanitize FROM texts")
def pii_text_safety(spark, sf_dir):
    """PII9, PII10, PII11: of each text its risk, whether it is safe, may be stored, and has to be sanitized."""
    f = F.col("found")
    return found(spark, sf_dir).select(
        "doc_id", P.risk(f).alias("risk"), P.is_safe(f).alias("is_safe"), P.has_high_risk(f).alias("must_not_store"),
        P.should_sanitize(f).alias("should_sanitize"),
    )


@query(f"""{FOUND_SQL}
    SELECT k AS doc_id, kind, count(*) AS n, count(*) FILTER (sure >= 0.8) AS high, count(*) FILTER (sure >= 0.5 AND sure < 0.8) AS medium,
        count(*) FILTER (sure < 0.5) AS low FROM kept GROUP BY k, kind
""")
def pii_analysis(spark, sf_dir):
    """AGG20: matches of each text by kind, and by confidence."""
    m = found(spark, sf_dir).select("doc_id", F.explode_outer("found").alias("m")).where("m IS NOT NULL").select("doc_id", "m.kind", "m.confidence")
    sure = F.col("confidence")
    return m.groupBy("doc_id", "kind").agg(
        F.count("*").alias("n"), F.count_if(sure >= 0.8).alias("high"), F.count_if((sure >= 0.5) & (sure < 0.8)).alias("medium"),
        F.count_if(sure < 0.5).alias("low"),
    )


#: What to do about rates of texts: above how many percent, and the advice.
ADVICE = (("detection_rate", 50, "Check the sources"), ("sanitization_rate", 30, "Sanitize before storage"), ("high_risk_rate", 5, "Filter more"))


@query(f"""{FOUND_SQL}, {SUMS_SQL},
    c AS (SELECT count(*) AS processed, count(*) FILTER (n > 0) AS detected, count(*) FILTER (needed) AS cleaned, count(*) FILTER (risk = 'high') AS high,
        CAST(sum(n) AS BIGINT) AS matches FROM texts),
    r AS (SELECT processed, matches, 100.0 * detected / greatest(processed, 1) AS detection_rate, 100.0 * cleaned / greatest(processed, 1) AS sanitization_rate,
        100.0 * high / greatest(processed, 1) AS high_risk_rate FROM c)
    SELECT processed, matches, {", ".join(f"round({c}, 6) AS {c}" for c, _, _ in ADVICE)},
        array_to_string(list_filter([{", ".join(f"CASE WHEN {c} > {n} THEN {sql(t)} END" for c, n, t in ADVICE)}], lambda x: x IS NOT NULL), '; ') AS advice FROM r
""")
def pii_rates(spark, sf_dir):
    """AGG21: rates of texts with matches, sanitized texts and texts of high risk, and what to do about them."""
    f = F.col("found")
    c = found(spark, sf_dir).agg(
        F.count("*").alias("processed"), F.count_if(F.size(f) > 0).alias("detected"), F.count_if(P.should_sanitize(f)).alias("cleaned"),
        F.count_if(P.risk(f) == "high").alias("high"), F.sum(F.size(f).cast("long")).alias("matches"),
    )
    rate = lambda x: 100.0 * F.col(x) / F.greatest("processed", F.lit(1))
    rates = {"detection_rate": rate("detected"), "sanitization_rate": rate("cleaned"), "high_risk_rate": rate("high")}
    advice = F.array_compact(F.array(*[F.when(rates[c] > n, t) for c, n, t in ADVICE]))
    return c.select("processed", "matches", *[F.round(x, 6).alias(n) for n, x in rates.items()], F.array_join(advice, "; ").alias("advice"))


@query(f'{FOUND_SQL} SELECT k AS doc_id, kind, text, s AS start, e AS "end", round(sure, 6) AS confidence FROM kept')
def pii_detect(spark, sf_dir):
    """PII1, PII2, PII3, WIN7: all matches with span and confidence, overlaps resolved."""
    # explode would have the matches worked out twice, once to leave out texts without any
    d = found(spark, sf_dir).select("doc_id", F.explode_outer("found").alias("m")).where("m IS NOT NULL")
    return d.select("doc_id", "m.kind", "m.text", "m.start", "m.end", F.round("m.confidence", 6).alias("confidence"))


STRATEGIES = ("mask", "hash", "placeholder", "remove")
_SAID = ("email", "Mask or remove e-mail addresses"), ("phone", "Sanitize phone numbers before storage"), ("ssn", "Sanitize social security numbers at once"), ("credit_card", "Remove credit card numbers at once")


@query(f"""{FOUND_SQL}, {clean_sql(STRATEGIES)}, {SUMS_SQL},
    first AS (SELECT * FROM masked WHERE sure >= 0.5 QUALIFY row_number() OVER (PARTITION BY k, text ORDER BY s) = 1),
    map AS (SELECT k, string_agg(text || ' => ' || masked || ' (' || kind || ')', '; ' ORDER BY text) AS replaced FROM first GROUP BY k),
    kinds AS (SELECT k, list(DISTINCT kind) AS kinds FROM kept GROUP BY k)
    SELECT doc_id, n AS matches, risk, needed AS sanitized, CASE WHEN needed THEN coalesce(replaced, '') ELSE '' END AS replaced,
        array_to_string(list_filter([{", ".join(f"CASE WHEN list_contains(kinds, {sql(k)}) THEN {sql(t)} END" for k, t in _SAID)}], lambda x: x IS NOT NULL), '; ') AS advice,
        CASE WHEN needed THEN mask ELSE t END AS kept, {", ".join(STRATEGIES)}
    FROM texts LEFT JOIN clean ON clean.k = doc_id LEFT JOIN map ON map.k = doc_id LEFT JOIN kinds ON kinds.k = doc_id
""")
def pii_sanitize(spark, sf_dir):
    """PII4, PII5, PII7, PIP4, MAP1: the record of a sanitized text with what was replaced by what, and its text by four strategies."""
    out = [P.sanitize(F.col("text"), F.col("found"), s).alias(s) for s in STRATEGIES]
    d = found(spark, sf_dir).select("doc_id", P.sanitized(F.col("text"), F.col("found")).alias("record"), *out)
    entry = lambda e: F.concat(e["key"], F.lit(" => "), e["value"]["replacement"], F.lit(" ("), e["value"]["kind"], F.lit(")"))
    said = F.array_join(F.transform(F.sort_array(F.map_entries("record.replacements")), entry), "; ").alias("replaced")
    return d.select(
        "doc_id", F.col("record.matches").cast("long").alias("matches"), "record.risk", "record.sanitized", said, F.array_join("record.advice", "; ").alias("advice"),
        F.col("record.text").alias("kept"), *STRATEGIES,
    )


_ITEMS_SQL = """
    SELECT doc_id || ':title:0' AS k, split_part(text, '.', 1) AS t FROM documents UNION ALL SELECT doc_id || ':topic:0', source FROM documents
    UNION ALL SELECT doc_id || ':content:0', text FROM documents
    UNION ALL SELECT doc_id || ':courses:' || i, c[i] FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[,;]') AS c FROM documents))
"""


@query(f"""WITH RECURSIVE {found_sql(_ITEMS_SQL)}, {clean_sql()},
    p AS (SELECT string_split(k, ':') AS k, placeholder AS t FROM clean),
    f AS (SELECT CAST(k[1] AS BIGINT) AS doc_id, k[2] AS field, string_agg(t, ' | ' ORDER BY CAST(k[3] AS INTEGER)) AS t FROM p GROUP BY ALL),
    one AS (SELECT doc_id, {", ".join(f"max(t) FILTER (field = '{c}') AS {c}" for c in ("title", "topic", "content", "courses"))} FROM f GROUP BY doc_id)
    SELECT d.doc_id, title, topic, content, courses FROM documents d LEFT JOIN one ON d.doc_id = one.doc_id
""".replace("f AS (SELECT CAST", "fields AS (SELECT CAST").replace("FROM f GROUP BY doc_id", "FROM fields GROUP BY doc_id"))
def pii_sanitize_items(spark, sf_dir):
    """PII13: items sanitized field by field: title, topic, content and each course of a list."""
    d = docs(spark, sf_dir).select(
        "doc_id", F.substring_index("text", ".", 1).alias("title"), F.col("source").alias("topic"), F.col("text").alias("content"),
        F.split("text", r"[,;]").alias("courses"),
    )
    clean = lambda c: P.sanitize(c, P.matches(c), "placeholder")
    courses = F.array_join(F.transform("courses", clean), " | ").alias("courses")
    return d.select("doc_id", *[clean(F.col(c)).alias(c) for c in ("title", "topic", "content")], courses)


@query(f"""WITH RECURSIVE {found_sql("SELECT page_id || ':url' AS k, url AS t FROM pages UNION ALL SELECT page_id || ':html', html FROM pages")}, {clean_sql(least=0.6)}
    SELECT page_id, u.placeholder AS url, h.placeholder AS html FROM pages LEFT JOIN clean u ON u.k = page_id || ':url' LEFT JOIN clean h ON h.k = page_id || ':html'
""")
def pii_sanitize_records(spark, sf_dir):
    """PII14: every string field of a record, matches from 0.6 up."""
    pages = table(spark, sf_dir, "pages")
    out = [P.sanitize(F.col(c), P.matches(F.col(c)), "placeholder", 0.6).alias(c) if k == "string" else F.col(c) for c, k in pages.dtypes]
    return pages.select(*out)
