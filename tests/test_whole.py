"""Queries over whole texts and all rows, against Python on a small table."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from tarnquery.functions import pii as P
from tarnquery.plans import registry

TEXTS = ["plain", "a/b \\ \"c\"", "two\nlines\r\n\ttab", "é ß 漢字 😀", "\x00\x01\x0b\x1f\x7f\b\f", "[x]", "", None]


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    def run(name, texts, key, value):
        folder = tmp_path_factory.mktemp("whole")
        rows = [(k, t, "en", "web") for k, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{folder}/documents.parquet")
        return {r[key]: r[value] for r in registry.queries()[name](spark, f"file://{folder}").collect()}

    return run


def test_content_hash_of_every_document(ask):
    dump = lambda t: json.dumps({"content": t, "topic": "en", "source": "web"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    want = {k: hashlib.sha256(dump(t).encode()).hexdigest()[:16] for k, t in enumerate(TEXTS)}
    assert ask("content_hash_all", TEXTS, "doc_id", "content_hash") == want
    assert ask("content_hash", TEXTS, "doc_id", "content_hash") == want


def slowly(text):
    """The matches of a text, by plain loops over a list of all that was kept."""
    found = []
    for kind, pattern, sure in P.PATTERNS:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            said, low = m[0], m[0].lower()
            checks = [
                (kind == "email" and any(d in low for d in P.PLACEHOLDER_DOMAINS), 0.1),
                (kind == "email" and any(w in low for w in P.PLACEHOLDER_WORDS), 0.1),
                (kind == "phone" and said in P.FAKE_PHONES, 0.1),
                (kind == "phone" and len({c for c in said if c.isdigit()}) <= 2, 0.3),
                (kind == "person_name", 1.5 if set(low.split()) <= set(P.COMMON_NAMES) else 0.8),
                (kind == "ip_address" and said.startswith(P.PRIVATE_NETS), 0.5),
                (any(w in text[max(0, m.start() - 50) : m.end() + 50].lower() for w in P.HINTS_FOR), 1.2),
                (any(w in text[max(0, m.start() - 50) : m.end() + 50].lower() for w in P.HINTS_AGAINST), 0.3),
            ]
            factor = sure
            for fits, by in checks:
                factor *= by if fits else 1
            if min(factor, 1) > 0.1:
                found.append((m.start(), m.end(), kind, said, round(min(factor, 1), 6)))
    kept = []
    for m in sorted(found, key=lambda m: m[:2]):
        over = [k for k in kept if m[0] < k[1] and m[1] > k[0]]
        if not over:
            kept.append(m)
        elif m[4] > over[0][4]:
            kept.remove(over[0])
            kept.append(m)
    return sorted(kept)


def masked(kind, text):
    tail = lambda w: w[:1] + "*" * (len(w) - 1)
    if kind == "email":
        user, host = text.split("@")
        name, dot, rest = host.partition(".")
        return f"{tail(user) if len(user) > 1 else '*'}@{tail(name)}{dot}{rest}"
    if kind == "phone" and sum(c.isdigit() for c in text) >= 4:
        return "".join("*" if c.isdigit() and sum(x.isdigit() for x in text[i + 1 :]) >= 4 else c for i, c in enumerate(text))
    if kind == "person_name":
        return " ".join(tail(w) for w in text.split())
    return "*" * len(text) if len(text) <= 2 else text[0] + "*" * (len(text) - 2) + text[-1]


def test_names_and_international_phones_found(ask):
    text = "We met Mary Smith at noon; +442071234567 is it. 123-45-6789 12/31/1999 4111111111111111 10.0.0.1 a.b@c.de"
    found = ask("pii_detect", [text, "", None], "text", "kind")
    assert found["442071234567"] == "phone" and "person_name" in found.values()
    safe = ask("pii_sanitize", ["john smith, 442071234567"], "doc_id", "placeholder")[0]
    assert safe == "[PERSON_NAME], [PHONE_NUMBER]"


def test_matches_against_plain_loops(spark, tmp_path):
    text = "We met Mary Smith at noon; +442071234567 is it. 123-45-6789 12/31/1999 4111111111111111 10.0.0.1 a.b@c.de"
    texts = [text, text * 5, "1999-12-31-1234 " * 9, "Ab Cd 123456789 " * 9, "call 555-555-5555 or 111-111-1111", "test@example.com", "", None]
    texts += ["éabc@d.com é.abc@d.com _a.b_c@d.comé a@b.co.frém x@y.com.z@w.org a|b@c.de|x b@c.de_", "Zoë Ab Cd éAb Cd Ab Cdé 5551234567é é5551234567", "phonemail a@b.cd" + " " * 46 + "testest"]
    texts += ["a@b.cd" + "x" * n + "emailé phone" + "y" * n + " 10.1.2.3" for n in (38, 39, 40, 41, 44, 45, 46)] + ["😀 a@b.cd 😀" * 3, "Mary Smith " * 5000 + "é"]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {k: [] for k in range(len(texts))}
    for r in registry.queries()["pii_detect"](spark, f"file://{tmp_path}").collect():
        got[r.doc_id].append((r.start, r.end, r.kind, r.text, r.confidence))
    for k, t in enumerate(texts):
        assert sorted(got[k]) == slowly(t or "")
    records = {r.doc_id: r for r in registry.queries()["pii_sanitize"](spark, f"file://{tmp_path}").collect()}
    for k, t in enumerate(texts):
        clean, sure = t or "", [m for m in slowly(t or "") if m[4] >= 0.5]
        for start, end, kind, *_ in reversed(sure):
            clean = clean[:start] + P.PLACEHOLDERS[kind] + clean[end:]
        assert (records[k].placeholder or "") == clean
        assert records[k].matches == len(slowly(t or ""))
        said = {m[3]: f"{m[3]} => {masked(m[2], m[3])} ({m[2]})" for m in reversed(sure)}
        assert records[k].replaced == ("; ".join(v for _, v in sorted(said.items())) if records[k].sanitized else "")


def test_matches_of_a_text_cost_in_proportion(spark, tmp_path):
    text = "Ab Cd 123456789 x@y.org; " * 20_000
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    one = registry.queries()["pii_sanitize"](spark, f"file://{tmp_path}").first()
    assert one.matches >= 60_000 and one.placeholder == text.replace("123456789", "[PHONE_NUMBER]").replace("x@y.org", "[EMAIL_ADDRESS]")


def test_no_python_in_plans(spark):
    for name in ("pii_detect", "pii_sanitize", "pii_sanitize_items", "pii_sanitize_records", "pii_text_safety", "pii_analysis", "pii_rates"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_profiles_and_any_host(spark):
    df = spark.createDataFrame([("see network.org/in/jane-roe now",)], "t string")
    found = df.select(P.matches(F.col("t"), [*P.PATTERNS, P.profile_pattern("network.org")]).alias("m")).first().m
    assert [(m.kind, m.text) for m in found] == [("profile", "network.org/in/jane-roe")]


def test_page_bodies_are_sanitized(spark, tmp_path):
    rows = [(1, "http://x.org/", "<p>write to jo.doe@mail.org</p>"), (2, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = registry.queries()["pii_sanitize_records"](spark, f"file://{tmp_path}").collect()
    assert sorted(tuple(r) for r in got) == [(1, "http://x.org/", "<p>write to [EMAIL_ADDRESS]</p>"), (2, None, None)]


LONG = ["unused", "x" * 50 + " nothing here, " * 30 + "a course on late things, more; straße maß ßa. Udemy deep diving! it's é1a"]


@pytest.mark.parametrize("suffix", ["", "_all"])
def test_texts_are_read_to_their_end(ask, suffix):
    assert ask(f"title_case{suffix}", LONG, "doc_id", "titled") == {k: t.title() for k, t in enumerate(LONG)}
    want = [c.strip() for c in re.split("[,;]", LONG[1]) if 3 < len(c.strip()) < 100]
    assert ask(f"course_list{suffix}", LONG, "doc_id", "courses")[1] == " | ".join(want) and "straße" in want[-1]
    assert "late things, more; straße maß ßa" in ask(f"course_refs{suffix}", LONG, "doc_id", "courses")[1].lower()
    assert "deep diving" in ask(f"course_refs_wide{suffix}", LONG, "doc_id", "courses")[1].lower()
