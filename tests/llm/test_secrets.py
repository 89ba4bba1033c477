"""Secret scans against plain loops over Python's own expressions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnquery.llm import queries, secrets

PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)
RANDOM = "q8Zt3vW1xR6mK0pB9nL4yH7d"


def bits(window):
    n = len(window)
    return -sum(c / n * math.log2(c / n) for c in Counter(window).values())


def slowly(text):
    text = text or ""
    base = [(m.start(), no, m.end(), kind) for no, (kind, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= least]
    added = []
    for no, c in enumerate(secrets.CLASSES, len(PATTERNS)):
        for m in re.finditer(f"[{c.chars}]{{20,}}", text):
            if any(re.search(p, m[0]) for p in secrets.ALLOWED) or (c.but and re.fullmatch(f"[{c.but}]*", m[0])):
                continue
            hot = [k for k in range(len(m[0]) - 19) if bits(m[0][k : k + 20]) >= c.bits - 1e-6]
            if hot:
                added.append((m.start() + hot[0], no, m.start() + hot[-1] + 20, c.kind))
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return base, said(base), said(base + added)


def texts():
    rng = random.Random(4)
    parts = [
        "token = abc123", 'PassWord":"hunter22"', "secret:token:abcdef", "secret == x", "api_key='a.b-c/d'", "apikey = short", "paſſword = abcdefgh",
        "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "AKIAKIA" + "Z9" * 8, "0123456789abcdef01234567", "9" * 30, "deadbeef" * 3, RANDOM, RANDOM.lower(), "é" + RANDOM + "ß",
        "a" * 40, "some/long/path-name/without/any-number", "123e4567-e89b-12d3-a456-426614174000", "EXAMPLE" + RANDOM, "2024-01-01/2025-02-02", "x1" * 15,
        RANDOM + "a" * 50 + RANDOM[::-1], "😀", "\n", " ", "ABCDEF0123", "k" * 19, RANDOM[:20], RANDOM[:19],
    ]
    made = ["".join(rng.choice(parts) + rng.choice([" ", "", ";", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    letters = "abcdefABCDEF0123456789+/_=-xyzXYZ"
    made += ["".join(rng.choice(letters) for _ in range(rng.randint(15, 60))) for _ in range(60)]
    return [*parts, *made, "", None, "", "token = abcdefgh " * 3000, RANDOM * 500]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = f"file://{tmp_path_factory.mktemp('secrets')}"
    rows = [(k, t, "x", 1) for k, t in enumerate(texts())] + [(None, "token = abcdef", "x", 1), (3, "twice", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, base string, kind_no int").write.parquet(f"{top}/documents.parquet")
    return top


def test_against_plain_loops(spark, folder):
    got = [r for r in queries.op13_secret_scan(spark, folder).collect()]
    assert len(got) == len(texts()) + 2
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    for k, t in enumerate(texts()):
        if k == 3:
            continue
        base, digest, spans = slowly(t)
        counts = Counter(s[3] for s in base)
        assert (by[k].n_assign, by[k].n_access, by[k].n_hex) == (counts["assign"], counts["access"], counts["hex"]), t
        assert by[k].base_sha256 == hashlib.sha256(digest.encode()).hexdigest() and by[k].spans == spans, t
    assert by[None].spans == "assign:0:14"
    assert sorted(r.spans for r in got if r.doc_id == 3) == ["", slowly(texts()[3])[2]]


def test_plain_plan_and_no_rows(spark, folder):
    plan = queries.op13_secret_scan(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    none = spark.createDataFrame([], "doc_id long, text string, added string")
    assert secrets.scan_secrets(none).count() == 0


@pytest.mark.parametrize("said", [RANDOM, "ab" * 15, "a" * 30, "0123456789abcdefghij" * 2])
def test_counts_of_a_window_move_with_it(spark, said):
    for most in (0, 20_000_000, 40_000_000, 90_000_000):
        sums = [sum(secrets.weight(n) for n in Counter(said[k : k + 20]).values()) for k in range(len(said) - 19)]
        hot = [k + 20 for k, s in enumerate(sums) if s <= most]
        got = spark.range(1).select(secrets.hot_windows(F.lit(said), most).alias("h")).first().h
        assert (got["first"], got["last"]) == ((hot[0], hot[-1]) if hot else (0, 0))
