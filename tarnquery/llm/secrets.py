"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy of candidate strings. Built-in functions only.

A candidate is a longest run of a character class. A window of WINDOW characters moves over it, one character in and
one out; the counts of the characters within are kept up, and with them the sum of n log2 n over the counts n, from
which the window's entropy is log2(WINDOW) - sum / WINDOW. The sum is kept in whole millionths, so it never drifts.
A candidate is found if a window reaches the entropy of its class and no rule of the allow-list fits it; its span runs
from the start of the first such window to the end of the last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnquery.functions.arrays import empty, let, places

#: Characters of a window.
WINDOW = 20
#: Units of a sum of n log2 n to one bit.
UNIT = 1_000_000

# What a secret looks like. A kind is followed by its pattern, the group that is measured, and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: How patterns of a single class are sought: the same runs, without those that are dropped as too short.
SOUGHT = {r"[0-9a-f]+": r"(?<![0-9a-f])[0-9a-f]{24,}+"}


@dataclass(frozen=True)
class CharClass:
    """Characters of a class, and the bits of entropy from which a window of them is a secret."""

    kind: str
    chars: str
    bits: float
    #: Candidates of these characters alone belong to another class.
    but: str = ""

    @property
    def most(self) -> int:
        """The largest sum of n log2 n of a window that has this entropy."""
        return math.floor(WINDOW * (math.log2(WINDOW) - self.bits) * UNIT)


#: Random windows have about 3.4 bits in hexadecimal digits and 4.0 in letters and digits; words have about 3.2.
CLASSES = (CharClass("entropy_hex", "0-9A-Fa-f", 3.0), CharClass("entropy_base64", "A-Za-z0-9+/_=-", 3.8, "0-9A-Fa-f"))
#: Candidates that are none: without a digit (words, paths), without a letter (numbers, dates), the alphabet in order,
#: universally unique ids, and what examples write.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)0123456789|abcdefghij",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|sample|changeme|xxxxxx",
)
SPAN = "struct<start:int,kind_no:int,end:int,kind:string>"


def weight(n: int) -> int:
    """n log2 n in units."""
    return round(n * math.log2(n) * UNIT) if n > 1 else 0


def hot_windows(said: Column, most: int) -> Column:
    """The ends (first, last) of the windows of an ASCII string whose sum of n log2 n is at most `most`; 0, 0 without.

    Counts stand in a string, by character code, as a character each; a step replaces the two that change.
    """
    raw, steps = said.cast("binary"), F.array(*[F.lit(weight(n + 1) - weight(n)) for n in range(WINDOW + 1)])
    code = lambda i: F.ascii(F.substring(raw, i, F.lit(1)).cast("string"))
    count = lambda counts, c: F.ascii(F.substring(counts, c + 1, F.lit(1))) - 1
    put = lambda counts, c, n: F.overlay(counts, F.char(n + 1), c + 1, F.lit(1))

    def without(s: Column, i: Column) -> Column:
        """The state after the character that leaves before i comes."""

        def drop(c: Column) -> Column:
            return let(count(s["counts"], c) - 1, lambda n: F.struct(put(s["counts"], c, n).alias("counts"), (s["sum"] - steps[n]).alias("sum")))

        return F.when(i > WINDOW, let(code(i - WINDOW), drop)).otherwise(F.struct(s["counts"], s["sum"]))

    def step(s: Column, i: Column) -> Column:
        def add(x: Column) -> Column:
            t, c = x["t"], x["c"]
            return let(count(t["counts"], c), lambda n: F.struct(put(t["counts"], c, n + 1).alias("counts"), (t["sum"] + steps[n]).alias("sum")))

        def judge(t: Column) -> Column:
            hot = (i >= WINDOW) & (t["sum"] <= most)
            first = F.when(hot & (s["first"] == 0), i).otherwise(s["first"])
            return F.struct(t["counts"].alias("counts"), t["sum"].alias("sum"), first.alias("first"), F.when(hot, i).otherwise(s["last"]).alias("last"))

        return let(let(F.struct(without(s, i).alias("t"), code(i).alias("c")), add), judge)

    # a count of none is character 1: character 0 would end some strings
    start = F.struct(F.lit("\x01" * 128).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(said)), start, step, lambda s: F.struct(s["first"], s["last"]))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: of each kind the leftmost matches that don't overlap, without those that are too short."""

    def one(no: int, kind: str, pattern: str, group: int, least: int) -> Column:
        found = F.filter(places(text, SOUGHT.get(pattern, pattern), *([group] if group else [])), lambda m: F.length(m["g1" if group else "g0"]) >= least)
        row = lambda m: F.struct(m["start"], F.lit(no).alias("kind_no"), m["end"], F.lit(kind).alias("kind"))
        return F.transform(found, row).cast(f"array<{SPAN}>")

    return F.concat(*[one(no, *rule) for no, rule in enumerate(BASE)])


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy in the candidates of each class."""

    def one(no: int, chars: CharClass) -> Column:
        # the look behind keeps a run from being tried again from each of its characters
        runs = places(text, f"(?<![{chars.chars}])[{chars.chars}]{{{WINDOW},}}+")
        allowed = "|".join(f"(?:{p})" for p in (*ALLOWED, *([f"^[{chars.but}]*$"] if chars.but else [])))
        left = F.filter(runs, lambda m: ~m["g0"].rlike(allowed))
        row = lambda m, h: F.struct(
            (m["start"] + h["first"] - WINDOW).alias("start"), F.lit(no).alias("kind_no"), (m["start"] + h["last"]).alias("end"),
            F.lit(chars.kind).alias("kind"), h["last"].alias("last"),
        )
        judged = F.transform(left, lambda m: let(hot_windows(m["g0"], chars.most), lambda h: row(m, h)))
        bare = lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"])
        return F.transform(F.filter(judged, lambda s: s["last"] > 0), bare).cast(f"array<{SPAN}>")

    return F.concat(*[one(len(BASE) + no, c) for no, c in enumerate(CLASSES)])


def written_out(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `base` and a column `added`: arrays of spans (start, kind_no, end, kind) in code points.

    A row's result depends on its text alone, so nothing is shuffled, and repeated rows and ids of any type stay as they
    are. A null text counts as empty and has no spans; columns named base or added are replaced. Spans of different kinds
    may overlap, those of one kind don't. Time is in proportion to a text's length, but for a sort of its spans.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"base": F.coalesce(base_spans(said), empty(SPAN)), "added": F.coalesce(entropy_spans(said), empty(SPAN))})


def _kind_sql(no: int, kind: str, pattern: str, group: int, where: str) -> str:
    """Matches of a pattern in d (doc_id, t): a match starts after the pieces and the matches before it."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    before = "list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)"
    return f"""
        SELECT doc_id, {no} AS no, '{kind}' AS kind, CAST({before} AS BIGINT) AS a, m[i] AS said FROM (
            SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT doc_id, string_split_regex(t, {quoted}) AS p, regexp_extract_all(t, {quoted}) AS m, regexp_extract_all(t, {quoted}, {group}) AS g FROM d)
        ) WHERE {where}"""


def oracle_sql() -> str:
    """The same in SQL: each window's entropy is worked out anew from the distinct characters in it."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    base = [
        _kind_sql(no, kind, p.replace("(?i)(password|passwd|secret|token|api_?key)", either), g, f"length(g[i]) >= {least}")
        for no, (kind, p, g, least) in enumerate(BASE)
    ]
    added, windows = [], []
    for no, c in enumerate(CLASSES, len(BASE)):
        allowed = (*ALLOWED, *([f"^[{c.but}]*$"] if c.but else []))
        rules = " AND ".join(f"NOT regexp_matches(m[i], '{x}')" for x in allowed)
        added.append(_kind_sql(no, c.kind, f"[{c.chars}]{{{WINDOW},}}", 0, rules))
        windows.append(f"({no}, {c.most})")
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), base AS ({" UNION ALL ".join(base)}),
        cand AS ({" UNION ALL ".join(added)}), least(no, most) AS (VALUES {", ".join(windows)}),
        w AS (SELECT doc_id, no, kind, a, unnest(range(length(said) - {WINDOW - 1})) AS pos, said FROM cand),
        x AS (SELECT w.*, list_transform(range(1, {WINDOW + 1}), lambda k: substr(said, CAST(pos + k AS BIGINT), 1)) AS c FROM w),
        h AS (SELECT x.*, list_sum(list_transform(list_transform(list_distinct(c), lambda y: len(list_filter(c, lambda z: z = y))),
                                                     lambda n: CAST(round(n * log2(n) * {UNIT}) AS BIGINT))) AS s FROM x),
        added AS (SELECT doc_id, h.no, kind, a + min(pos) AS a, a + max(pos) + {WINDOW} AS b FROM h JOIN least ON h.no = least.no AND s <= most
                  GROUP BY doc_id, h.no, kind, a, said),
        spans AS (SELECT doc_id, no, kind, a, a + length(said) AS b FROM base UNION ALL SELECT * FROM added),
        s AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
                     string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, no) FILTER (no < {len(BASE)}) AS base,
                     string_agg(concat_ws(':', kind, a, b), ',' ORDER BY a, no) AS spans FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""
