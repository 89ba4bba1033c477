"""Fields out of HTML: a tokenizer, a stack of open tags and lists of selectors, as column expressions.

A selector is a tag, a class or an attribute's value: h1, .author, a[rel=author], [role=main]. A field's selectors are
tried in order; of each the first element counts, with all text in it, and the next one is tried if there is none.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnquery.functions.arrays import empty, let, scan

#: Comments, elements whose content isn't text, declarations, tags with quoted attributes, text, and a lone angle bracket.
TOKEN = r"""(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|</?[a-z](?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<"""
# Elements without content, and those that text is broken at.
VOID = "area base br col embed hr img input link meta source track wbr".split()
BREAKS = "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table td th title tr ul".split()
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in any quotes or none; an empty text without it."""
    found = rf"""(?is)^<[a-z0-9]+(?:\s+(?!{name}\b)[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*\s+{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return plain(F.concat(*[F.regexp_extract(tag, found, k) for k in (1, 2, 3)]))


def plain(text: Column) -> Column:
    """Text with entities resolved; what an ampersand stands for is resolved once."""
    for code, char in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _fits(tag: Column, name: Column, selector: str) -> Column:
    kind, cls, key, value = re.fullmatch(r"([a-z0-9]*)(?:\.([\w-]+))?(?:\[([\w-]+)=([^\]]+)\])?", selector).groups()
    tests = [name == kind] if kind else []
    if cls or key:  # most tags have no attributes: they needn't be searched
        tests.append(F.contains(tag, F.lit("=")))
    if cls:
        tests.append(F.array_contains(F.split(attribute(tag, "class"), r"\s+"), cls))
    if key:
        tests.append(attribute(tag, key) == value)
    fits = tests[0]
    for test in tests[1:]:
        fits = fits & test
    return fits


def tokens(html: Column, selectors: Sequence[str]) -> Column:
    """An array of (kind, name, fits, text): kind 0 is text, 1 opens, 2 closes, 3 does neither; the bits of fits tell the
    selectors of a tag; text is what a token adds to the text around it."""

    def one(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        kind = F.when((t == "<") | ~t.startswith("<"), 0).when(name == "", 3).when(t.startswith("</"), 2)
        kind = kind.when(name.isin(*VOID, "script", "style", "noscript", "template") | t.endswith("/>"), 3).otherwise(1)

        def put(x: Column) -> Column:
            bits = [F.when(_fits(t, x["name"], s), 1 << k).otherwise(0) for k, s in enumerate(selectors)]
            fits = bits[0]
            for b in bits[1:]:
                fits = fits.bitwiseOR(b)
            text = F.when(x["kind"] == 0, plain(t)).when(x["name"].isin(*BREAKS), " ").otherwise("")
            return F.struct(x["kind"].alias("kind"), x["name"].alias("name"), F.when(x["kind"] == 1, fits).otherwise(0).alias("fits"), text.alias("text"))

        return let(F.struct(kind.alias("kind"), name.alias("name")), put)

    return F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), one)


def inside(found: Column, n: int) -> Column:
    """Of each token the bits of the selectors whose first element it lies in.

    A closing tag closes the last open element of its name and all within; one without an open element is ignored.
    `at` holds the depth at which each selector's first element opened, 0 before, -1 behind it.
    """
    start = F.struct(empty("string").alias("open"), F.array(*[F.lit(0)] * n).alias("at"))

    def bits(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda d, k: F.when(d > 0, F.pow(F.lit(2), k).cast("int")).otherwise(0)), F.lit(0), lambda a, b: a + b)

    def advance(s: Column, t: Column) -> Column:
        depth = F.size(s["open"])
        opened = F.transform(s["at"], lambda d, k: F.when((d == 0) & (F.floor(t["fits"] / F.pow(F.lit(2), k)) % 2 == 1), depth + 1).otherwise(d))
        left = depth - F.array_position(F.reverse(s["open"]), t["name"]).cast("int")
        closed = F.transform(s["at"], lambda d: F.when(d > left, -1).otherwise(d))
        closes = (t["kind"] == 2) & F.array_contains(s["open"], t["name"])
        stack = F.when(t["kind"] == 1, F.concat(s["open"], F.array(t["name"]))).when(closes, F.slice(s["open"], F.lit(1), left)).otherwise(s["open"])
        at = F.when(t["kind"] == 1, opened).when(closes, closed).otherwise(s["at"])
        return F.struct(F.struct(stack.alias("open"), at.alias("at")).alias("at"), F.array(bits(s["at"])).alias("out"))

    # names and bits are all that the pass needs
    short = F.transform(found, lambda t: F.struct(t["kind"].alias("kind"), t["name"].alias("name"), t["fits"].alias("fits")))
    return scan(short, start, advance, "int")


def fields(html: Column, wanted: Mapping[str, Sequence[str]]) -> Column:
    """A struct of the wanted fields: the text of the first selector that has any, white space squeezed; null without.

    A null page has no fields. Up to 30 selectors in all. Time grows with a page's length and its tokens.
    """
    selectors = list(dict.fromkeys(s for some in wanted.values() for s in some))

    def read(found: Column) -> Column:
        def text(where: Column, k: int) -> Column:
            own = F.zip_with(found, where, lambda t, w: F.when(F.floor(w / (1 << k)) % 2 == 1, t["text"]).otherwise(""))
            said = F.trim(F.regexp_replace(F.array_join(own, ""), r"[\s ]+", " "))
            return F.when(said != "", said)

        return let(inside(found, len(selectors)), lambda w: F.struct(*[F.coalesce(*[text(w, selectors.index(s)) for s in some]).alias(c) for c, some in wanted.items()]))

    return F.when(html.isNotNull(), let(tokens(html, selectors), read))


def elements(html: Column, tag: str, *names: str) -> Column:
    """All elements of a tag as structs of these attributes, in order; not those in comments or scripts."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(rf"(?i)^<{tag}\b"))
    return F.transform(tags, lambda t: F.struct(*[attribute(t, n).alias(n) for n in names]))
