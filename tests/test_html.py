"""Fields of odd HTML against a parser with a stack, and the containment join against all pairs."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tarnquery.functions import html as H
from tarnquery.operators.containment import contained

WANTED = {"title": ("h1", ".title", "title"), "author": (".author", "a[rel=author]"), "content": ("article", "[role=main]"), "body": ("body",)}
PAGES = [
    "<html><title>T &amp;amp; u</title><body><h1 class='x'>A <b>bold</b>one</h1><article><p>one<p>two<br>three</article>tail</body>",
    "<body><div class=\"a author b\"><a href=x>Jo</a> Roe</div><div role=main>in <span>side</span></div>",
    "<body><DIV CLASS = author>up</DIV><h1></h1><p class=title>fallback</p><a title='x > y' rel='author'>z</a>",
    "<body>a<!-- <article>no</article> --><script>var x = '<article>no</article>';</script><article data-x='class=author'>yes</b></i></article></body>",
    "<article><article>inner</article>outer</article><article>second</article>",
    "1 < 2 and <b>3</b> > 2", "<article", "", "no tags", None, "<p>unclosed <article>never ends", "<img src=a.png alt='q'><IMG alt=\"b\" src = \"c d.jpg\"><!-- <img src=no.png> -->",
    "<body class=content>" + "<p class=\"title\">word</p>" * 3000 + "<article>" + "x " * 20000 + "</article></body>", "<div></div></div></div><h1>after</h1>", "a&nbsp;&lt;b&gt;",
]


class Stack(HTMLParser):
    """The same rules, a character after the other by the standard library's tokenizer."""

    def __init__(self, selectors):
        super().__init__(convert_charrefs=False)
        self.open, self.at, self.said, self.dark = [], {s: 0 for s in selectors}, {s: [] for s in selectors}, None

    def put(self, text):
        for s, d in self.at.items():
            if d > 0:
                self.said[s].append(text)

    def handle_starttag(self, tag, attrs):
        if tag in H.BREAKS:
            self.put(" ")
        if tag in ("script", "style"):
            return
        if tag in H.VOID:
            return
        a = {k: v or "" for k, v in attrs}
        for s in self.at:
            fits = {"h1": tag == "h1", "title": tag == "title", "article": tag == "article", "body": tag == "body"}.get(s)
            if s.startswith("."):
                fits = s[1:] in a.get("class", "").split()
            elif "[" in s:
                key, value = s[s.index("[") + 1 : -1].split("=")
                fits = (not s.split("[")[0] or s.split("[")[0] == tag) and a.get(key) == value
            if fits and self.at[s] == 0:
                self.at[s] = len(self.open) + 1
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in H.BREAKS:
            self.put(" ")
        if tag in self.open:
            left = len(self.open) - 1 - self.open[::-1].index(tag)
            self.open = self.open[:left]
            self.at = {s: -1 if d > left else d for s, d in self.at.items()}

    def handle_data(self, data):
        if self.cdata_elem is None:
            self.put(data)

    def handle_entityref(self, name):
        self.put({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "apos": "'"}.get(name, f"&{name};"))


def slowly(page):
    p = Stack(list(dict.fromkeys(s for some in WANTED.values() for s in some)))
    p.feed(page)
    p.close()
    text = {s: " ".join("".join(x).split()) for s, x in p.said.items()}
    return tuple(next((text[s] for s in some if text[s]), None) for some in WANTED.values())


def test_fields_against_a_parser(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(PAGES)], "k int, t string")
    got = {r.k: r.f for r in df.select("k", H.fields(F.col("t"), WANTED).alias("f")).collect()}
    skipped = {"<article"}  # a tag that never ends is text here, and nothing to the parser
    for k, t in enumerate(PAGES):
        if t is None:
            assert got[k] is None
        elif t not in skipped:
            assert tuple(got[k]) == slowly(t), t[:80]


def test_elements_and_attributes(spark):
    df = spark.createDataFrame([(t,) for t in PAGES if t and "<img" in t], "t string")
    got = df.select(H.elements(F.col("t"), "img", "src", "alt").alias("e")).first().e
    assert [tuple(x) for x in got] == [("a.png", "q"), ("c d.jpg", "b")]
    tags = ["<a data-href='no' href=\"x'y\">", "<a title='href=\"no\"' href='yes'>", "<a>", "<A HREF=plain>", "<a href = 'a&amp;b' href='c'>"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(tags)], "k int, t string")
    assert [r.h for r in df.orderBy("k").select(H.attribute(F.col("t"), "href").alias("h")).collect()] == ["x'y", "yes", "", "plain", "a&b"]


def test_one_page_costs_in_proportion(spark):
    page = "<body><article>" + "<p class='x'>some <b>text</b> here</p>\n" * 20_000 + "</article></body>"
    got = spark.createDataFrame([(page,)], "t string").select(H.fields(F.col("t"), WANTED).alias("f")).first().f
    assert got.content == " ".join(["some text here"] * 20_000)


@pytest.mark.parametrize("letters,most", [("ab", 6), ("abcdé", 9)])
def test_containment_against_all_pairs(spark, letters, most):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    parts = [(rng.choice([1, 2, None]), word(5)) for _ in range(150)] + [(1, None), (1, "")]
    wholes = [(rng.choice([1, 2, None]), word(most)) for _ in range(150)] + [(1, None), (2, "")]
    got = contained(spark.createDataFrame(parts, "c int, part string"), spark.createDataFrame(wholes, "c int, whole string"), "c").collect()
    want = {(c, p, w) for c, p in parts for d, w in wholes if c is not None and c == d and p is not None and w is not None and p in w}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
