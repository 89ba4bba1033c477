"""Arrays inside a row: bindings, running state and places of matches, all as built-in expressions.

A fold that appends to its result copies it at every step, whatever it holds. Here items are folded in as many blocks as a
block has items: a step copies at most a block, and all that was given out is copied once a block only. What is given out
should be small, such as numbers that say which items are meant: n of them cost about n ** 1.5 copies of a few nanoseconds.
Deeper blocks would cost less, but Spark resolves expressions of limited depth only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least items of a block.
BLOCK = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def empty(kind: str) -> Column:
    """An empty array of items of this type."""
    return F.array().cast(f"array<{kind}>")


def blocks(items: Column) -> Column:
    """Items by the block; they are picked one by one, as a slice would go through the whole array each time."""

    def cut(b: Column) -> Column:
        pick = lambda k: F.transform(F.sequence(k * b["size"], F.least((k + 1) * b["size"], b["n"]) - 1), lambda i: F.get(items, i))
        return F.transform(F.sequence(F.lit(0), F.ceil(b["n"] / b["size"]).cast("int") - 1), pick)

    n = F.size(items)
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n)).cast("int"))
    whole = let(F.struct(n.alias("n"), size.alias("size")), cut)
    return F.when(n > 0, whole).when(n == 0, F.slice(F.array(items), 1, 0))


def scan(items: Column, zero: Column, advance: Callable[[Column, Column], Column], kind: str, end: Callable[[Column], Column] | None = None) -> Column:
    """What a pass from left to right gives out, as an array of items of type kind.

    advance(state, item) is a struct of the next state `at`, of zero's type, and an array `out`. end(state) is an array
    given out after the last item. Null items: null.
    """

    def step(state: Column, item: Column) -> Column:
        return let(advance(state["at"], item), lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], s["out"]).alias("out")))

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), empty(kind).alias("out")), step)
        return let(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(state["done"], F.array(s["out"])).alias("done")))

    def finish(state: Column) -> Column:
        done = F.flatten(state["done"])
        return F.concat(done, end(state["at"])) if end else done

    start = F.struct(zero.alias("at"), empty(f"array<{kind}>").alias("done"))
    return let(items, lambda x: F.aggregate(blocks(x), start, block, finish))


def totals_before(sizes: Column) -> Column:
    """Of each number the sum of those before it."""

    def step(state: Column, x: Column) -> Column:
        return F.struct((state["at"] + x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), empty("int").alias("out")), step)
        return let(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(state["done"], F.array(s["out"])).alias("done")))

    start = F.struct(F.lit(0).alias("at"), empty("array<int>").alias("done"))
    return let(sizes, lambda x: F.aggregate(blocks(x), start, block, lambda state: F.flatten(state["done"])))


def ends(text: Column, pattern: str, found: Column) -> Column:
    """Where the matches `found` of a pattern end, in code points: behind the pieces and matches up to each."""
    sizes = F.zip_with(F.split(text, pattern), found, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    return F.slice(totals_before(sizes), 2, F.size(found))


def places(text: Column, pattern: str, *groups: int) -> Column:
    """Leftmost matches that don't overlap, as an array of structs (start, end, g0, g1, ...): places in code points, end
    exclusive, g0 the match and g1, g2, ... the groups asked for.

    A match starts where the pieces before it and the matches before it end. The pattern never matches an empty text.
    Null text: null.
    """
    names = [f"g{k}" for k in range(len(groups) + 1)]
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def put(found: Column) -> Column:
        row = lambda x: F.struct((x["end"] - F.length(x["g0"])).alias("start"), x["end"].alias("end"), *[x[n].alias(n) for n in names])
        said = [found, *map(every, groups)]
        return F.transform(F.arrays_zip(ends(text, pattern, found).alias("end"), *[x.alias(n) for x, n in zip(said, names)]), row)

    kind = "struct<" + ",".join(["start:int", "end:int", *[f"{n}:string" for n in names]]) + ">"
    none = F.when(text.isNotNull(), empty(kind))
    return let(every(0), lambda f: F.when(F.size(f) > 0, put(f)).otherwise(none))


def marks(text: Column, words: str) -> Column:
    """Where words of an alternation start, overlaps included, as an array of structs (start, end), sorted. Null: null."""
    said = F.regexp_extract_all(text, F.lit(f"(?i)(?=({words}))"), F.lit(1))

    def put(found: Column) -> Column:
        before = totals_before(F.transform(F.split(text, f"(?i)(?=(?:{words}))"), F.length))
        # a word at the very start has no piece before it
        return let(before, lambda b: F.zip_with(F.slice(b, F.size(b) - F.size(found) + 1, F.size(found)), found, lambda a, w: F.struct(a.alias("start"), (a + F.length(w)).alias("end"))))

    return let(said, lambda f: F.when(F.size(f) > 0, put(f)).otherwise(F.when(text.isNotNull(), empty("struct<start:int,end:int>"))))


#: Characters of a chunk that pieces are cut from.
CHUNK = 4096


def replaced(text: Column, spans: Column) -> Column:
    """text with spans, an array of structs (start, end, put) in order that don't overlap, replaced. Null: null.

    Pieces are cut out of short chunks, as finding a place in a long text means walking to it.
    """

    def build(chunks: Column, parts: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
            at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
            head = F.substring(at(first), a % CHUNK + 1, F.lit(CHUNK))
            middle = F.array_join(F.slice(chunks, first + 2, last - first - 1), "")
            whole = F.concat(head, middle, F.substring(at(last), F.lit(1), b % CHUNK))
            return F.when(first == last, F.substring(at(first), a % CHUNK + 1, b - a)).otherwise(whole)

        ends = F.concat(F.array(F.lit(0)), F.transform(parts, lambda s: s["end"]))
        gaps = F.zip_with(F.slice(ends, 1, F.size(parts)), parts, lambda a, s: F.concat(cut(a, s["start"]), s["put"]))
        return F.concat(F.array_join(gaps, ""), cut(F.element_at(ends, -1), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(spans, lambda s: F.when(F.size(s) > 0, let(chunks, lambda c: build(c, s))).otherwise(text))
