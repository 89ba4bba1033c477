"""Mixing sources to target weights: documents by membership pattern, a min-cost flow, then seeded documents.

A document may belong to several sources. Documents of the same membership pattern are interchangeable for the flow:
each pattern offers its words once at no cost and a second time at a cost, and each source asks for its quota. The
flow decides how many words of a pattern go to which source; a seeded order of the documents then fills these amounts.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnquery.llm.session import join_small, written

#: Cost of a word's k-th use; convex, so that nothing is repeated before all has been used once.
REPEAT_COSTS = (0, 1)
#: Documents of a pattern are cut at a bucket of their seeded hash first, so that no pattern is ever sorted as a whole.
BUCKETS = 1 << 12


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares total by weight, no one above most * size; the excess is reshared by weight until none is above."""
    out, free = [0.0] * len(sizes), [k for k in range(len(sizes)) if weights[k] > 0]
    left = float(total)
    while free:
        unit = left / sum(weights[k] for k in free)
        full = [k for k in free if unit * weights[k] > most * sizes[k]]
        if not full:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        free = [k for k in free if k not in full]
    return out


def route(
    offers: list[tuple[int, tuple[int, ...]]], quotas: list[int], costs: tuple[int, ...] = REPEAT_COSTS
) -> list[list[dict[int, int]]]:
    """Words of each offer (size, members) that its k-th use gives to each source: a minimum-cost maximum flow.

    Only uses cost anything, and a unit of flow passes one use, so augmenting paths of the cheapest use come first:
    uses are opened one after another by cost, and each time a maximum flow is completed by shortest blocking flows.
    """
    n, m = len(offers), len(quotas)
    links: list[dict[int, int]] = [dict.fromkeys(members, 0) for _, members in offers]  # words that go to a source
    users: list[list[int]] = [[] for _ in range(m)]
    for k, (_, members) in enumerate(offers):
        for s in members:
            users[s].append(k)
    room, left = [0] * n, list(quotas)
    used = [[0] * len(costs) for _ in offers]
    for use in sorted(range(len(costs)), key=lambda k: costs[k]):
        for k, (size, _) in enumerate(offers):
            room[k] = size
        while True:
            # levels from the offers with room; a source without quota passes on by taking back from its users
            level = [0 if room[k] else -1 for k in range(n)]
            source_level = [-1] * m
            queue, ends = deque(k for k in range(n) if room[k]), -1
            while queue:
                k = queue.popleft()
                if 0 <= ends <= level[k]:
                    break
                for s in links[k]:
                    if source_level[s] >= 0:
                        continue
                    source_level[s] = level[k] + 1
                    if left[s]:
                        ends = level[k] + 1
                    for j in users[s] if not left[s] else ():
                        if level[j] < 0 and links[j][s]:
                            level[j] = source_level[s] + 1
                            queue.append(j)
            if ends < 0:
                break
            tried, backed = [0] * n, [0] * m
            for start in range(n):
                while room[start]:
                    found = _path(start, offers, users, links, left, level, source_level, tried, backed)
                    if not found:
                        break
                    amount = min([room[start], left[found[-1][1]], *[links[k][s] for k, s in found[1::2]]])
                    for at, (k, s) in enumerate(found):
                        links[k][s] += amount if at % 2 == 0 else -amount
                    room[start] -= amount
                    left[found[-1][1]] -= amount
        for k, (size, _) in enumerate(offers):
            used[k][use] = size - room[k]
    out = []
    for k in range(n):
        given, rows = dict(links[k]), []
        for amount in used[k]:  # the split of a use over sources is by source order
            row = {}
            for s in given:
                row[s] = min(amount, given[s])
                given[s] -= row[s]
                amount -= row[s]
            rows.append(row)
        out.append(rows)
    return out


def _path(start, offers, users, links, left, level, source_level, tried, backed) -> list[tuple[int, int]]:
    """An augmenting path of the shortest length as (offer, source) pairs, in turn words given and words taken back.

    tried and backed count the sources of an offer and the users of a source that are dead ends of this blocking flow.
    """
    path: list[tuple[int, int]] = []
    at = start
    while True:
        members, back = offers[at][1], None
        while back is None and tried[at] < len(members):
            s = members[tried[at]]
            if source_level[s] == level[at] + 1:
                if left[s]:
                    return [*path, (at, s)]
                while backed[s] < len(users[s]):
                    j = users[s][backed[s]]
                    if level[j] == source_level[s] + 1 and links[j][s]:
                        back = j
                        break
                    backed[s] += 1
            if back is None:
                tried[at] += 1
            else:
                path += [(at, s), (back, s)]
        if back is not None:
            at = back
            continue
        level[at] = -1
        if not path:
            return []
        at = path[-2][0]
        del path[-2:]


def mix_to_targets(
    docs: DataFrame, sources_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
    cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """docs with size, source_size, target and taken, the words that the mix takes of each, repeats counted.

    sources_col is a string or an array of the sources that a row belongs to; null is a source of its own, the last by
    order of names. Sources weigh as in cycle, repeating, and share `share` times all words, none above `most` times its
    own. For rows of several sources source_size and target are those of the first. A row is taken whole, up to twice,
    so that each source is off by less than a document; rows without words are never taken. Null texts have size 0.
    Which rows are repeated or left out is drawn by a hash of the seed and the row; of equal rows as many are taken as
    the amount asks for. Columns named size, source_size, target or taken are replaced, any others kept.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    kinds = dict(docs.dtypes)
    null = F.lit(None).cast("string")
    if kinds[sources_col].startswith("array"):
        names = F.array_sort(F.array_distinct(F.col(sources_col)))
    else:
        names = F.array(F.col(sources_col).cast("string"))
    names = F.when(names.isNull() | (F.size(names) == 0), F.array(null)).otherwise(names)
    # names without nulls, so that they can be joined on
    key = F.transform(names, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("-")))
    words = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    hashed = [id_col, text_col, *sorted(c for c, t in kinds.items() if c not in (id_col, text_col) and "map<" not in t)]
    draw = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in hashed])
    bucket = F.pmod("draw", F.lit(BUCKETS)).alias("bucket")
    # the rows themselves stay in one struct, so that their columns meet none of ours
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if docs.columns else F.struct().alias("row")
    full = docs.select(row, key.alias("key"), words.alias("size"), draw.alias("draw")).select("*", bucket)
    slim = written(full.select("key", "size", "draw", "bucket"), "sizes")
    by_bucket = slim.groupBy("key", "bucket").agg(F.sum("size").alias("size"))
    patterns = [(tuple(r["key"]), r["size"]) for r in by_bucket.groupBy("key").agg(F.sum("size").alias("size")).collect()]
    rank = lambda s: (s == "-", s)
    patterns.sort(key=lambda r: [rank(s) for s in r[0]])
    ordered = sorted({s for k, _ in patterns for s in k}, key=rank)
    place = {s: k for k, s in enumerate(ordered)}
    sizes = [0] * len(ordered)
    for k, size in patterns:
        for s in k:
            sizes[place[s]] += size
    weights = [cycle[k % len(cycle)] for k in range(len(ordered))]
    targets = water_fill(sizes, weights, share * sum(size for _, size in patterns), most)
    uses = route([(size, tuple(place[s] for s in k)) for k, size in patterns], [round(t) for t in targets])
    rows = [
        (list(k), u, sum(use.values()), sizes[place[k[0]]], targets[place[k[0]]])
        for (k, _), both in zip(patterns, uses, strict=True)
        for u, use in enumerate(both)
    ]
    plan = docs.sparkSession.createDataFrame(
        rows, "key array<string>, use int, words long, source_size long, target double"
    )
    plan = written(_cuts(slim, by_bucket, plan), "plan")
    full = join_small(full, plan, "key", limit=PATTERNS_SENT)
    partly = [F.col(f"some_{u}") for u in range(2)]
    at = [(F.col("bucket") == F.col(f"bucket_{u}")) & (F.col("draw") == F.col(f"last_{u}")) for u in range(2)]
    split = [a & p.isNotNull() for a, p in zip(at, partly, strict=True)]

    def wholly(u: int) -> Column:
        cut = (F.col("bucket") == F.col(f"bucket_{u}")) & (F.col("draw") <= F.col(f"last_{u}"))
        return F.coalesce((F.col("bucket") < F.col(f"bucket_{u}")) | cut, F.lit(False))

    def result(df: DataFrame, taken: Column) -> DataFrame:
        kept = [F.col("row").getField(c).alias(c) for c in docs.columns]
        return df.select(*kept, "size", "source_size", "target", (F.col("size") * taken).alias("taken"))

    if plan.where(partly[0].isNotNull() | partly[1].isNotNull()).isEmpty():
        return result(full, wholly(0).cast("long") + wholly(1).cast("long"))
    # equal rows of which some are taken: numbered within the files they are written to, and these by running sums
    is_split = F.coalesce(split[0] | split[1], F.lit(False))
    ties = written(full.where(is_split).withColumn("n", F.monotonically_increasing_id()), "ties")
    ties = ties.withColumn("file", F.shiftright("n", 33))
    files = Window.partitionBy("key", "draw").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = ties.groupBy("key", "draw", "file").agg(F.count("*").alias("rows"))
    before = before.select("key", "draw", "file", F.coalesce(F.sum("rows").over(files), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("key", "draw", "file").orderBy("n")) + F.col("before")
    ties = ties.join(before, ["key", "draw", "file"]).withColumn("number", number)
    takes = [F.when(s, F.col("number") <= p).otherwise(wholly(u)) for u, (s, p) in enumerate(zip(split, partly, strict=True))]
    rest = result(full.where(~is_split), wholly(0).cast("long") + wholly(1).cast("long"))
    return rest.union(result(ties, takes[0].cast("long") + takes[1].cast("long")))


#: Membership patterns up to which the plan is sent to all tasks; a larger one is joined by a shuffle.
PATTERNS_SENT = 100_000


def _cuts(slim: DataFrame, by_bucket: DataFrame, plan: DataFrame) -> DataFrame:
    """Per key: source_size, target, and for each use u where it ends: bucket_u, last_u (the last draw that is taken)
    and, if only some of several equal rows with that draw are, their number some_u.

    A row is taken if that brings the sum nearer to the amount, so rows before an end are taken in the order of draws.
    """
    upto = F.sum("size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ran = plan.join(by_bucket.select("key", "bucket", upto.alias("upto")), "key", "left")
    over = F.col("upto") > F.col("words")
    ends = ran.groupBy("key", "use", "words", "source_size", "target").agg(
        F.coalesce(F.min(F.when(over, F.col("bucket"))), F.lit(BUCKETS)).cast("long").alias("bucket"),
        F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("before"),
    )
    ends = ends.withColumn("left", F.col("words") - F.col("before"))
    each = join_small(slim.where("size > 0"), ends.select("key", "bucket", "use", "left"), ["key", "bucket"], limit=2 * PATTERNS_SENT)
    each = each.groupBy("key", "use", "left", "draw", "size").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("key", "use").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("sum", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0)))
    some = F.floor((F.col("left") - F.col("sum")) / F.col("size") + 0.5)
    each = each.withColumn("some", F.least(some, F.col("rows"))).where("some > 0")
    last = each.groupBy("key", "use").agg(F.max_by(F.struct("draw", "some", "rows"), F.struct("draw", "size")).alias("last"))
    ends = ends.join(last, ["key", "use"], "left")
    pick = lambda u, c: F.max(F.when(F.col("use") == u, c))
    partly = F.when(F.col("last.some") < F.col("last.rows"), F.col("last.some"))
    columns = [
        c for u in range(2)
        for c in (pick(u, F.col("bucket")).alias(f"bucket_{u}"), pick(u, F.col("last.draw")).alias(f"last_{u}"), pick(u, partly).alias(f"some_{u}"))
    ]
    return ends.groupBy("key").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), *columns)
