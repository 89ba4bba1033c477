"""Language-model scoring with a probabilistic suffix tree over words.

A state is a context of up to `depth` words that occurs at least MIN_COUNT times in the training texts, however many
such contexts there are. It stays if its next-word distribution diverges from that of its suffix: if the followers seen
again are predicted better by at least DIVERGENCE nats an occurrence than the suffix predicts them, after paying for the
mass that goes back to the suffix. Distributions are smoothed by absolute discounting with a discount of one: a follower
seen c times has c - 1 of the n occurrences, and the rest, one for each different follower, is shared out by the suffix.
A word is scored in the longest retained suffix of the words before it; the root is the add-one unigram distribution.

The tree grows breadth first. In round k chunks of text ask buckets about the contexts of k words that occur more than
once, and only about followers that the suffix has more than once, as all others have no mass of their own. How often
a context occurs is known from the round before: it is the count of its last word in the context before that word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnquery.llm.exchange import CHUNK, bucket_edges, chunked, pack, pack_counts, rows_of, unpack, unpack_counts
from tarnquery.llm.hashing import U, join, slices, string_parts, tokenise, trim
from tarnquery.llm.session import written

#: Longest context in words; least number of its occurrences; least gain (nats an occurrence) over its suffix.
DEPTH, MIN_COUNT, DIVERGENCE = 3, 2, 0.02
#: The token after the last word of a text.
END = U(0x5851F42D4C957F2D)
#: Bits by which contexts of a length are told apart. Followers of one context are told apart by 32.
CONTEXT_BITS = 44
#: Followers of a context of more occurrences are dealt to several buckets, so that no hot context fills one.
HOT = 4_000_000
#: Steps of an eighth of a nat in which a suffix's probability is sent for the divergence test.
STEPS = 8
SENT = "bucket int, chunk long, keys binary, n binary, sizes binary, tokens binary, counts binary, q binary"
REPLY = "level int, bucket int, chunk long, mass binary, counts binary, ctx long, total long, kinds long, cells binary"


@dataclass(frozen=True)
class Tree:
    """What all tasks need to know: limits, the root's totals, and per round the masses of hot contexts."""

    buckets: int
    depth: int
    least: int
    divergence: float
    hot: int
    total: int = 0
    kinds: int = 0
    hot_ctx: tuple[np.ndarray, ...] = ()
    hot_mass: tuple[np.ndarray, ...] = ()


def grouped(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the distinct keys, in the order of keys, and of each position the number of its key.

    Keys are below 2**bits. Where a position fits beside them, they are sorted together, which is much faster.
    """
    room = max(1, (len(keys) - 1).bit_length())
    if bits + room > 64 or not len(keys):
        return np.unique(keys, return_index=True, return_inverse=True)[1:]
    both = keys.astype(U) << U(room) | np.arange(len(keys), dtype=U)
    both.sort()
    at = (both & U((1 << room) - 1)).astype(np.int64)
    both >>= U(room)
    new = np.ones(len(keys), bool)
    new[1:] = both[1:] != both[:-1]
    number = np.empty(len(keys), np.int64)
    number[at] = np.cumsum(new) - 1
    return at[new], number


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and of each position the number of its hash."""
    bits = 64 - max(1, (len(hashes) - 1).bit_length())
    first, number = grouped(hashes >> U(64 - bits), bits)
    words = hashes[first]
    if (words[number] == hashes).all():
        return words, number
    return np.unique(hashes, return_inverse=True)  # the leading bits don't tell all of them apart


@dataclass
class Text:
    """Tokens of a chunk with an end after each text: distinct ones, which one stands where and its hash, its place in
    its text, the document, and whether it is learnt from."""

    words: np.ndarray
    token: np.ndarray
    hash: np.ndarray
    place: np.ndarray
    doc: np.ndarray
    train: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Text:
        data, offs = string_parts(rows["text"])
        learnt = np.asarray(rows["train"].combine_chunks()) if rows.num_rows else np.zeros(0, bool)
        tokens, docs = [np.zeros(0, U)], [np.zeros(0, np.int32)]
        for a, b in slices(offs):
            w = tokenise(data, offs[a : b + 1], lower=True)
            token = np.full(len(w.hash) + b - a, END, U)
            token[np.arange(len(w.hash)) + w.doc] = w.hash
            tokens.append(token)
            docs.append(np.repeat(np.arange(a, b, dtype=np.int32), w.counts + 1))
        doc, hashes = np.concatenate(docs), np.concatenate(tokens)
        first = np.searchsorted(doc, np.arange(rows.num_rows)).astype(np.int32)
        words, token = _distinct(hashes)
        place = np.arange(len(doc), dtype=np.int32) - first[doc]
        return Text(words, token.astype(np.int32), hashes, place, doc, learnt[doc])


@dataclass
class Ask:
    """A chunk's entries of a round, by bucket and context, and the pairs of an entry and a follower.

    at: positions in such a context, of: their contexts; pair_at: those whose follower is asked about, pair_of: its pair.
    """

    at: np.ndarray
    of: np.ndarray
    keys: np.ndarray
    parts: np.ndarray
    pair_at: np.ndarray
    pair_of: np.ndarray
    entry_key: np.ndarray
    entry_n: np.ndarray
    edges: np.ndarray
    pair_entry: np.ndarray
    pair_token: np.ndarray
    pair_first: np.ndarray
    entry_of_key: np.ndarray

    @staticmethod
    def of_positions(at: np.ndarray, ctx: np.ndarray, n: np.ndarray, again: np.ndarray, text: Text, tree: Tree) -> Ask:
        """at: positions, with their contexts, how often these occur, and whether the suffix has the follower twice."""
        short = ctx >> U(64 - CONTEXT_BITS)
        first, of = grouped(short, CONTEXT_BITS)
        keys = short[first]
        parts = -(-n[first] // tree.hot)
        start = np.cumsum(parts) - parts
        bucket = (np.repeat(keys << U(64 - CONTEXT_BITS) >> U(32), parts) * U(tree.buckets) >> U(32)).astype(np.int64)
        bucket = (bucket + np.arange(len(bucket)) - np.repeat(start, parts)) % tree.buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair_at, ctx_of = at[again], of[again]
        token = text.token[pair_at]
        low = text.words & U(0xFFFFFFFF)
        entry = place[start[ctx_of] + (low[token].astype(np.int64) % parts[ctx_of] if (parts > 1).any() else 0)]
        bits = max(1, (len(text.words) - 1).bit_length())
        pair_first, pair_of = grouped(entry << bits | token, bits + max(1, len(order).bit_length()))
        edges = np.searchsorted(bucket[order], np.arange(tree.buckets + 1))
        return Ask(
            at, of, keys, parts, pair_at, pair_of, np.repeat(keys, parts)[order], np.repeat(n[first], parts)[order],
            edges, entry[pair_first], low[token[pair_first]].astype(np.uint32), pair_at[pair_first], place[start],
        )

    def rows(self, chunk: int, train: np.ndarray, p: np.ndarray) -> pa.Table:
        counts = np.bincount(self.pair_of, train[self.pair_at], minlength=len(self.pair_token)).astype(np.int64)
        q = np.clip(np.round(-STEPS * np.log(p[self.pair_first])), 0, 255).astype(np.uint8)
        cut = np.searchsorted(self.pair_entry, self.edges)
        out = []
        for b in range(len(self.edges) - 1):
            x, y, i, j = self.edges[b], self.edges[b + 1], cut[b], cut[b + 1]
            if y > x:
                sizes = np.bincount(self.pair_entry[i:j] - x, minlength=y - x)
                packed = [pack(self.entry_key[x:y]), *map(pack_counts, (self.entry_n[x:y], sizes))]
                out.append((b, chunk, *packed, self.pair_token[i:j].tobytes(), pack_counts(counts[i:j]), q[i:j].tobytes()))
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        names = [f.split(" ")[0] for f in SENT.split(", ")]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def _walk(text: Text, replies: dict[int, list], tree: Tree, ask_at: int = 0):
    """Goes through the rounds: the Ask of round ask_at, or None after all; probabilities so far; counts of the words."""
    known = np.concatenate([unpack_counts(r[2]) for r in replies[0]])[text.token]
    p = (known + 1.0) / (tree.total + tree.kinds + 1)
    c, n_suffix = known, None
    # positions whose context may be a state: with enough occurrences of it and so of all its suffixes
    at = np.flatnonzero((text.place[1:] > 0) & (c[:-1] >= tree.least)) + 1
    ctx = np.zeros(len(at), U)
    for k in range(1, tree.depth + 1):
        if k > 1:
            alive = (c[at - 1] >= tree.least) & (text.place[at] >= k)
            at, ctx = at[alive], ctx[alive]
        n = c[at - 1]
        ctx = join(text.hash[at - k], ctx)
        # else every occurrence of the suffix is one of the context
        differs = n < (tree.total if n_suffix is None else n_suffix[at])
        own = at[differs]
        ask = Ask.of_positions(own, ctx[differs], n[differs], c[own] > 1, text, tree)
        if k == ask_at:
            return ask, p, known
        got = replies.get(k, ())
        mass, counts = (np.concatenate([np.zeros(0, np.int64), *[unpack_counts(r[j]) for r in got]]) for j in (1, 2))
        by_ctx = mass[ask.entry_of_key] if len(mass) else mass
        if len(tree.hot_ctx[k]) and (ask.parts > 1).any():
            some = np.flatnonzero(ask.parts > 1)
            by_ctx[some] = tree.hot_mass[k][np.searchsorted(tree.hot_ctx[k], ask.keys[some])]
        now = np.zeros_like(c)
        same = at[~differs]
        now[same] = c[same]
        now[ask.pair_at] = counts[ask.pair_of]
        n_suffix = np.zeros_like(c)
        n_suffix[at] = n
        m = by_ctx[ask.of]
        own, m = own[m > 0], m[m > 0]
        p[own] = (np.maximum(now[own] - 1, 0) + (n_suffix[own] - m) * p[own]) / n_suffix[own]
        c = now
    return None, p, known


def _by_level(right: pa.Table) -> dict[int, list]:
    out: dict[int, list] = {}
    columns = [right[c].to_pylist() for c in ("level", "bucket", "mass", "counts")]
    for level, bucket, mass, counts in zip(*columns, strict=True):
        out.setdefault(level, []).append((bucket, mass, counts))
    return {k: sorted(v, key=lambda r: r[0]) for k, v in out.items()}


def _send_words(chunk: pa.Table, buckets: int) -> pa.Table:
    """The distinct words of a chunk with their training counts, to buckets by range of hash."""
    text = Text.of(rows_of(chunk))
    words = text.words
    counts = np.bincount(text.token, text.train, minlength=len(words)).astype(np.int64)
    edges = bucket_edges(words, buckets)
    some = [b for b in range(buckets) if edges[b + 1] > edges[b]]
    cut = [slice(edges[b], edges[b + 1]) for b in some]
    out = pa.table({
        "bucket": pa.array(some, pa.int32()), "chunk": pa.array([chunk[CHUNK][0].as_py()] * len(some), pa.int64()),
        "keys": pa.array([pack(words[x]) for x in cut], pa.binary()),
        "counts": pa.array([pack_counts(counts[x]) for x in cut], pa.binary()),
    })
    trim()
    return out


def _reply(level: int, bucket: int, chunks: list, mass: list, counts: list, ctx=(), total=(), kinds=(), cells=()) -> pa.Table:
    """Answers to chunks, then rows of the bucket's own: totals of the root, or masses, sizes and followers of hot contexts."""
    k, m = len(chunks), len(total)
    columns = [
        [level] * (k + m), [bucket] * (k + m), [*chunks, *[None] * m], [*mass, *[None] * m], [*counts, *[None] * m],
        [*[None] * k, *(ctx or [None] * m)], [*[None] * k, *total], [*[None] * k, *(kinds or [None] * m)],
        [*[None] * k, *(cells or [None] * m)],
    ]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 3, pa.binary()]
    names = [f.split(" ")[0] for f in REPLY.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _count_words(table: pa.Table) -> pa.Table:
    sent = [unpack(v) for v in table["keys"].to_pylist()]
    words, at = np.unique(np.concatenate(sent), return_inverse=True)
    counts = np.concatenate([unpack_counts(v) for v in table["counts"].to_pylist()])
    total = np.bincount(at, counts, minlength=len(words)).astype(np.int64)
    each = [pack_counts(v) for v in np.split(total[at], np.cumsum([len(s) for s in sent])[:-1])]
    bucket, chunks = table["bucket"][0].as_py(), table["chunk"].to_pylist()
    out = _reply(0, bucket, chunks, [None] * len(chunks), each, None, [int(total.sum())], [int((total > 0).sum())])
    trim()
    return out


def gain(ctx: np.ndarray, n: np.ndarray, c: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts with n occurrences and (ctx, c, q) followers: the mass of followers seen again, and the gain in nats."""
    again = np.maximum(c - 1, 0)
    mass = np.bincount(ctx, again, minlength=len(n)).astype(np.int64)
    rest = n - mass
    own = (again + rest[ctx] * q) / n[ctx]
    better = np.bincount(ctx, again * np.log(own / q), minlength=len(n))
    return mass, better + rest * np.log(rest / n)


def _cells(again: np.ndarray, step: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Followers as the different (seen again, step of the suffix's probability), and the number of each."""
    code, at = np.unique(again << 8 | step, return_inverse=True)
    return code >> 8, code & 255, np.bincount(at, number, minlength=len(code)).astype(np.int64)


def _test_hot(ctx: int, table: pa.Table, divergence: float) -> pa.Table:
    """The mass of a hot context over all its buckets, or 0 if it predicts no better than its suffix."""
    n, mass = table["kinds"][0].as_py(), sum(table["total"].to_pylist())
    parts = [np.frombuffer(v, np.int64).reshape(3, -1) for v in table["cells"].to_pylist()]
    again, step, number = _cells(*np.concatenate(parts, 1))
    q, rest = np.exp(step / -STEPS), n - mass
    better = float((number * again * np.log((again + rest * q) / (n * q))).sum() + rest * np.log(rest / n)) if mass else 0.0
    return pa.table({"ctx": pa.array([ctx], pa.int64()), "mass": pa.array([mass if better >= divergence * n else 0], pa.int64())})


def _count(table: pa.Table, level: int, tree: Tree) -> pa.Table:
    """Of one bucket's contexts: their mass if they are retained, else 0, and the training counts of all followers."""
    sent = [unpack(v) for v in table["keys"].to_pylist()]
    keys, first, at = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    n = np.concatenate([unpack_counts(v) for v in table["n"].to_pylist()])[first]
    of = np.repeat(at, np.concatenate([unpack_counts(v) for v in table["sizes"].to_pylist()]))
    tokens = [np.frombuffer(v, np.uint32) for v in table["tokens"].to_pylist()]
    pairs, first, back = np.unique(of << 32 | np.concatenate(tokens), return_index=True, return_inverse=True)
    counts = np.concatenate([unpack_counts(v) for v in table["counts"].to_pylist()])
    c = np.bincount(back, counts, minlength=len(pairs)).astype(np.int64)
    steps = np.concatenate([np.frombuffer(v, np.uint8) for v in table["q"].to_pylist()])[first]
    mass, better = gain(pairs >> 32, n, c, np.exp(steps / -STEPS))
    hot = np.flatnonzero(n > tree.hot)  # their followers are elsewhere too, so they are tested once these are together
    edges = np.searchsorted(pairs, np.stack([hot, hot + 1]) << 32)
    cells = []
    for a, b in edges.T.tolist():
        seen = c[a:b] > 1
        cells.append(np.stack(_cells(c[a:b][seen] - 1, steps[a:b][seen].astype(np.int64))).tobytes())
    kept = np.where((better >= tree.divergence * n) & (mass > 0), mass, 0)
    each = [pack_counts(v) for v in np.split(kept[at], np.cumsum([len(s) for s in sent])[:-1])]
    by_pair = [pack_counts(v) for v in np.split(c[back], np.cumsum([len(s) for s in tokens])[:-1])]
    bucket = table["bucket"][0].as_py()
    ctx = keys[hot].astype(np.int64).tolist()
    out = _reply(level, bucket, table["chunk"].to_pylist(), each, by_pair, ctx, mass[hot].tolist(), n[hot].tolist(), cells)
    trim()
    return out


def _send(left: pa.Table, right: pa.Table, level: int, tree: Tree) -> pa.Table:
    text = Text.of(rows_of(left))
    ask, p, _ = _walk(text, _by_level(right), tree, level)
    out = ask.rows(left[CHUNK][0].as_py(), text.train, p)
    trim()
    return out


def _score(left: pa.Table, right: pa.Table, tree: Tree) -> pa.Table:
    rows = rows_of(left)
    text = Text.of(rows)
    _, p, known = _walk(text, _by_level(right), tree)
    counts = np.concatenate([unpack_counts(r[2]) for r in _by_level(right)[0]])
    base = np.log10((counts + 1) / (tree.total + tree.kinds + 1))[text.token]
    by = lambda v: np.bincount(text.doc, v, minlength=rows.num_rows)
    out = pa.table({
        "id": rows["id"], "train": rows["train"], "n_tokens": pa.array(by(None)),
        "n_known": pa.array(by(known > 0).astype(np.int64)), "train_tokens": pa.array(np.full(rows.num_rows, tree.total)),
        "base_score": pa.array(by(base)), "score": pa.array(by(np.log10(p))),
    })
    trim()
    return out


def score_texts(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
    least: int = MIN_COUNT, divergence: float = DIVERGENCE,
) -> DataFrame:
    """Per row: id, train, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).

    train says which rows the model learns from. Words are split at ASCII white space with A-Z lower-cased, and each
    text ends with an end token; a null or empty text is the end token alone. Without training rows every token is
    unknown and both scores are those of the uniform root. Rows that repeat are each scored, and each learnt from.
    Other columns of docs are ignored, whatever their names.
    """
    given = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    chunks, buckets = chunked(given, "text")
    chunks = chunks.persist(StorageLevel.DISK_ONLY)  # every round reads them; a lost part is packed again from docs
    tree = Tree(buckets, depth, max(2, least), divergence, HOT)
    send_words = partial(_send_words, buckets=buckets)
    sent = chunks.groupBy(CHUNK).applyInArrow(
        lambda key, table: send_words(table), "bucket int, chunk long, keys binary, counts binary"
    )
    levels = [written(sent.groupBy("bucket").applyInArrow(lambda key, table: _count_words(table), REPLY), "words")]
    root = levels[0].where("chunk is null").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).first()
    none = np.zeros(0, np.int64)
    tree = Tree(buckets, depth, tree.least, divergence, HOT, root.total or 0, root.kinds or 0, (none,), (none,))

    def replies() -> DataFrame:
        return reduce(DataFrame.union, levels).where("chunk is not null").select(CHUNK, "level", "bucket", "mass", "counts")

    for level in range(1, depth + 1):
        send, count = _round(level, tree)
        asked = chunks.groupBy(CHUNK).cogroup(replies().groupBy(CHUNK)).applyInArrow(send, SENT)
        levels.append(written(asked.groupBy("bucket").applyInArrow(count, REPLY), "contexts"))
        # contexts of more than HOT occurrences: fewer than one in HOT tokens, each tested over all its buckets
        parts = levels[-1].where("chunk is null").select("ctx", "total", "kinds", "cells").groupBy("ctx")
        test = partial(_test_hot, divergence=divergence)
        hot = parts.applyInArrow(lambda key, table: test(key[0].as_py(), table), "ctx long, mass long").collect()
        hot = sorted(hot, key=lambda r: r.ctx & (1 << 64) - 1)
        ctx, mass = (np.array([r[k] for r in hot], t) for k, t in ((0, U), (1, np.int64)))
        tree = Tree(*[getattr(tree, f) for f in ("buckets", "depth", "least", "divergence", "hot", "total", "kinds")],
                    (*tree.hot_ctx, ctx), (*tree.hot_mass, mass))
    schema = f"id {dict(docs.dtypes)[id_col]}, train boolean, n_tokens long, n_known long, train_tokens long"
    score = partial(_score, tree=tree)
    scored = chunks.groupBy(CHUNK).cogroup(replies().groupBy(CHUNK)).applyInArrow(
        lambda key, left, right: score(left, right), f"{schema}, base_score double, score double"
    )
    out = written(scored, "scores")
    chunks.unpersist()
    return out


def _round(level: int, tree: Tree):
    def send(key, left, right):
        return _send(left, right, level, tree)

    def count(key, table):
        return _count(table, level, tree)

    return send, count
