"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, then a linear classifier.

Voters look at a text and vote toxic (1), clean (-1) or abstain (0). The label model is generative: given the class, each
vote depends on the vote of one other voter, along the tree of voters that shares the most information within classes.
So what a voter says beyond its neighbour counts, and correlated voters aren't counted twice. Accuracies, correlations
and the tree are estimated by expectation maximisation over the votes of all documents, with the known labels of
training rows held fixed. A logistic regression over counts and votes is then trained on the model's posterior labels.
Besides the fixed lexicon, voters look for stems learnt from training labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnquery.llm.hashing import LOWER, NOT_ALNUM, prefixes, slices, string_parts, tokenise, trim
from tarnquery.llm.session import join_small, written

# Common insults by kind. Words of several languages stand together, as texts mix them.
LEXICON: dict[str, tuple[str, ...]] = {
    "stupidity": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "dumb", "dumbass", "imbecile", "imbeciles", "fool", "fools", "dimwit", "halfwit", "dunce", "cretin", "brainless", "retard", "retarded", "simpleton", "airhead", "blockhead"),
    "worthlessness": ("worthless", "useless", "loser", "losers", "pathetic", "failure", "nobody", "good-for-nothing", "parasite", "leech", "waste"),
    "disgust": ("disgusting", "trash", "scum", "scumbag", "filth", "filthy", "garbage", "vermin", "vile", "repulsive", "revolting", "sleazy", "lowlife", "pig", "swine", "rat", "maggot"),
    "mockery": ("clown", "clowns", "joke", "laughable", "ridiculous", "crybaby", "coward", "cowards", "freak", "freaks", "weirdo", "creep", "creeps", "liar", "liars", "hypocrite", "jerk", "jerks", "psycho", "lunatic"),
    "profanity": ("damn", "crap", "bastard", "bastards", "bitch", "bitches", "ass", "asshole", "assholes", "shit", "shitty", "bullshit", "fuck", "fucking", "fucker", "piss", "prick", "dick", "douche", "slut", "whore", "cunt", "twat", "wanker"),
    "hostility": ("hate", "kill", "murder", "strangle", "destroy", "hurt", "suffer", "rot", "perish"),
    "german": ("idioten", "dummkopf", "dumm", "blöd", "trottel", "arschloch", "scheiße", "scheisse", "schwachkopf", "versager", "abschaum", "wertlos", "erbärmlich", "ekelhaft", "widerlich", "depp", "vollidiot", "drecksack", "hurensohn", "wichser"),
    "french": ("idiote", "imbécile", "crétin", "stupide", "connard", "connasse", "salaud", "merde", "ordure", "minable", "pathétique", "dégoûtant", "bouffon", "abruti", "débile", "raclure", "pute", "enfoiré", "inutile"),
    "spanish": ("idiota", "idiotas", "imbécil", "estúpido", "estúpida", "tonto", "basura", "escoria", "patético", "asqueroso", "inútil", "payaso", "perdedor", "mierda", "cabrón", "puta", "pendejo", "gilipollas", "malnacido"),
}
SECOND_PERSON = ("you", "your", "youre", "u", "ur", "du", "ihr", "dein", "tu", "vous", "toi", "eres", "usted", "ustedes")
KINDS = tuple(LEXICON)
#: Votes besides one for each kind of word.
PATTERNS = ("two_hits", "two_kinds_of_word", "three_kinds_of_word", "density", "second_person", "exclaimed", "shouted", "repeated", "early", "lone_mention", "two_stems", "four_stems", "stem_density", "nothing")
VOTERS = KINDS + PATTERNS
FEATURES = (*(f"log_{k}" for k in KINDS), "log_hits", "log_distinct", "density", "log_words", "log_stems", "stem_density", *VOTERS)
#: Bytes of a stem: the start of words that toxic training texts hold far more often than clean ones.
STEM_BYTES = (4, 5, 6, 7, 8, 10)
#: Documents, at most about, whose posterior labels train the linear classifier, and whose labels yield learnt stems.
SAMPLE = 40_000
LABELLED = 20_000
#: Weight of a document without a known label in the label model, against one with a label.
UNLABELLED = 0.1
#: Votes by which a voter's dependence on its neighbour is drawn towards independence.
SMOOTHING = 5.0


def _hash(words) -> np.ndarray:
    data, offs = string_parts(pa.array(words))
    return tokenise(data, offs, lower=True, separators=NOT_ALNUM).hash


def _table() -> tuple[np.ndarray, np.ndarray]:
    terms = [(w, k) for k, kind in enumerate(KINDS) for w in LEXICON[kind] if w.isalnum()]
    hashes = _hash([w for w, _ in terms])
    order = np.argsort(hashes)
    return hashes[order], np.array([k for _, k in terms])[order]


def features(text: pa.Array, stems: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; empty and null texts have no hits and abstain or vote clean alike."""
    data, offs = string_parts(text)
    terms, kind = _table()
    second = np.sort(_hash(SECOND_PERSON))
    blocks = [np.zeros((0, len(FEATURES)))]
    for a, b in slices(offs):
        w, n = tokenise(data, offs[a : b + 1], lower=True, separators=NOT_ALNUM), b - a
        raw = data[offs[a] : offs[b]]
        at = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == w.hash)
        doc, term = w.doc[hit], at[hit]
        by_kind = np.zeros((n, len(KINDS)))
        np.add.at(by_kind, (doc, kind[term]), 1)
        hits, words = by_kind.sum(1), w.counts
        pairs, seen = np.unique(doc * len(terms) + term, return_counts=True)
        distinct = np.bincount(pairs // len(terms), minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, pairs // len(terms), seen)
        flag = lambda mask: np.bincount(doc[mask], minlength=n) > 0
        you = np.zeros(len(hit), bool)
        for k in (1, 2, 3):
            before = np.maximum(hit - k, 0)
            you |= (hit - k >= w.first[doc]) & np.isin(w.hash[before], second)
        after = np.minimum(w.end[hit], max(0, len(raw) - 1))
        loud = (w.end[hit] < (offs[a : b + 1] - offs[a])[doc + 1]) & (raw[after] == ord("!")) if len(hit) else np.zeros(0, bool)
        caps = (raw[w.start[hit]] != LOWER[raw[w.start[hit]]]) & (raw[w.end[hit] - 1] != LOWER[raw[w.end[hit] - 1]])
        early = hit - w.first[doc] < 30
        density = hits / np.maximum(words, 1)
        learnt = np.zeros(len(w.hash), bool)
        for size in STEM_BYTES if len(stems) else ():
            where, h = prefixes(w, size)
            learnt[where] |= stems[np.minimum(np.searchsorted(stems, h), len(stems) - 1)] == h
        learnt[hit] = False  # lexicon words have voters of their own
        stem_hits = np.bincount(w.doc[learnt], minlength=n)
        stem_density = stem_hits / np.maximum(words, 1)
        votes = [np.where(by_kind[:, k] > 0, 1, 0) for k in range(len(KINDS))]
        votes += [
            hits >= 2, distinct >= 2, distinct >= 3, density >= 0.005, flag(you), flag(loud), flag(caps), most >= 2, flag(early),
            np.where((hits + stem_hits == 1) & (words > 100), -1, 0), stem_hits >= 2, stem_hits >= 4, stem_density >= 0.01, np.where(hits + stem_hits == 0, -1, 0),
        ]
        blocks.append(np.column_stack([np.log1p(by_kind), np.log1p(hits), np.log1p(distinct), np.minimum(density, 0.2) * 10, np.log1p(words), np.log1p(stem_hits), np.minimum(stem_density, 0.2) * 10, *votes]))
    return np.concatenate(blocks)


def _stem_counts(batches):
    """Of rows (text, y): in how many texts of a class each stem starts a word, and in how many two or more."""
    for batch in batches:
        data, offs = string_parts(batch.column(0))
        y = np.asarray(batch.column(1)) > 0
        for a, b in slices(offs):
            w = tokenise(data, offs[a : b + 1], lower=True, separators=NOT_ALNUM)
            doc = w.doc
            found = [(doc[at], h) for at, h in (prefixes(w, size) for size in STEM_BYTES)]
            at, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((h, at))
            at, h = at[order], h[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (h[1:] != h[:-1])
            new = np.flatnonzero(new)
            n = np.diff(new, append=len(at))
            stem, back = np.unique(h[new], return_inverse=True)
            toxic = y[a:b][at[new]]
            count = lambda mask: np.bincount(back, mask, minlength=len(stem)).astype(np.int64)  # noqa: E731, B023
            sums = [count(toxic), count(~toxic), count(toxic & (n > 1)), count(~toxic & (n > 1))]
            yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), *map(pa.array, sums)], ["stem", "toxic", "clean", "toxic_2", "clean_2"])


def learn_stems(docs: DataFrame, known: DataFrame, text_col: str = "text", labelled: int = LABELLED) -> np.ndarray:
    """Hashes of the stems that set toxic texts apart, from about `labelled` labelled rows chosen by a hash of the id.

    docs has id and text, known id and y. A stem counts if it starts a word in at least five toxic texts and is 20 times
    as frequent there as in clean texts, or 10 times where it starts two words of a text. All that pass are kept; their
    number is bounded by the sample.
    """
    n = max(1, known.count())
    share = min(1_000_000, max(1, int(1_000_000 * labelled / n)))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    rows = written(join_small(docs.select("id", text_col), chosen.select("id", "y"), "id", limit=4 * labelled).select(text_col, "y"), "labelled")
    size = {r.y > 0: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = rows.mapInArrow(_stem_counts, "stem long, toxic long, clean long, toxic_2 long, clean_2 long").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_2", "clean_2")])
    even = size.get(False, 0) / max(1, size.get(True, 0))
    odds = lambda t, c: F.col(t) * even / (F.col(c) + 0.5)
    strong = ((F.col("toxic") >= 5) & (odds("toxic", "clean") >= 20)) | ((F.col("toxic_2") >= 5) & (odds("toxic_2", "clean_2") >= 10))
    found = counts.where(strong).select("stem").collect()
    return np.sort(np.array([r.stem for r in found], np.int64).view(np.uint64))


def _features(batches, stems: np.ndarray):
    for batch in batches:
        x = features(batch.column(1), stems).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "x"])
    trim()


def _one_hot(votes: np.ndarray) -> np.ndarray:
    """Votes (-1, 0, 1) of K voters as 3 * K columns, those of a voter next to each other."""
    return (votes[:, :, None] == np.array([-1, 0, 1])).reshape(len(votes), -1).astype(float)


def _moments(batches, model: dict | None):
    """Sums over the vote patterns of a partition: by class, its weight and how often each two votes came together."""
    k = len(VOTERS)
    total = np.zeros(2 * (1 + 9 * k * k))
    for batch in batches:
        v = np.stack([np.asarray(batch.column(j)) for j in range(k)], 1) if batch.num_rows else np.zeros((0, k), int)
        n, y = np.asarray(batch.column(k)).astype(float), batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float)
        guess = 0.0 if model is None else posterior(v, model)
        p, trust = np.where(np.isnan(y), guess, y), np.where(np.isnan(y), 0.0 if model is None else UNLABELLED, 1.0)
        hot = _one_hot(v)
        sums = []
        for weight in (n * (1 - p) * trust, n * p * trust):
            sums += [np.array([weight.sum()]), ((hot * weight[:, None]).T @ hot).reshape(-1)]
        total += np.concatenate(sums)
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """P(toxic | votes) under the label model. An abstention says nothing."""
    score = np.full(len(votes), model["prior"])
    for k, parent in enumerate(model["parent"]):
        own = votes[:, k] + 1
        score += np.where(own == 1, 0.0, model["ratio"][k][votes[:, parent] + 1, own])
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _tree(shared: np.ndarray) -> np.ndarray:
    """The neighbour on which each voter depends: the spanning tree of the most shared information, from voter 0 on."""
    parent, best, done = np.zeros(len(shared), int), shared[0].copy(), np.zeros(len(shared), bool)
    done[0] = True
    for _ in range(len(shared) - 1):
        k = int(np.where(done, -np.inf, best).argmax())
        done[k] = True
        closer = ~done & (shared[k] > best)
        parent[closer], best[closer] = k, shared[k][closer]
    return parent


def _model(sums: np.ndarray) -> dict:
    """Prior log odds, and for each voter its neighbour and the log ratios of its votes given the neighbour's vote.

    The first voter is its own neighbour: its table has the ratio of its votes alone.
    """
    k = len(VOTERS)
    size, joint, own = [], [], []
    for half in np.split(sums, 2):
        table = half[1:].reshape(k, 3, k, 3).transpose(0, 2, 1, 3)
        size.append(half[0])
        joint.append(table)
        own.append((np.stack([np.diag(table[j, j]) for j in range(k)]) + 1.0) / (half[0] + 3.0))
    shared = np.zeros((k, k))
    for n, table, p in zip(size, joint, own, strict=True):
        both = (table + p[:, None, :, None] * p[None, :, None, :]) / (n + 1.0)
        apart = both.sum(3)[:, :, :, None] * both.sum(2)[:, :, None, :]
        shared += n / max(sum(size), 1e-9) * (both * np.log(both / apart)).sum((2, 3))
    parent = _tree(shared)
    ratio = []
    for j in range(k):
        logs = []
        for table, p in zip(joint, own, strict=True):
            if j == parent[j]:
                logs.append(np.log(np.broadcast_to(p[j], (3, 3))))
            else:
                seen = table[parent[j], j]
                logs.append(np.log((seen + SMOOTHING * p[j]) / (seen.sum(1, keepdims=True) + SMOOTHING)))
        ratio.append(logs[1] - logs[0])
    return {"prior": np.log((size[1] + 1) / (size[0] + 1)), "parent": parent.tolist(), "ratio": ratio}


def _guess() -> np.ndarray:
    """Sums to start from where no toxic label is known: independent voters that are right more often than not."""
    halves = []
    for size, vote in ((900.0, (0.6, 0.3, 0.1)), (100.0, (0.1, 0.3, 0.6))):
        p = np.tile(vote, len(VOTERS))
        table = size * np.outer(p, p)
        for j in range(0, len(p), 3):
            table[j : j + 3, j : j + 3] = size * np.diag(vote)
        halves += [np.array([size]), table.reshape(-1)]
    return np.concatenate(halves)


def _regression(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), x.T @ (p - q) - penalty * w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _score(batches, weights: np.ndarray, stems: np.ndarray, text: int):
    for batch in batches:
        z = features(batch.column(text), stems) @ weights[:-1] + weights[-1]
        score = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])
    trim()


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    """Rows whose labels are never learnt from; so are rows with a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


@dataclass(frozen=True)
class ToxicityModel:
    """A fitted classifier. weights belong to FEATURES and an intercept; stems are hashes of learnt word starts."""

    weights: tuple[float, ...]
    stems: tuple[int, ...] = ()

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, **options) -> ToxicityModel:
        """The model of fit_scores alone."""
        return ToxicityModel.fit_scores(docs, labels, **options)[0]

    @staticmethod
    def fit_scores(
        docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rounds: int = 6, sample: int = SAMPLE,
    ) -> tuple[ToxicityModel, DataFrame]:
        """Learns from the texts and votes of all docs and the labels of rows that aren't held out.

        Returns the model and (id_col, score) of every row of docs, from the features that were learnt from. Several
        labels of an id count as toxic if any does; null labels are unknown. Without any label the votes alone decide.
        Of the documents not held out about `sample` (by a hash of the id) train the linear classifier.
        """
        known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id"))
        known = known.agg(F.max(F.when(F.col(label_col) > 0, 1.0).otherwise(0.0)).alias("y"))
        given = docs.select(F.col(id_col).alias("id"), text_col)
        stems = learn_stems(given, known, text_col)
        schema = f"id {dict(docs.dtypes)[id_col]}, x array<float>"
        table = written(given.mapInArrow(partial(_features, stems=stems), schema), "features")
        names = [f"v{k}" for k in range(len(VOTERS))]
        votes = [F.col("x")[len(FEATURES) - len(VOTERS) + k].cast("int").alias(v) for k, v in enumerate(names)]
        patterns = table.join(known, "id", "left").select(*votes, "y").groupBy(*names, "y").agg(F.count("*").alias("n"))
        patterns = written(patterns, "votes").select(*names, "n", "y")
        model = None
        for _ in range(rounds + 1):
            rows = patterns.mapInArrow(partial(_moments, model=model), "sums array<double>").collect()
            sums = np.sum([r.sums for r in rows], axis=0) if rows else np.zeros(2 * (1 + 9 * len(VOTERS) ** 2))
            if model is None and not sums[len(sums) // 2]:
                sums += _guess()
            prior = model and model["prior"]  # known from the labels; unlabelled rows can't move it
            model = _model(sums)
            model["prior"] = model["prior"] if prior is None else prior
        n = max(1, table.count())
        share = min(1_000_000, max(1, int(1_000_000 * sample / n)))
        drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share
        chosen = table.where(~held_out("id") & drawn).join(known, "id", "left").select("x", "y").limit(2 * sample).collect()
        x = np.array([r.x for r in chosen], float).reshape(-1, len(FEATURES))
        y = np.array([r.y for r in chosen], float)
        p = posterior(x[:, len(FEATURES) - len(VOTERS) :].astype(int), model)
        known_y = ~np.isnan(y)
        if 0 < y[known_y].sum() < known_y.sum():
            # the tree leaves some dependence out, so its log odds are too sure: calibrated on the known labels
            logit = np.log(p / (1 - p))[:, None]
            scale, shift = _regression(logit[known_y], y[known_y])
            p = 1 / (1 + np.exp(-np.clip(scale * logit[:, 0] + shift, -30, 30)))
        p = np.where(known_y, y, p)
        model = ToxicityModel(tuple(_regression(x, p).tolist()), tuple(stems.tolist()))
        line = sum((F.col("x")[k] * w for k, w in enumerate(model.weights[:-1])), F.lit(model.weights[-1]))
        return model, table.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-line))).alias("score"))

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with score, the probability from 0 to 1 that a text is toxic; a column of that name is replaced.

        Null and empty texts score as texts without words. Equal texts score alike, whatever their other columns.
        """
        docs = docs.drop("score")
        given = {"weights": np.array(self.weights), "stems": np.array(self.stems, np.uint64)}
        return docs.mapInArrow(partial(_score, text=docs.columns.index(text_col), **given), _with_score(docs))


def _with_score(docs: DataFrame):
    from pyspark.sql.types import DoubleType, StructType

    return StructType(list(docs.schema)).add("score", DoubleType())
