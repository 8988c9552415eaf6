"""Toxicity: a sparse logistic classifier with a counterfactual penalty.

A document's features are the distinct words it holds and the first 4 to 7 letters of each, so that a word family
counts like a word. The model is fitted on the driver over a bounded sample of labelled rows by accelerated
proximal gradients: mean log loss, an L1 term that leaves few weights, and a counterfactual term. For the
latter each labelled sentence that names a group has its identity term (one word) swapped for each other one, of any language and number, and the mean squared
change of the score's logit is penalised; neutral mentions of one group then score like those of any other. Without such a
sentence the term is nothing; the number of swaps is logged.

All features and swaps of a sampled text count. Executors find them, ``MOST_FEATURES`` features a row and equal swaps once with their number; they count the rows
that hold a feature, and the driver gets the names of those that enough rows hold, and each text as numbers of names. Scores read whole texts.

Null and empty texts have no features and get the intercept's score. Rows whose id is null are scored with
``held_out`` null. Repeated rows get equal results. With no labelled row of one class the score is that class's
smoothed share. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import logging
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, doc_columns, fold
from .text import EDGE, bare, labelled_rows, sigmoid

IDENTITY_TERMS = (
    "women men muslims christians jews hindus buddhists atheists catholics gays lesbians immigrants foreigners refugees asians africans europeans americans "
    "woman man muslim christian jew jewish hindu buddhist atheist catholic gay lesbian immigrant foreigner refugee asian african european american black white disabled elderly transgender "
    "frauen männer muslime christen juden einwanderer ausländer femmes hommes musulmans chrétiens juifs immigrés étrangers mujeres hombres musulmanes cristianos judíos inmigrantes extranjeros"
).split()
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = range(4, 8)
THRESHOLD = 0.3
MOST_FEATURES, MOST_SWAPS = 1024, 24
#: The least share of rows, and number of them, that hold a feature with a weight.
LEAST_SHARE, LEAST_ROWS = 0.002, 3
#: What is learnt from one text: its features, and the (gained, lost) features of its swaps.
Example = tuple[list[str], list[tuple[list[str], list[str]]]]


def word_features(token: str) -> list[str]:
    word = bare(token)
    if not word or not word[0].isalpha():
        return []
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def features(text: str) -> set[str]:
    return {f for token in set(text.split()) for f in word_features(token)}


def counterfactuals(text: str, terms: list[str], rng: np.random.Generator, swaps: int = 3) -> Iterator[tuple[str, str]]:
    """(sentence, the sentence with its identity term swapped for another)."""
    known = set(terms)
    for sentence in SENTENCE.findall(text):
        tokens = sentence.split()
        at = [i for i, t in enumerate(tokens) if bare(t) in known]
        for i in at:
            own = bare(tokens[i])
            for other in rng.choice([t for t in terms if t != own], min(swaps, len(terms) - 1), replace=False):
                yield sentence, " ".join([*tokens[:i], str(other), *tokens[i + 1 :]])


def swapped(text: str, terms: list[str]) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
    """The (gained, lost) features of a sentence, for each identity term in it and each other one in its place."""
    low = text.lower()
    if not any(t in low for t in terms):
        return
    forms = {t: sorted(word_features(t)) for t in terms}
    for sentence in SENTENCE.findall(text):
        tokens = sentence.split()
        at = [i for i, t in enumerate(tokens) if bare(t) in forms]
        if not at:
            continue
        uses = Counter(f for t in tokens for f in word_features(t))
        for i in at:
            alone = [f for f in sorted(word_features(tokens[i])) if uses[f] == 1]
            for other, new in forms.items():
                if other != bare(tokens[i]):
                    yield tuple(f for f in new if f not in uses), tuple(f for f in alone if f not in new)


def parts(found: set[str]) -> Iterator[list[str]]:
    """All features, ``MOST_FEATURES`` at once; one empty part if there are none."""
    own = sorted(found, key=lambda f: (zlib.crc32(f.encode()), f))
    for i in range(0, max(len(own), 1), MOST_FEATURES):
        yield sorted(own[i : i + MOST_FEATURES])


def example(text: str, terms: list[str] = IDENTITY_TERMS, seed: int = 5) -> Example:
    """A text's first part and a few random swaps, to look at or to fit by hand; ``learn`` takes all of them."""
    swaps = []
    for a, b in counterfactuals(text, list(terms), np.random.default_rng(seed)):
        a, b = features(a), features(b)
        swaps.append((sorted(b - a), sorted(a - b)))
        if len(swaps) == MOST_SWAPS:
            break
    return next(parts(features(text))), swaps


def _flat(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of all rows in a row, and the row of each."""
    return np.concatenate([*own, np.zeros(0, np.int32)]), np.repeat(np.arange(len(own)), [len(x) for x in own])


def _rows(sets: list[list[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    return _flat([np.array(sorted(index[f] for f in s if f in index), np.int32) for s in sets])


def _least(rows: int, share: float = LEAST_SHARE) -> int:
    return max(LEAST_ROWS, round(share * rows))


def _prior(toxic: int, rows: int) -> float:
    share = (toxic + 1) / (rows + 2)
    return math.log(share / (1 - share))


def fit(sample: list[tuple[Example, int]], least_share: float = LEAST_SHARE, l1: float = 3e-4, fairness: float = 1.0, rounds: int = 250) -> tuple[dict[str, float], float]:
    """(weights of features, intercept)."""
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        return {}, _prior(y.sum(), len(y))
    least_docs = _least(len(sample), least_share)
    sets = [own for (own, _), _ in sample]
    found = Counter(f for s in sets for f in s)
    swaps = [(*swap, 1) for (_, own), _ in sample for swap in own]
    found.update({f: least_docs for gained, lost, _ in swaps for f in (*gained, *lost)})
    names = sorted(f for f, n in found.items() if n >= least_docs)
    del found
    return solve(names, y, *_rows(sets, {f: i for i, f in enumerate(names)}), swaps, l1, fairness, rounds)


def solve(
    names: list[str], y: np.ndarray, ids: np.ndarray, row: np.ndarray, swaps: list[tuple[list[str], list[str], int]], l1: float = 3e-4, fairness: float = 1.0, rounds: int = 250
) -> tuple[dict[str, float], float]:
    """(weights of features, intercept) from the rows' feature numbers, and (gained, lost, number) of each swap."""
    index = {f: i for i, f in enumerate(names)}
    gained, g_row = _rows([a for a, _, _ in swaps], index)
    lost, l_row = _rows([b for _, b, _ in swaps], index)
    del index
    times = np.array([n for _, _, n in swaps], float)
    logging.getLogger(__name__).info("counterfactual penalty over %d swaps in %d rows", int(times.sum()), len(y))
    times /= max(times.sum(), 1)
    n, m, k = len(y), len(swaps), len(names)
    w, b = np.zeros(k), math.log(y.mean() / (1 - y.mean()))
    v, vb, t, old, old_b = w.copy(), b, 1.0, w.copy(), b
    # the curvature along any direction is at most the largest row and column sums allow; backtracking finds a longer step
    step = 4.0

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = np.bincount(row, w[ids], n) + b
        p = sigmoid(z)
        value = np.mean(np.logaddexp(0, z) - y * z)
        r = (p - y) / n
        grad = np.bincount(ids, r[row], k)
        if m:
            d = np.bincount(g_row, w[gained], m) - np.bincount(l_row, w[lost], m)
            value += fairness * (times @ (d * d))
            e = 2 * fairness * times * d
            grad += np.bincount(gained, e[g_row], k) - np.bincount(lost, e[l_row], k)
        return value, grad, r.sum()

    for _ in range(rounds):
        value, grad, grad_b = loss(v, vb)
        while True:
            w = v - step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            b = vb - step * grad_b
            dw, db = w - v, b - vb
            if loss(w, b)[0] <= value + grad @ dw + grad_b * db + (dw @ dw + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = w + (t - 1) / t_new * (w - old), b + (t - 1) / t_new * (b - old_b)
        if np.abs(w - old).max(initial=0) < 1e-5 and abs(b - old_b) < 1e-5:
            break
        old, old_b, t = w, b, t_new
    return {names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(b)


class Scorer:
    def __init__(self, weights: dict[str, float], intercept: float, most: int = 200_000):
        self.weights, self.intercept, self.most, self.known = weights, intercept, most, {}

    def score(self, text: str | None) -> float:
        known = self.known
        if len(known) > self.most:
            known.clear()
        active: set[str] = set()
        for token in set((text or "").split()):
            hit = known.get(token)
            if hit is None:
                hit = known[token] = tuple(f for f in word_features(token) if f in self.weights)
            if hit:
                active.update(hit)
        return float(sigmoid(np.array(self.intercept + math.fsum(self.weights[f] for f in active))))


def learn(docs: DataFrame, labels: DataFrame, most: int = 4000, terms: list[str] = IDENTITY_TERMS) -> tuple[dict[str, float], float]:
    """A model from ``most`` labelled rows at most, all features and swaps of each."""
    terms = list(terms)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "y", "part", "features", "gained", "lost", "times"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                b, out, times = whole.slice(first, 128), [], Counter()
                for doc_id, y, text in zip(*(b.column(c) for c in ("doc_id", "y", "text"))):
                    # no feature holds white space
                    out += [(doc_id.as_py(), y.as_py(), k, " ".join(own), None, None, None) for k, own in enumerate(parts(features(text.as_py())))]
                    times.update(swapped(text.as_py(), terms))
                out += [(None, None, None, None, " ".join(a), " ".join(b), n) for (a, b), n in times.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    rows = labelled_rows(docs, labels, "toxic", 4, 2, most)
    sample = checkpointed(rows.mapInArrow(encode, "doc_id long, y int, part int, features string, gained string, lost string, times long"))
    classes = {r["y"]: r["count"] for r in sample.where("part = 0").groupBy("y").count().collect()}
    n = sum(classes.values())
    if len(classes) < 2:
        return {}, _prior(classes.get(1, 0), n)
    texts = sample.where("part is not null")
    swaps = sorted((r["gained"].split(), r["lost"].split(), r["times"]) for r in sample.where("part is null").groupBy("gained", "lost").agg(F.sum("times").alias("times")).collect())
    frequent = texts.select(F.explode(F.split("features", " ")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("name").alias("n")).where(F.col("n") >= _least(n))
    names = sorted({r["name"] for r in frequent.collect()} | {f for a, b, _ in swaps for f in (*a, *b)})
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {f: i for i, f in enumerate(shared.value)}
        for b in batches:
            own = [np.array(sorted(index[f] for f in x.as_py().split(" ") if f in index), np.int32) for x in b.column("features")]
            packed = [zlib.compress(np.diff(x, prepend=0).astype("<i4").tobytes(), 1) for x in own]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "ids"])

    def ids_of(packed: bytes) -> np.ndarray:
        return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i4"), dtype=np.int32)

    found = texts.mapInArrow(number, "doc_id long, y int, ids binary").collect()
    place = lambda r: (r["doc_id"], r["y"])
    y, own = [], []
    for (_, label), same in itertools.groupby(sorted(found, key=place), place):
        y.append(label)
        own.append(np.sort(np.concatenate([ids_of(r["ids"]) for r in same])))
    return solve(names, np.array(y, float), *_flat(own), swaps)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            scores = [scorer.score(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = doc_columns(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(x.as_py()) < threshold for x in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
