"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded by what it holds and how it looks: the mean of its words' embeddings, which are
learnt with the rest (``WORDS`` hashed rows; those of words that were never learnt from stay 0), shares of 64 hashed word shapes, and shares of
repeated, upper-case, mixed and sign-bearing words, of word lengths and of letters. A hidden layer turns an
encoding into a vector h; gated attention, softmax(u . (tanh(V h) * sigmoid(U h))), weighs the passages; the weighted sum
is scored by a logistic unit. Only document labels are used. Training is Adam in numpy on the driver, over a bounded sample that
executors encode: ``most_passages`` passages of a document at most, drawn by its id, so its bytes are bounded too. Scores read all passages.

Null and empty texts are one passage with an empty encoding. Rows whose id is null are scored with ``held_out`` null. Repeated
rows get equal results. With no labelled row of one class the score is that class's smoothed share. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import doc_columns, fold
from .text import bare, labelled_rows, sigmoid

PASSAGE, SHAPES = 64, 64
WIDTH = SHAPES + 8
HIDDEN, GATE = 24, 12
WORDS, EMBEDDING = 8192, 12
#: Encoded passages: their numbers, the embedding row of every word, and how many words each has.
Bag = tuple[np.ndarray, np.ndarray, np.ndarray]


class _Classes(dict):
    """Letters as a or A, digits as 0, other signs as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = s = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        return s


_CLASSES, _RUN = _Classes(), re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """The token's classes; runs count once."""
    return _RUN.sub(r"\1", token.translate(_CLASSES))


class PassageEncoder:
    def __init__(self, most: int = 200_000):
        self.most, self.known, self.rows, self.table = most, {}, [], None

    def _learn(self, token: str) -> int:
        classes = token.translate(_CLASSES)
        letters = classes.count("a") + classes.count("A")
        self.rows.append((zlib.crc32(_RUN.sub(r"\1", classes).encode()) % SHAPES, token.isupper() and letters > 1, 0 < letters < len(token), letters == 0, min(len(token), 32) / 16, letters / max(1, len(token)), zlib.crc32((bare(token) or token).encode()) % WORDS))
        self.known[token] = at = len(self.rows) - 1
        return at

    def encode(self, text: str | None) -> Bag:
        """One row of WIDTH numbers for each passage, and its words; a passage without words has one that means nothing."""
        if len(self.known) > self.most:
            self.known, self.rows, self.table = {}, [], None
        tokens = (text or "").split()
        if not tokens:
            return np.zeros((1, WIDTH), np.float32), np.array([WORDS]), np.ones(1, np.int64)
        known, learn = self.known, self._learn
        had = len(self.rows)
        ids = np.array([i if (i := known.get(t)) is not None else learn(t) for t in tokens])
        if len(self.rows) > had or not had:
            self.table = self._grown(np.array(self.rows[had:], np.float32), had)
        info = self.table[ids]
        n = len(ids)
        passage = np.arange(n) // PASSAGE
        size = np.bincount(passage)
        k = len(size)
        out = np.zeros((k, WIDTH), np.float32)
        out[:, :SHAPES] = np.bincount(passage * SHAPES + info[:, 0].astype(np.int64), minlength=k * SHAPES).reshape(k, SHAPES) / size[:, None]
        for j in range(1, 6):
            out[:, SHAPES + j - 1] = np.bincount(passage, info[:, j]) / size
        keys = np.sort(passage << 32 | ids)
        distinct = keys[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])] >> 32
        out[:, SHAPES + 5] = 1 - np.bincount(distinct, minlength=k) / size
        again = np.zeros(n)
        again[1:] = ids[1:] == ids[:-1]
        out[:, SHAPES + 6] = np.bincount(passage, again) / size
        out[:, SHAPES + 7] = np.minimum(size, PASSAGE) / PASSAGE
        return out, info[:, 6].astype(np.int64), size

    def _grown(self, fresh: np.ndarray, had: int) -> np.ndarray:
        """The table with room to spare, so that adding rows costs little."""
        need = had + len(fresh)
        table = self.table
        if table is None or len(table) < need:
            bigger = np.zeros((max(8192, 2 * need), 7), np.float32)
            if table is not None:
                bigger[:had] = table[:had]
            table = bigger
        table[had:need] = fresh
        return table


class AttentionNet:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {"e": np.zeros((WORDS + 1, EMBEDDING)), "w": rng.normal(0, WIDTH**-0.5, (WIDTH + EMBEDDING, HIDDEN)), "wb": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "g": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "cb": np.zeros(1)}

    def forward(self, bags: list[Bag]) -> tuple:
        """Scores of the bags, and what the backward pass needs."""
        p = self.p
        x, words, sizes = (np.concatenate(part) for part in zip(*bags))
        starts = np.cumsum([0, *(len(b[0]) for b in bags[:-1])])
        meaning = np.add.reduceat(p["e"][words], np.cumsum(sizes) - sizes) / sizes[:, None]
        x = np.concatenate([(x - self.mean) / self.scale, meaning], 1)
        h = np.tanh(x @ p["w"] + p["wb"])
        tv, sg = np.tanh(h @ p["v"]), sigmoid(h @ p["g"])
        e = (tv * sg) @ p["u"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return sigmoid(z @ p["c"] + p["cb"][0]), (x, words, sizes, starts, h, tv, sg, a, bag, z)

    def gradients(self, bags: list[Bag], y: np.ndarray, decay: float) -> dict:
        p, (q, (x, words, sizes, starts, h, tv, sg, a, bag, z)) = self.p, self.forward(bags)
        r = (q - y) / len(y)
        dz = r[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        dw = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, ds = dw[:, None] * p["u"] * sg * (1 - tv * tv), dw[:, None] * p["u"] * tv * sg * (1 - sg)
        dh = (dh + dt @ p["v"].T + ds @ p["g"].T) * (1 - h * h)
        dm = (dh @ p["w"][WIDTH:].T / sizes[:, None])[np.repeat(np.arange(len(sizes)), sizes)]
        de = np.stack([np.bincount(words, d, WORDS + 1) for d in dm.T], 1)
        de[WORDS] = 0
        grads = {"e": de, "w": x.T @ dh, "wb": dh.sum(0), "v": h.T @ dt, "g": h.T @ ds, "u": (tv * sg).T @ dw, "c": z.T @ r, "cb": np.array([r.sum()])}
        return {k: g + decay * p[k] for k, g in grads.items()}


def fit(sample: list[tuple[Bag, int]], epochs: int = 15, batch: int = 64, decay: float = 1e-4, seed: int = 12) -> AttentionNet | float:
    """The trained net, or the smoothed share of label 1 where only one label is known."""
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    bags = [bag for bag, _ in sample]
    every = np.concatenate([x for x, _, _ in bags])
    net = AttentionNet(every.mean(0), every.std(0) + 0.05)
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    t, steps = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(bags), batch):
            t += 1
            at = order[i : i + batch]
            for k, g in net.gradients([bags[j] for j in at], y[at], decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = net.p[k] - 0.01 * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def drawn(bag: Bag, most: int, seed: int) -> Bag:
    """``most`` of the bag's passages at most, in order."""
    x, words, sizes = bag
    if len(x) <= most:
        return bag
    at = np.sort(np.random.default_rng(seed).choice(len(x), most, replace=False))
    return x[at], words[np.isin(np.repeat(np.arange(len(x)), sizes), at)], sizes[at]


def learn(docs: DataFrame, labels: DataFrame, most: int = 3000, most_passages: int = 64) -> AttentionNet | float:
    """A net from ``most`` labelled rows at most."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PassageEncoder()
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                b = whole.slice(first, 128)
                bags = [drawn(encoder.encode(x.as_py()), most_passages, zlib.crc32(str(i).encode())) for i, x in zip(b.column("doc_id"), b.column("text"))]
                parts = [pa.array([part.astype(kind).tobytes() for part in own], pa.binary()) for own, kind in zip(zip(*bags), ("<f4", "<i2", "<i2"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *parts], ["doc_id", "y", "x", "words", "sizes"])

    rows = labelled_rows(docs, labels, "quality", 3, 1, most).mapInArrow(encode, "doc_id long, y int, x binary, words binary, sizes binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"]))
    return fit([((np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH), np.frombuffer(r["words"], "<i2").astype(np.int64), np.frombuffer(r["sizes"], "<i2").astype(np.int64)), r["y"]) for r in rows])


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 3000, threshold: float = 0.5, model: AttentionNet | float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from ``most`` labelled rows at most."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, most) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, encoder = model.value, PassageEncoder()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                if isinstance(net, float):
                    scores = np.full(b.num_rows, net)
                else:
                    scores = net.forward([encoder.encode(x.as_py()) for x in b.column("text")])[0]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = doc_columns(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
