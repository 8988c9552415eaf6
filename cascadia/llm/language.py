r"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window, each filter's maximum over the window is kept, and a softmax
gives the language. Training is numpy on the driver: Adam on windows that executors cut from a bounded sample of labelled documents. A whole
text is read in fixed-length windows, in batches; its log probabilities are averaged over its windows by their bytes. As the
first layer is linear in the bytes, prediction reads each filter's response to two bytes at a time from tables
of all byte pairs, which gives the same sums.

Null texts and texts without a letter (``\p{L}``) are ``und`` with score 1. Null languages are not learned from; where no language can be
learned, every text is ``und``. Rows whose id is null are predicted with ``held_out`` null and not learned from. Repeated rows
get equal results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .common import doc_columns, fold, hash_share

LETTER = regex.compile(r"\p{L}")
WIDTHS, FILTERS, EMBEDDING, WINDOW = (2, 4, 6), 12, 8, 512
#: Windows of a document that are learnt from, and their bytes.
SHOWN, SHOWN_BYTES = 8, 160


def shown(text: bytes, seed: int) -> list[bytes]:
    """Windows of a text: all of it, or ``SHOWN`` places drawn by the seed."""
    if len(text) <= SHOWN_BYTES:
        return [text]
    at = np.random.default_rng(seed).integers(0, len(text) - SHOWN_BYTES + 1, SHOWN)
    return [text[i : i + SHOWN_BYTES] for i in at.tolist()]


def training_sample(docs: DataFrame, per_language: int, most: int = 120_000) -> list[tuple[list[bytes], str]]:
    """(windows, lang) of at most ``per_language`` documents of each language, those with the smallest hash of their id; of rows with the same id and language the smallest text.

    Where there are so many languages that this would be over ``most`` documents, each has an equal share of those, and one at least.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = rows.where((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).persist()
    wanted = min(per_language, max(1, most // max(1, counts.count())))
    place = F.xxhash64("doc_id", F.lit(2))
    near = usable.join(counts, "lang").where(hash_share(place, F.col("n"), wanted)).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    ranked = near.withColumn("place", place).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            windows = [shown(text.encode(), place & 0x7FFFFFFF) for text, place in zip(b.column("text").to_pylist(), b.column("place").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rank"), pa.array(windows, pa.list_(pa.binary()))], ["lang", "rank", "windows"])

    drawn = ranked.where(F.col("rank") <= wanted).mapInArrow(cut, "lang string, rank int, windows array<binary>").collect()
    counts.unpersist()
    return [([bytes(w) for w in r["windows"]], r["lang"]) for r in sorted(drawn, key=lambda r: (r["lang"], r["rank"]))]


class ByteConvNet:
    """Parameters and both passes; windows are padded with byte 0, which never counts towards a maximum beyond a text's end."""

    def __init__(self, classes: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(classes))), "b": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)

    @staticmethod
    def _mask(lengths: np.ndarray, n: int, w: int) -> np.ndarray:
        return np.arange(n) < np.maximum(lengths - w + 1, 1)[:, None]

    def step(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss and gradients."""
        n, p, grads = len(x), self.p, {}
        e = p["e"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            positions = x.shape[1] - w + 1
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, positions, w * EMBEDDING)
            z = cols @ p[f"w{w}"] + p[f"c{w}"]
            z[~self._mask(lengths, positions, w)] = -np.inf
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            kept.append((at, top > 0, cols))
        h = np.concatenate(pooled, 1)
        logits = h @ p["out"] + p["b"]
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(1, keepdims=True)
        loss = -np.log(q[np.arange(n), y] + 1e-12).mean()
        q[np.arange(n), y] -= 1
        q /= n
        grads["out"], grads["b"] = h.T @ q, q.sum(0)
        dh, de = q @ p["out"].T, np.zeros_like(p["e"])
        for k, w in enumerate(WIDTHS):
            at, on, cols = kept[k]
            d = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            picked = cols[np.arange(n)[:, None], at]  # n, filters, w * embedding
            grads[f"w{w}"] = np.einsum("nfd,nf->df", picked, d)
            grads[f"c{w}"] = d.sum(0)
            back = np.einsum("nf,df->nfd", d, p[f"w{w}"]).reshape(n, FILTERS, w, EMBEDDING)
            where = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(de, where.ravel(), back.reshape(-1, EMBEDDING))
        grads["e"] = de
        return loss, grads

    def fit(self, sample: list[tuple[list[bytes], str]], steps: int = 400, batch: int = 64, window: int = SHOWN_BYTES, seed: int = 4) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        own: dict[str, list] = {c: [] for c in self.classes}
        for windows, lang in sample:
            own[lang].append([np.frombuffer(w, np.uint8) for w in windows])
        by_class = [own[c] for c in self.classes]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            y = rng.integers(len(self.classes), size=batch)
            x, lengths = np.zeros((batch, window), np.uint8), np.zeros(batch, np.int64)
            for i, c in enumerate(y):
                document = by_class[c][rng.integers(len(by_class[c]))]
                text = document[rng.integers(len(document))]
                n = min(len(text), int(rng.choice([6, 12, 24, 48, 96, window])))
                at = rng.integers(len(text) - n + 1)
                x[i, :n], lengths[i] = text[at : at + n], n
            _, grads = self.step(x, lengths, y)
            rate = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, the filters' response to every byte pair at each even offset."""
        out = []
        for w in WIDTHS:
            single = [self.p["e"] @ self.p[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            pairs = [(single[j][:, None] + single[j + 1][None, :]).reshape(65536, FILTERS) for j in range(0, w, 2)]
            pairs[0] = pairs[0] + self.p[f"c{w}"]
            out.append([x.astype(np.float32) for x in pairs])
        return out

    def log_probs(self, text: np.ndarray, tables: list[list[np.ndarray]], window: int = WINDOW, batch: int = 16) -> np.ndarray:
        """Mean log probabilities over the windows of one text, weighted by their bytes."""
        total = np.zeros(len(self.classes))
        size = max(1, len(text))
        for first in range(0, size, window * batch):
            part = text[first : first + window * batch]
            rows = max(1, -(-len(part) // window))
            x = np.zeros(rows * window if rows > 1 else max(len(part), WIDTHS[-1]), np.uint8)
            x[: len(part)] = part
            x = x.reshape(rows, -1)
            lengths = np.full(rows, x.shape[1])
            lengths[-1] = len(part) - (rows - 1) * window
            pairs = x[:, :-1].astype(np.intp) << 8 | x[:, 1:]
            pooled = []
            for w, parts in zip(WIDTHS, tables):
                positions = x.shape[1] - w + 1
                z = parts[0].take(pairs[:, :positions], 0, mode="clip")
                for j, more in enumerate(parts[1:], 1):
                    z += more.take(pairs[:, 2 * j : 2 * j + positions], 0, mode="clip")
                z[-1, max(int(lengths[-1]) - w + 1, 1) :] = -np.inf
                while (n := z.shape[1]) > 1:  # halving keeps every pass contiguous
                    half = (n + 1) // 2
                    z = np.maximum(z[:, :half], z[:, n - half :])
                pooled.append(np.maximum(z[:, 0], 0))
            logits = np.concatenate(pooled, 1) @ self.p["out"] + self.p["b"]
            logits -= logits.max(1, keepdims=True)
            total += (lengths / size) @ (logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return total


class Identifier:
    """Languages of texts; ``net`` is None where there are fewer than two languages to tell apart."""

    def __init__(self, classes: list[str], net: ByteConvNet | None):
        self.classes, self.net, self.tables = classes, net, net.pair_tables() if net else None

    def identify(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.classes or not LETTER.search(text):
            return "und", 1.0
        if self.net is None:
            return self.classes[0], 1.0
        logp = self.net.log_probs(np.frombuffer(text.encode(), np.uint8), self.tables)
        q = np.exp(logp - logp.max())
        k = int(q.argmax())
        return self.classes[k], float(q[k] / q.sum())


def learn(docs: DataFrame, per_language: int = 600, steps: int = 400) -> tuple[list[str], ByteConvNet | None]:
    """A model from ``per_language`` documents of each language at most."""
    sample = training_sample(docs, per_language)
    classes = sorted({lang for _, lang in sample})
    return classes, ByteConvNet(classes).fit(sample, steps) if len(classes) > 1 else None


def identify(docs: DataFrame, model: tuple[list[str], ByteConvNet | None] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the predicted language's share)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(*shared.value)
        for b in batches:
            found = [identifier.identify(x.as_py()) for x in b.column("text")]
            columns = [b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    found = doc_columns(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows, with all their columns, whose language is found with ``least_score`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(*shared.value)
        for b in batches:
            found = (identifier.identify(x.as_py()) for x in b.column("text"))
            yield b.filter(pa.array([lang != "und" and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
