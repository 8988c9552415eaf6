"""Encoding and decoding by pieces with log scores: unigram Viterbi over a double-array trie.

A text is written with a whitespace marker for every space and one marker in front. Viterbi finds the pieces with
the largest sum of scores; among equal sums the one whose last piece is longest wins, at every position. A character that no
piece covers costs ``PENALTY`` less than the lowest score and is written as its UTF-8 bytes. A literal marker character in a text is
written as bytes too, so decoding gives back every text exactly.

No piece has a marker behind another sign, so no piece crosses from one marked word into the next and a text's best
pieces are those of its words in order. Words are remembered; new ones are searched together, all in lockstep.

Null and empty texts have no pieces. Null ids and repeated rows are encoded like any other row. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns

MARK = "▁"
PENALTY = 10.0
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Stands for a literal marker while a text is cut into words; it can't be in UTF-8.
_LITERAL = "\udc00"
_CODERS: dict = {}


class DoubleArray:
    """Trie over bytes in two arrays: a child of state s by byte b is base[s] + b + 1, if check of it is s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys:
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][b]
            ends[at] = value
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        taken = bytearray(size)
        taken[0] = 1
        place, starts = {0: 0}, {}
        for node, kids in enumerate(children):  # parents come before their children
            state = place.pop(node)
            self.value[state] = ends[node]
            if not kids:
                continue
            codes = sorted(b + 1 for b in kids)
            kind = min(len(codes), 8)
            at = starts.get(kind, 1)  # where the last node with as many children found room
            while any(taken[at + c] for c in codes):
                at += 1
                if at + 257 >= len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    self.base, self.check, self.value = (np.concatenate([a, np.full(more, f, np.int64)]) for a, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
            starts[kind] = at
            self.base[state] = at
            for b, child in kids.items():
                taken[at + b + 1] = 1
                self.check[at + b + 1] = state
                place[child] = at + b + 1

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        to = np.minimum(self.base[states] + codes + 1, len(self.check) - 1)
        return np.where(self.check[to] == states, to, -1)


class PieceCoder:
    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.byte_ids = np.zeros(256, np.int64)
        self.text_of: list[bytes] = [b""] * n
        keys = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} crosses words")
                keys.append((piece.encode(), i))
                self.text_of[i] = piece.replace(MARK, " ").encode()
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.unknown = self.scores[[i for _, i in keys]].min() - PENALTY
        self.trie, self.longest = DoubleArray(keys), max(len(k) for k, _ in keys)
        self.most, self.known = most, {}

    def search(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word's best pieces."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):  # words of like length together, in a bounded table
            upper = max(16, 2 * len(raw[order[at]]))
            end = at
            while end < len(order) and len(raw[order[end]]) <= upper and (end - at) * (upper + 1) < 4_000_000:
                end += 1
            end = max(end, at + 1)
            for i, ids in zip(order[at:end], self._lockstep([raw[i] for i in order[at:end]])):
                out[i] = ids
            at = end
        return out

    def _lockstep(self, raw: list[bytes]) -> list[np.ndarray]:
        n, width = len(raw), max(map(len, raw))
        lengths = np.array([len(r) for r in raw])
        x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width).T.astype(np.int64).copy()
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back, via = np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int64)
        for start in range(width):
            rows = np.flatnonzero((lengths > start) & (best[start] > -np.inf))
            lead = x[start, rows]
            size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            whole, state, here = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), np.arange(len(rows))
            for depth in range(1, min(self.longest, width - start) + 1):
                state = self.trie.step(state, x[start + depth - 1, rows[here]])
                ok = (state >= 0) & (start + depth <= lengths[rows[here]])
                state, here = state[ok], here[ok]
                if not len(here):
                    break
                value = self.trie.value[state]
                hit = np.flatnonzero(value >= 0)
                if len(hit):
                    r, v = rows[here[hit]], value[hit]
                    whole[here[hit[size[here[hit]] == depth]]] = True
                    score = best[start, r] + self.scores[v]
                    better = score > best[start + depth, r]
                    r, v = r[better], v[better]
                    best[start + depth, r], back[start + depth, r], via[start + depth, r] = score[better], start, v
            r = rows[~whole]
            to = start + size[~whole]
            score = best[start, r] + self.unknown
            better = score > best[to, r]
            best[to[better], r[better]], back[to[better], r[better]], via[to[better], r[better]] = score[better], start, -1
        out = []
        for i in range(n):
            at, ids = len(raw[i]), []
            while at:
                start, v = int(back[at, i]), int(via[at, i])
                if v >= 0:
                    ids.append(v)
                else:
                    char = raw[i][start:at]
                    char = MARK.encode() if char == b"\xed\xb0\x80" else char
                    ids += [int(self.byte_ids[b]) for b in reversed(char)]
                at = start
            out.append(np.array(ids[::-1], "<u4"))
        return out

    def words(self, text: str) -> list[str]:
        return _WORD.findall(MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)) if text else []

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text; texts are searched some hundred at a time."""
        held: list[list[str]] = []

        def flush() -> Iterator[np.ndarray]:
            if len(self.known) > self.most:
                self.known.clear()
            known = self.known
            if missing := list({w for words in held for w in words if w not in known}):
                known.update((w, ids.tobytes()) for w, ids in zip(missing, self.search(missing)))
            for words in held:
                yield np.frombuffer(b"".join([known[w] for w in words]), "<u4")
            held.clear()

        n = 0
        for text in texts:
            held.append(self.words(text))
            n += len(held[-1])
            if n > 100_000:
                yield from flush()
                n = 0
        yield from flush()

    def decode(self, ids: np.ndarray) -> str:
        table = self.text_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array), n_pieces, n_byte_pieces, ids_crc32 (little-endian unsigned 32-bit ids), round_trip: decoding gives the text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                texts = [x.as_py() or "" for x in b.column("text")]
                ids = list(c.encode(texts))
                columns = [
                    b.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([int(c.is_byte[i].sum()) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                    pa.array([c.decode(i) == t for i, t in zip(ids, texts)]),
                ]
                names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return doc_columns(docs).mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids); null ids give null text, unknown ids raise."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            texts = [None if i.as_py() is None else c.decode(np.array(i.as_py(), np.int64)) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame) -> DataFrame:
    return encode_pieces(docs, with_ids=False)
