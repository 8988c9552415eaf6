"""Packing of token sequences by minimum bin slack.

Every document becomes its token ids and one end id. Runs of ``capacity`` ids are cut off long documents; the
rest is a pool of remaining lengths. Each window is opened by the longest rest, and a subset-sum dynamic program on
bitsets (one Python integer holds which sums can be reached; lengths are added in powers of two of their count)
finds the multiset of other lengths that fills it closest to capacity. The chosen counts come from backtracking
through the bitsets. A gap that no multiset fills is closed by cutting one more piece. What is left at the end of a
partition is dealt into sequences whose lengths are powers of two, which need no padding.

Every partition packs its own rows as they stream through, holding ``window`` rests at most: no shuffle, no group.
Results depend on the input partitions alone, so a lost task gives the same rows again.

Null text is empty and holds only the end id. Null ids and repeated rows are packed like any other row. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import doc_columns

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Python splits at these, the tokenizer doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_ENCODERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a text as little-endian uint32 bytes.

    White space always ends a word of this tokenizer and yields no id, so a text's ids are its words' ids in order.
    A Latin word with signs behind it is split before them, as the tokenizer's own pattern does; any other word goes
    through the whole tokenizer. Words are remembered, up to ``most`` of them.
    """

    SIGNS = ".,;:!?%$&*#"

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.letters = _byte_letters()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        core = word.rstrip(self.SIGNS)
        if not (core.isalpha() and max(core) < "\u0250"):
            return self._whole(word)
        tail, core = word[len(core) :], unicodedata.normalize("NFC", core).lower()
        if not core.isalpha():  # a capital whose small form is a letter and a sign
            return self._whole(word)
        if (ids := self.known.get(core)) is None:
            spelt = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            self.known[core] = ids = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
        if tail and (more := self.known.get(tail)) is None:
            self.known[tail] = more = self._whole(tail)
        return ids + more if tail else ids

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            if _ODD_SPACE.search(text):
                yield self._whole(text)
                continue
            if len(self.known) > self.most:
                self.known.clear()
            words, known = text.split(), self.known
            try:
                yield b"".join([known[w] for w in words])
            except KeyError:
                for w in set(words).difference(known):
                    known[w] = self._word(w)
                yield b"".join([known[w] for w in words])


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def fill(counts: Counter, room: int) -> dict[int, int]:
    """Lengths with counts whose sum is the largest that is at most ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left, part = left - part, part * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, Counter()
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += part
            total -= length * part
    return dict(taken)


class Packer:
    """Streams (doc_id, ids) in and pieces out; ``first`` is the first sequence id."""

    def __init__(self, capacity: int, window: int, first: int):
        self.capacity, self.window, self.sequence = capacity, window, first
        self.pool: dict[int, deque] = {}
        self.counts: Counter = Counter()
        self.n = 0

    def _put(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        self.pool.setdefault(length, deque()).append(piece)
        self.counts[length] += 1
        self.n += 1

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].popleft()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length], self.pool[length]
        self.n -= 1
        return piece

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset, ids
            offset += n
        self.sequence += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, size, at = len(ids) // 4, 4 * self.capacity, 0
        while len(ids) - at >= size:
            yield from self._sequence([(doc_id, at // 4, ids[at : at + size], total)])
            at += size
        if at < len(ids):
            self._put((doc_id, at // 4, ids[at:], total))
        while self.n > self.window:
            yield from self._one()

    def _cut(self, room: int) -> tuple:
        doc_id, start, ids, total = self._take(max(self.counts))
        if len(ids) > 4 * room:
            self._put((doc_id, start + room, ids[4 * room :], total))
        return doc_id, start, ids[: 4 * room], total

    def _one(self) -> Iterator[tuple]:
        pieces = [self._take(max(self.counts))]
        room = self.capacity - len(pieces[0][2]) // 4
        for length, n in fill(self.counts, room).items():
            pieces += [self._take(length) for _ in range(n)]
            room -= n * length
        while room and self.n:
            pieces.append(self._cut(room))
            room -= len(pieces[-1][2]) // 4
        yield from self._sequence(pieces)

    def end(self) -> Iterator[tuple]:
        left = sum(length * n for length, n in self.counts.items())
        while left >= self.capacity:
            yield from self._one()
            left -= self.capacity
        while left:
            size = 1 << (left.bit_length() - 1)
            pieces, room = [], size
            while room:
                pieces.append(self._cut(room))
                room -= len(pieces[-1][2]) // 4
            yield from self._sequence(pieces)
            left -= size


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 2, tokenizer: str | None = None, window: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of ``SCHEMA``; ``with_ids`` adds the ids themselves as an array."""
    path, end = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:7]]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if with_ids:
            import numpy as np

            columns.append(pa.array([np.frombuffer(r[7], "<i4") for r in rows], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode, rows = Packer(capacity, window, TaskContext.get().partitionId() << 36), encoder(path), []
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            texts = (x.as_py() or "" for x in b.column("text"))
            for doc_id, tokens in zip(ids, encode.encode(texts)):
                rows += packer.add(doc_id, tokens + end)
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        rows += packer.end()
        for i in range(0, len(rows), 4096):
            yield batch(rows[i : i + 4096])

    return doc_columns(docs).mapInArrow(run, schema)
