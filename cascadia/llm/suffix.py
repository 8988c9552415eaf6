"""Removal of repeated byte strings with run-length indexes.

A byte goes if it lies in a ``SPAN``-byte string that also starts in a document with a smaller doc_id. Equal strings hold the same smallest
hashed ``GRAM``-byte piece (their minimizer), so neighbouring strings with the same minimizer form one context, and all equal strings
meet where their minimizer is sent:

1. Documents are dealt to groups of about ``group_bytes`` by a hash, compressed; equal rows of a batch are sent once with their number.
2. Each group sends the minimizers it holds, once each, with the number of its documents that hold it, and learns which occur in more than one document.
3. Contexts with such a minimizer, each different one once, go to that minimizer's bucket with their first document. A very common minimizer (over ``HOT`` documents) may have as
   many contexts as documents; its contexts are cut into single strings, each sent by a hash of its own, and equal ones meet.
4. A bucket indexes contexts of all but the last documents, as a Burrows-Wheeler transform in runs with sampled run ends, and streams those of all but the first
   ones through it. Matching statistics of ``SPAN`` or more lead to a sampled position, which knows the first document with these bytes.
5. Groups get one bit for each string and drop the covered bytes.

Strings are compared byte by byte in step 4 and hashes only route, so the result is exact. Groups and buckets are bounded by bytes. A group sends
a bucket one message; the bytes of both grow with the input's square root between their bounds, so that a message holds many
minimizers and there are never more messages than minimizers.

Null text is empty. Rows whose id is null are compared with nothing and kept whole. Repeated ids never remove each other's bytes; repeated rows
give repeated results. A text of any length is read in pieces. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_partitions

SPAN, GRAM, HOT, MOST_WINDOWS = 50, 25, 2048, 63
#: Bytes of a long text that are read at once.
PIECE = 1 << 20
#: Bytes of contexts that one index is made for.
INDEXED = 1 << 19
U = np.uint64
_MIX = [U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)]
_LOW48, _LOW32 = U((1 << 48) - 1), U((1 << 32) - 1)
_HIGH32 = ~_LOW32


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every n-byte piece."""
    powers = {1: _MIX[0]}
    cur, size = (buf.astype(U) + U(1)) * _MIX[1], 1
    parts = {1: cur}
    while 2 * size <= n:
        power = powers[size]
        cur = cur[:-size] * power + cur[size:]
        size *= 2
        powers[size] = U(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
        parts[size] = cur
    have = size
    out = parts[size]
    while have < n:
        size = 1 << ((n - have).bit_length() - 1)
        m = len(buf) - have - size + 1
        out = out[:m] * powers[size] + parts[size][have : have + m]
        have += size
    out = out ^ out >> U(29)
    out *= _MIX[2]
    out ^= out >> U(32)
    return out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class Chunk:
    """Some texts in a row; contexts by start, number of strings, minimizer (48 bits) and text."""

    def __init__(self, bodies: list[bytes], first: int):
        self.bytes, self.first = b"".join(bodies), first
        lengths = np.array([len(b) for b in bodies], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        n = len(self.bytes)
        if n < SPAN:
            self.at = self.count = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, U)
            return
        low = window_minima(gram_hashes(np.frombuffer(self.bytes, np.uint8), GRAM), SPAN - GRAM + 1)
        new = np.empty(len(low), bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[self.starts[self.starts < len(low)]] = True
        after = self.ends - SPAN + 1  # strings that start here cross into the next document
        after = np.maximum(after, self.starts)
        new[after[after < len(low)]] = True
        at = np.flatnonzero(new)
        count = np.diff(np.r_[at, len(low)])
        doc = np.searchsorted(self.ends, at, side="right")
        good = at + SPAN <= self.ends[doc]
        at, count, doc = at[good], count[good], doc[good]
        if len(count) and count.max() > MOST_WINDOWS:
            pieces = -(-count // MOST_WINDOWS)
            which = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, doc = np.repeat(at, pieces) + which * MOST_WINDOWS, np.repeat(doc, pieces)
            count = np.minimum(np.repeat(count, pieces) - which * MOST_WINDOWS, MOST_WINDOWS)
        self.at, self.count, self.doc, self.key = at, count, doc + first, low[at] & _LOW48


def chunks(bodies: list[bytes], size: int = 150_000) -> Iterator[Chunk]:
    first = 0
    while first < len(bodies):
        last, total = first, 0
        while last < len(bodies) and (not total or total + len(bodies[last]) <= size):
            total += len(bodies[last])
            last += 1
        yield Chunk(bodies[first:last], first)
        first = last


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the keys, each one's dense rank, and how many different keys there are."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    rank = np.empty(len(keys), np.int32)
    rank[order] = new
    return order, rank, int(new[-1]) + 1


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some texts, and the text positions at both ends of each run.

    Where a query's next byte isn't at its row, the common prefixes of neighbouring rows (a table of range minima) tell which of the
    nearest runs of that byte shares more with what is matched so far, and the query goes on from that run's sampled end.
    ``earliest`` holds, for each position with SPAN bytes, the smallest document of all positions with the same ones.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray):
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        stops = np.cumsum(lengths) - 1
        text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        text[stops] = 0  # ends of texts sort before all bytes
        stop, at = np.repeat(stops, lengths), np.arange(len(text))
        self.n = n = len(text)

        def ahead(x: np.ndarray, k: int) -> np.ndarray:
            return x[np.minimum(at + k, stop)]

        seven = text
        for k in range(1, 7):
            seven = seven << 9 | ahead(text, k)
        # ends differ from each other, so that all suffixes do
        order, rank, classes = _ranked(seven)
        rank += len(stops)
        rank[stops] = np.arange(len(stops))
        levels, k = [rank], 7
        while classes < n:
            order, rank, classes = _ranked(rank.astype(np.int64) << 32 | ahead(rank, k))
            levels.append(rank)
            k *= 2
        i, j = order[:-1], order[1:]
        same = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 2, -1, -1):
            same += (levels[k][np.minimum(i + same, stop[i])] == levels[k][np.minimum(j + same, stop[j])]) * (7 << k)
        apart = seven[np.minimum(i + same, stop[i])] ^ seven[np.minimum(j + same, stop[j])]
        for k in range(1, 7):
            same += apart >> 9 * (7 - k) == 0
        same = np.minimum(same, np.minimum((stop - at)[i], (stop - at)[j]))
        self.minima = np.zeros((n.bit_length(), n), np.uint8 if lengths.max() < 256 else np.int32)
        self.minima[0, 1:] = same
        for k in range(1, len(self.minima)):
            half, low = 1 << k - 1, self.minima[k - 1]
            np.minimum(low[: n - half], low[half:], out=self.minima[k, : n - half])
        heads = np.flatnonzero(np.r_[True, same < SPAN])
        self.earliest = np.empty(n, np.int64)
        self.earliest[order] = np.repeat(np.minimum.reduceat(np.repeat(docs, lengths)[order], heads), np.diff(np.r_[heads, n]))
        bwt = text[order - 1]
        starts = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        by = np.argsort(bwt[starts], kind="stable")
        self.run_start, self.run_end, self.run_symbol = starts[by], np.r_[starts[1:], n][by] - 1, bwt[starts][by]
        self.run_key = self.run_symbol * n + self.run_start
        size = self.run_end - self.run_start + 1
        self.run_to = np.cumsum(size) - size  # where the run's first row goes when its symbol is put before it
        self.start_at, self.end_at, self.top_at = order[self.run_start], order[self.run_end], int(order[0])

    def _common(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bytes that rows low and high, low < high, have in common."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.minima[k, low + 1], self.minima[k, high + 1 - (1 << k)]).astype(np.int64)

    def matching_statistics(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the queries, one after the other: the length of the longest match that starts there, and where the indexed texts hold it (-1: nowhere).

        Queries are streamed from right to left, all in step.
        """
        lengths = np.array([len(q) for q in queries], np.int64)
        ends = np.cumsum(lengths)
        symbols = np.frombuffer(b"".join(queries), np.uint8).astype(np.int64) + 1
        matched, found = np.zeros(len(symbols), np.int64), np.full(len(symbols), -1, np.int64)
        order = np.argsort(-lengths, kind="stable")
        row, place, length = np.zeros(len(order), np.int64), np.full(len(order), self.top_at), np.zeros(len(order), np.int64)
        last_run = len(self.run_key) - 1
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths[order], -t))  # those longer than t
            byte = ends[order[:live]] - 1 - t
            c, j = symbols[byte], row[:live]
            run = np.searchsorted(self.run_key, c * self.n + j, "right") - 1
            above = np.maximum(run, 0)
            has_above = (run >= 0) & (self.run_symbol[above] == c)
            inside = has_above & (j <= self.run_end[above])
            target = self.run_to[above] + j - self.run_start[above]
            place[:live] -= 1
            out = np.flatnonzero(~inside)
            if len(out):
                up, down = above[out], np.minimum(run[out] + 1, last_run)
                can_up, can_down = has_above[out], (self.run_symbol[down] == c[out]) & (run[out] < last_run)
                own = j[out]
                by_up = np.where(can_up, self._common(np.where(can_up, self.run_end[up], 0), np.where(can_up, own, 1)), -1)
                by_down = np.where(can_down, self._common(np.where(can_down, own, 0), np.where(can_down, self.run_start[down], 1)), -1)
                rise = by_up >= by_down
                none = ~(can_up | can_down)
                target[out] = np.where(none, 0, np.where(rise, self.run_to[up] + self.run_end[up] - self.run_start[up], self.run_to[down]))
                place[out] = np.where(none, self.top_at, np.where(rise, self.end_at[up], self.start_at[down]) - 1)
                length[out] = np.where(none, -1, np.minimum(length[out], np.maximum(by_up, by_down)))
            length[:live] += 1
            row[:live] = target
            matched[byte] = length[:live]
            found[byte] = np.where(length[:live] > 0, place[:live], -1)
        return matched, found


def minimizers(contexts: list[bytes]) -> np.ndarray:
    """The smallest gram hash of each context's first string, which all its strings share."""
    ends = np.cumsum([len(c) for c in contexts])
    starts = np.r_[0, ends[:-1]]
    hashes = gram_hashes(np.frombuffer(b"".join(contexts), np.uint8), GRAM)
    return np.minimum.reduceat(np.r_[hashes, np.full(GRAM, U(2**64 - 1))], np.stack([starts, starts + SPAN - GRAM + 1], 1).ravel())[::2]


def sharing(contexts: list[bytes], block: int = 1 << 17) -> np.ndarray:
    """Contexts that may hold a string of another one: 32 bits of a hash of each string tell. No context that does is left out.

    A string takes 8 bytes here; hashes are made for about ``block`` bytes at once.
    """
    lengths = np.array([len(c) for c in contexts], np.int64)
    edges = np.r_[0, np.cumsum(lengths - SPAN + 1)]
    strings = np.empty(edges[-1], U)
    parts = np.flatnonzero(np.r_[True, np.diff((np.cumsum(lengths) - lengths) // block) > 0, True]) if len(lengths) else [0]
    for i, j in zip(parts[:-1], parts[1:]):
        n = lengths[i:j] - SPAN + 1
        at = np.arange(n.sum()) + np.repeat(np.arange(j - i) * (SPAN - 1), n)
        hashes = gram_hashes(np.frombuffer(b"".join(contexts[i:j]), np.uint8), SPAN)[at]
        strings[edges[i] : edges[j]] = hashes & _HIGH32 | np.repeat(np.arange(i, j, dtype=U), n)
    strings.sort()
    found = np.zeros(len(contexts), bool)
    for a in range(0, len(strings) - 1, 1 << 20):
        own = strings[a : a + (1 << 20) + 1]
        both = own[1:] ^ own[:-1]
        twice = np.flatnonzero((both >> U(32) == 0) & (both != 0))
        found[(own[twice] & _LOW32).astype(np.int64)] = True
        found[(own[twice + 1] & _LOW32).astype(np.int64)] = True
    return np.flatnonzero(found)


def _places_within(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The dense rank of each value within its group; rows are in order of both."""
    other = np.r_[False, (group[1:] != group[:-1]) | (value[1:] != value[:-1])]
    count = np.cumsum(other)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return count - np.repeat(count[first], np.diff(np.r_[first, len(group)]))


def earlier_strings(contexts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each string of different contexts, given with their first documents: whether it also starts in a context with a smaller document.

    Contexts can only share a string if they share their minimizer. Those of all documents but a minimizer's last one are indexed, and those
    of all but its first one are streamed through the index. A match of SPAN bytes or more leads to a position, and the smallest
    document that has the same bytes is known there. Minimizers are taken together up to about ``INDEXED`` bytes, which bounds an index.
    Most contexts share a minimizer and no whole string; those that no hash of a string joins with another are left out at the start.
    """
    edges = np.r_[0, np.cumsum([len(c) - SPAN + 1 for c in contexts])].astype(np.int64)
    earlier = np.zeros(edges[-1], bool)
    shared = sharing(contexts)
    if not len(shared):
        return earlier
    contexts, docs, edges = [contexts[i] for i in shared], docs[shared], edges[shared]
    sizes = np.array([len(c) - SPAN + 1 for c in contexts], np.int64)
    group = np.unique(minimizers(contexts), return_inverse=True)[1]
    order = np.lexsort((docs, group))
    number = np.zeros(len(contexts), np.int64)
    number[order] = _places_within(group[order], docs[order])
    last = np.zeros(len(contexts), np.int64)
    np.maximum.at(last, group, number)
    order = order[last[group[order]] > 0]
    if not len(order):
        return earlier
    heads = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    before = np.cumsum(sizes[order] + SPAN)[heads] // INDEXED
    for own in np.split(order, heads[1:][np.diff(before) > 0]):
        reference, asked = own[number[own] < last[group[own]]], own[number[own] > 0]
        index = RunLengthIndex([contexts[i] for i in reference], docs[reference])
        matched, place = index.matching_statistics([contexts[i] for i in asked])
        n = sizes[asked]
        first, string = np.cumsum(n + SPAN - 1) - (n + SPAN - 1), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first, n) + string
        earlier[np.repeat(edges[asked], n) + string] = (matched[at] >= SPAN) & (index.earliest[place[at]] < np.repeat(docs[asked], n))
    return earlier


class Group:
    """The documents of one group, in order of id, then length and bytes, cut into pieces that show the next one's first SPAN - 1 bytes."""

    def __init__(self, rows: pa.Table, piece: int = PIECE):
        ids, texts, copies = [], [], []
        for doc_ids, number, lengths, packed in zip(*(rows.column(c).to_pylist() for c in ("ids", "copies", "lengths", "bodies"))):
            body, at = zstandard.decompress(packed), 0
            ids += np.frombuffer(doc_ids, np.int64).tolist()
            copies += np.frombuffer(number, np.int64).tolist()
            for n in np.frombuffer(lengths, np.int64).tolist():
                texts.append(body[at : at + n])
                at += n
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(texts[i]), texts[i]))
        self.copies = [copies[i] for i in order]
        self.texts = [texts[i] for i in order]
        cut = [(k, at) for k, text in enumerate(self.texts) for at in range(0, max(len(text) - SPAN + 1, 1), piece)]
        self.text_of, self.offset = ([c[i] for c in cut] for i in (0, 1))
        self.bodies = [self.texts[k][at : at + piece + SPAN - 1] for k, at in cut]
        self.ids = np.array([ids[order[k]] for k in self.text_of], np.int64)

    def contexts(self, repeated: np.ndarray, hot: np.ndarray) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Each chunk with the starts, counts, documents and minimizers of its contexts with a repeated minimizer, hot ones cut into strings."""
        for chunk in chunks(self.bodies):
            at = np.minimum(np.searchsorted(repeated, chunk.key), max(len(repeated) - 1, 0))
            keep = repeated[at] == chunk.key if len(repeated) else np.zeros(len(chunk.key), bool)
            start, count, doc, key, cut = chunk.at[keep], chunk.count[keep], chunk.doc[keep], chunk.key[keep], hot[at[keep]] if len(repeated) else keep
            if cut.any():
                n = np.where(cut, count, 1)
                which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start, doc, key, count = np.repeat(start, n) + which, np.repeat(doc, n), np.repeat(key, n), np.where(np.repeat(cut, n), 1, np.repeat(count, n))
                key[np.repeat(cut, n)] |= U(1 << 63)
            yield chunk, start, count, doc, key

    def places(self, repeated: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[dict[bytes, int], list[int], list[int], list[tuple]]:
        """Different contexts numbered in order, their first document's position and bucket, and every occurrence by chunk."""
        known: dict[bytes, int] = {}
        first, route, seen = [], [], []
        for chunk, start, count, doc, key in self.contexts(repeated, hot):
            body, number = chunk.bytes, np.empty(len(start), np.int64)
            for i, (s, n, d, k) in enumerate(zip(start.tolist(), count.tolist(), doc.tolist(), key.tolist())):
                text = body[s : s + n + SPAN - 1]
                j = known.get(text)
                if j is None:
                    known[text] = j = len(first)
                    first.append(d)
                    route.append((zlib.crc32(text) if k >> 63 else k) % buckets)
                number[i] = j
            seen.append((chunk, start, count, doc, number))
        return known, first, route, seen


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _by(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions in order) for each value that occurs."""
    order = np.argsort(values, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(values[order]) != 0, True]) if len(values) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(values[order[a]]), order[a:b]


_BACK = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("route", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_BACK_SQL = "pid int, kind int, route int, a binary, b binary"


def _repeated(back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = [r for r in back.to_pylist() if r["kind"] == 0]
    keys = np.concatenate([_from_six(r["a"]) for r in rows]) if rows else np.zeros(0, U)
    hot = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(r["a"]) // 6) for r in rows]).astype(bool) if rows else np.zeros(0, bool)
    order = np.argsort(keys)
    return keys[order], hot[order]


def sizes_for(total: int, least: int = 4 << 20, most: int = 48 << 20) -> int:
    """Bytes of a group or bucket of text, so that a group's message to a bucket holds 64 minimizers or more as long as the bounds allow it."""
    return min(max(least, math.isqrt(850 * total)), most)


def dedup(docs: DataFrame, group_bytes: int | None = None, keep_text: bool = False, hot_docs: int = HOT, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; with ``keep_text`` also text_sha256 (of all bytes) and
    kept (the remaining bytes as text, without those of a character that was cut through)."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("body"))
    total = rows.agg(F.sum(F.length("body").cast("long"))).first()[0] or 0
    group_bytes = group_bytes or sizes_for(total)
    n_groups = max(shuffle_partitions(spark), -(-total // group_bytes))
    n_buckets = n_groups
    # a repeated id isn't one group's alone; equal rows are few by the time they are sent
    pid = F.pmod(F.xxhash64("doc_id", "body"), F.lit(n_groups)).cast("int")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out: dict[str, list] = {"pid": [], "ids": [], "copies": [], "lengths": [], "bodies": []}
            for p, at in _by(b.column("pid").to_numpy(), n_groups):
                take = pa.array(at)
                different = Counter(zip(b.column("doc_id").take(take).to_pylist(), b.column("body").take(take).to_pylist()))
                bodies = [body for _, body in different]
                out["pid"].append(p)
                out["ids"].append(np.array([i for i, _ in different], np.int64).tobytes())
                out["copies"].append(np.array(list(different.values()), np.int64).tobytes())
                out["lengths"].append(np.array([len(x) for x in bodies], np.int64).tobytes())
                out["bodies"].append(press.compress(b"".join(bodies)))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("pid", pa.int32()), *((c, pa.binary()) for c in ("ids", "copies", "lengths", "bodies"))]))

    bundles = rows.where("doc_id is not null").withColumn("pid", pid).mapInArrow(bundle, "pid int, ids binary, copies binary, lengths binary, bodies binary")

    def send_keys(t: pa.Table) -> pa.Table:
        group, p = Group(t, piece), t.column("pid")[0].as_py()
        keys, ids = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for chunk in chunks(group.bodies):
            keys.append(chunk.key)
            ids.append(group.ids[chunk.doc])
        key, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        other = new | np.r_[True, ids[1:] != ids[:-1]][: len(key)]
        starts = np.flatnonzero(new)
        count = np.minimum(np.add.reduceat(other.astype(np.int64), starts), 65535).astype("<u2") if len(starts) else np.zeros(0, "<u2")
        key = key[starts]
        out: dict[str, list] = {"bucket": [], "pid": [], "keys": [], "counts": []}
        for q, at in _by((key % U(n_buckets)).astype(np.int64), n_buckets):
            out["bucket"].append(q)
            out["pid"].append(p)
            out["keys"].append(_six(key[at]))
            out["counts"].append(zlib.compress(count[at].tobytes(), 1))
        return pa.table(out, pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    sent = bundles.groupBy("pid").applyInArrow(send_keys, "bucket int, pid int, keys binary, counts binary")

    def find_repeated(t: pa.Table) -> pa.Table:
        keys = [_from_six(k) for k in t.column("keys").to_pylist()]
        counts = [np.frombuffer(zlib.decompress(c), "<u2") for c in t.column("counts").to_pylist()]
        pids = np.repeat(t.column("pid").to_numpy(), [len(k) for k in keys])
        key = np.concatenate(keys)
        total = np.concatenate(counts).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, pids, total = key[order], pids[order], total[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.repeat(np.add.reduceat(total, starts), np.diff(np.r_[starts, len(key)]))
        many = total > 1
        key, pids, hot = key[many], pids[many], total[many] > hot_docs
        found = list(_by(pids, n_groups))
        n = len(found)
        return pa.table([pa.array([p for p, _ in found], pa.int32()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([_six(key[at]) for _, at in found], pa.binary()), pa.array([np.packbits(hot[at]).tobytes() for _, at in found], pa.binary())], schema=_BACK)

    repeated = sent.groupBy("bucket").applyInArrow(find_repeated, _BACK_SQL)

    def send_contexts(t: pa.Table, back: pa.Table) -> pa.Table:
        out: dict[str, list] = {"route": [], "pid": [], "lengths": [], "firsts": [], "contexts": []}
        if t.num_rows and back.num_rows:
            group, p, press = Group(t, piece), t.column("pid")[0].as_py(), zstandard.ZstdCompressor(level=3)
            known, first, route, _ = group.places(*_repeated(back), n_buckets)
            texts, first_id = list(known), group.ids[np.array(first, np.int64)]
            for r, at in _by(np.array(route, np.int64), n_buckets):
                own = [texts[i] for i in at]
                out["route"].append(r)
                out["pid"].append(p)
                out["lengths"].append(zlib.compress(np.array([len(x) for x in own], "<u2").tobytes(), 1))
                out["firsts"].append(zlib.compress(first_id[at].tobytes(), 1))
                out["contexts"].append(press.compress(b"".join(own)))
        return pa.table(out, pa.schema([("route", pa.int32()), ("pid", pa.int32()), ("lengths", pa.binary()), ("firsts", pa.binary()), ("contexts", pa.binary())]))

    contexts = bundles.groupBy("pid").cogroup(repeated.groupBy("pid")).applyInArrow(send_contexts, "route int, pid int, lengths binary, firsts binary, contexts binary")

    def match(t: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        first: list[int] = []
        asked = []
        for lengths, firsts, packed in zip(*(t.column(c).to_pylist() for c in ("lengths", "firsts", "contexts"))):
            body, at, own = zstandard.decompress(packed), 0, []
            ids = np.frombuffer(zlib.decompress(firsts), np.int64)
            for n, d in zip(np.frombuffer(zlib.decompress(lengths), "<u2").tolist(), ids.tolist()):
                text = body[at : at + n]
                at += n
                j = known.setdefault(text, len(first))
                if j == len(first):
                    first.append(d)
                elif d < first[j]:
                    first[j] = d
                own.append(j)
            asked.append((own, ids))
        texts, first_id = list(known), np.array(first, np.int64)
        windows = np.array([len(x) - SPAN + 1 for x in texts])
        flat_at = np.cumsum(windows) - windows
        flat = earlier_strings(texts, first_id)
        bits = []
        for own, ids in asked:
            own = np.array(own)
            n = windows[own]
            where = np.repeat(flat_at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bits.append(np.packbits(flat[where] | np.repeat(first_id[own] < ids, n)).tobytes())
        k = t.num_rows
        return pa.table([t.column("pid").cast(pa.int32()), pa.array([1] * k, pa.int32()), t.column("route").cast(pa.int32()), pa.array(bits, pa.binary()), pa.array([b""] * k, pa.binary())], schema=_BACK)

    marks = contexts.groupBy("route").applyInArrow(match, _BACK_SQL)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64()] * 4 + [pa.string()]
    if keep_text:
        names, kinds = [*names, "text_sha256", "kept"], [*kinds, pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds)))

    def cut(t: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        if t.num_rows:
            group = Group(t, piece)
            _, first, route, seen = group.places(*_repeated(back), n_buckets)
            answers = {r["route"]: r["a"] for r in back.to_pylist() if r["kind"] == 1}
            n = np.zeros(len(first), np.int64)
            for _, _, count, _, number in seen:
                n[number] = count
            flat_at = np.cumsum(n) - n
            bits = np.zeros(int(n.sum()), bool)
            for r, at in _by(np.array(route, np.int64), n_buckets):
                m = n[at]
                where = np.repeat(flat_at[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                bits[where] = np.unpackbits(np.frombuffer(answers[r], np.uint8), count=len(where))
            first_id = group.ids[np.array(first, np.int64)] if first else np.zeros(0, np.int64)
            for chunk, start, count, doc, number in seen:
                body = np.frombuffer(chunk.bytes, np.uint8)
                mark = np.zeros(len(body) + 1, bool)
                where = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                own = bits[np.repeat(flat_at[number], count) + where]
                later = np.repeat(group.ids[doc] > first_id[number], count)
                mark[(np.repeat(start, count) + where)[own | later]] = True
                total = np.cumsum(mark[:-1])
                covered = total > 0
                covered[SPAN:] = total[SPAN:] > total[:-SPAN]
                for i, (s, e) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist()), chunk.first):
                    gone, text = covered[s:e], group.texts[group.text_of[i]]
                    if e - s < len(text):  # a piece: bytes at its edge may be covered from either side
                        if not group.offset[i]:
                            whole = np.zeros(len(text), bool)
                        whole[group.offset[i] : group.offset[i] + e - s] |= gone
                        if group.offset[i] + e - s < len(text):
                            continue
                        gone = whole
                    k = int(np.count_nonzero(gone))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if k else text
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if k else 0
                    row = int(group.ids[i]), len(text), k, spans, hashlib.sha256(kept).hexdigest()
                    out += [(*row, hashlib.sha256(text).hexdigest(), kept.decode("utf-8", "ignore")) if keep_text else row] * group.copies[group.text_of[i]]
        return pa.table([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [[]] * len(names), kinds)], schema=schema)

    out_sql = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text_sha256 string, kept string" if keep_text else "")
    done = bundles.groupBy("pid").cogroup(repeated.union(marks).groupBy("pid")).applyInArrow(cut, out_sql)
    whole = rows.where("doc_id is null").select("doc_id", F.length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"), *([F.sha2("body", 256).alias("text_sha256"), F.col("body").cast("string").alias("kept")] if keep_text else []))
    return done.union(whole)


def dedup_digest(docs: DataFrame) -> DataFrame:
    return dedup(docs)
