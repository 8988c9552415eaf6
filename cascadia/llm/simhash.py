"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint has a bit set where over half of the XXH64 values (seed 42) of a text's word shingles have it. Equal
fingerprints are one class before anything is compared. Two fingerprints within ``distance`` bits agree on two of
four segments, so each distinct one is routed six times, by every pair of segments; a pair that very many share is routed by three finer keys,
one of which two differing bits leave equal. A task sorts what it got by Gray
rank, with the shared segments leading, and builds the index: a leaf holds ``FANOUT`` neighbours; the mask and the
pattern of the bits in which they agree go into its parent, without the bits its own parents factor out. A search
descends with accumulated differences and drops a whole group as soon as they exceed the distance. Links found in a
task leave it as a spanning forest, at most one row for each fingerprint.

Null and empty texts have fingerprint zero, linked like any other. Null ids keep their fingerprint and take no part
in the choice of the smallest id. Repeated rows give repeated results. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, shuffle_partitions
from .graph import Roots, components

FANOUT = 8
#: Fewest differing segments allowed: 4 segments, 2 differing bits.
SEGMENTS = 4


def shingle_hashes(text: str | None, words_each: int = 3) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-words_each] + 1).tolist()]
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[words_each - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, words_each: int = 3) -> int:
    hashes = shingle_hashes(text, words_each)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_each: int = 3, key: Column | None = None) -> DataFrame:
    """(doc_id, key, fp): the fingerprint as a signed long; ``key`` is a text column of the rows, null if none is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), words_each) for x in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    key = F.lit(None) if key is None else key
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), key.cast("string").alias("key"))
    return rows.mapInArrow(run, "doc_id long, key string, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical Hamming index over distinct 64-bit codes; ``lead`` names the bits that lead the order."""

    def __init__(self, codes: np.ndarray, lead: np.uint64 = np.uint64(0)):
        moved, at = np.zeros_like(codes), 63
        for bit in sorted(range(63, -1, -1), key=lambda b: not int(lead) >> b & 1):
            moved |= (codes >> np.uint64(bit) & np.uint64(1)) << np.uint64(at)
            at -= 1
        self.order = np.argsort(gray_rank(moved), kind="stable")
        self.codes = codes[self.order]
        full = np.full(len(codes), ~np.uint64(0))
        levels, masks, values = [], full, self.codes
        while len(masks) > 1:
            starts = np.arange(0, len(masks), FANOUT)
            ones, none = np.bitwise_and.reduceat(values & masks, starts), np.bitwise_and.reduceat(~values & masks, starts)
            up_masks, up_values = ones | none, ones
            parent = np.arange(len(masks)) // FANOUT
            levels.append((masks & ~up_masks[parent], values))  # a child keeps only the bits not factored out above
            masks, values = up_masks, up_values
        levels.append((masks, values))
        self.levels = levels[::-1]

    def pairs(self, queries: np.ndarray, distance: int, step: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, index into the codes given) of all pairs within the distance, some queries at a time."""
        if not len(self.codes):
            return
        for first in range(0, len(queries), step):
            q = np.arange(first, min(first + step, len(queries)))
            node = np.zeros(len(q), np.int64)
            far = np.zeros(len(q), np.int64)
            for depth, (masks, values) in enumerate(self.levels):
                if depth:
                    child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, far = np.repeat(q, FANOUT), np.repeat(far, FANOUT)
                    real = child < len(masks)
                    q, far, node = q[real], far[real], child[real]
                far = far + np.bitwise_count((queries[q] ^ values[node]) & masks[node])
                near = far <= distance
                q, far, node = q[near], far[near], node[near]
            yield q, self.order[node]


def _lead(pair: tuple[int, int]) -> int:
    width = 64 // SEGMENTS
    return sum(((1 << width) - 1) << (width * s) for s in pair)


def routes() -> tuple[list[int], list[list[int]]]:
    """The bits of each pair of segments, and for each pair those bits with a third of the others: two differing bits leave one third equal."""
    leads = [_lead(p) for p in combinations(range(SEGMENTS), 2)]
    finer = []
    for lead in leads:
        rest = [b for b in range(64) if not lead >> b & 1]
        finer.append([lead | sum(1 << b for b in rest[k::3]) for k in range(3)])
    return leads, finer


def _key(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def fingerprint_links(distinct: DataFrame, distance: int = 2, hot: int = 1 << 16) -> DataFrame:
    """(a, b): spanning links between the distinct fingerprints ``fp`` of a table. A pair of segments that more than ``hot`` fingerprints share is routed by finer keys."""
    if not 0 <= distance <= 2:
        raise ValueError("four segments guarantee distances up to 2")
    coarse, finer = routes()
    leads = [*coarse, *(mask for masks in finer for mask in masks)]

    def routed(masks: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("lead"), _key(mask).alias("key")) for i, mask in masks])

    first = distinct.select("fp", F.explode(routed(list(enumerate(coarse)))).alias("r")).select("fp", "r.lead", "r.key")
    common = first.groupBy("lead", "key").count().where(F.col("count") > hot).select("lead", "key", F.lit(True).alias("common"))
    split = F.when(F.col("common"), reduce(lambda rest, i: F.when(F.col("lead") == i, routed([(len(coarse) + 3 * i + k, mask) for k, mask in enumerate(finer[i])])).otherwise(rest), range(len(coarse)), F.array(F.struct("lead", "key"))))
    sent = first.join(common, ["lead", "key"], "left").select("fp", F.explode(split.otherwise(F.array(F.struct("lead", "key")))).alias("r"))
    routed_rows = sent.select("fp", "r.lead", "r.key").repartition(shuffle_partitions(distinct.sparkSession), "lead", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {}
        for b in batches:
            lead, fp = b.column("lead").to_numpy(), b.column("fp").to_numpy()
            for x in np.unique(lead):
                got.setdefault(int(x), []).append(fp[lead == x])
        for lead, parts in got.items():
            codes = np.unique(np.concatenate(parts).view(np.uint64))
            joined = Roots(len(codes))
            for q, c in GrayIndex(codes, np.uint64(leads[lead])).pairs(codes, distance):
                joined.join(q[q < c], c[q < c])
            label = joined.all()
            linked = np.flatnonzero(label != np.arange(len(codes)))
            yield pa.RecordBatch.from_arrays([pa.array(codes[linked].view(np.int64)), pa.array(codes[label[linked]].view(np.int64))], ["a", "b"])

    return routed_rows.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, words_each: int = 3, distance: int = 2, key: Column | None = None) -> DataFrame:
    """doc_id, key, fp, root (a fingerprint that stands for the component), component_id (its smallest doc_id) of every row."""
    prints = checkpointed(fingerprints(docs, words_each, key))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(distinct, distance))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = checkpointed(placed)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "key", "fp", "root", "component_id")


def simhash_groups(docs: DataFrame, words_each: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id of the component)."""
    return grouped(docs, words_each, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
