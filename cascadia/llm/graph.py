"""Connected components: of a few arrays in one task, and of a distributed table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


class Roots:
    """Union-find over arrays: each node's root is the smallest node it is joined to. Only nodes that are named in a call are touched by it."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, nodes: np.ndarray) -> np.ndarray:
        root = self.parent[nodes]
        while ((up := self.parent[root]) != root).any():
            root = up
        self.parent[nodes] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def all(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link to another node; root is the smallest node of its component.

    Alternating large-star and small-star rounds. Smallest neighbours come from partial aggregates and go back by a
    join whose other side has one row per node, so a hub with a third of all links is split by adaptive execution
    and never gathered. Links with a null end and loops are ignored. Each round is checkpointed.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = checkpointed(links.select(high.alias("u"), low.alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by them; holds a batch and one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for x in now:
            change[1:] |= x[1:] != x[:-1]
        change[0] = last is not None and any(x[0] != y for x, y in zip(now, last))
        at = np.flatnonzero(change)
        last = [x[-1] for x in now]
        if not len(at):
            held.append(batch)
            continue
        held.append(batch.slice(0, at[-1]))
        if any(x.num_rows for x in held):
            yield pa.Table.from_batches(held)
        held = [batch.slice(at[-1])]
    if held:
        yield pa.Table.from_batches(held)


def split_runs(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """(whole runs of equal keys with up to ``most`` rows each, False) and (rows of a longer run, True), from batches sorted by the key; never holds more than ``most`` rows and a batch."""
    held: pa.Table | None = None
    last, long = None, False
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if long and rows.num_rows:
            other = rows.column(key).to_numpy() != last
            n = int(other.argmax()) if other.any() else rows.num_rows
            if n:
                yield rows.slice(0, n), True
            rows, long = rows.slice(n), n == rows.num_rows
        if not rows.num_rows:
            continue
        rows = pa.concat_tables([held, rows]) if held else rows
        x = rows.column(key).to_numpy()
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        sizes = np.diff(np.r_[starts, len(x)])
        over = np.repeat(sizes > most, sizes)
        done, tail = over.copy(), int(starts[-1])
        done[:tail] = True
        for hot in (False, True):
            own = done & (over == hot)
            if own.any():
                yield rows.filter(pa.array(own)), hot
        last, long = x[-1], bool(over[-1])
        held = None if long else rows.slice(tail)
    if held is not None:
        yield held, False
