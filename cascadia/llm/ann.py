"""Approximate nearest neighbours on robust-pruned directed graphs.

Rows are dealt by a hash of their id to shards of about ``shard_bytes`` of single-precision vectors. A shard is one task's work: it reads its
vectors first and builds a graph, then the queries stream through it in blocks, so no graph is sent or copied anywhere. A graph starts
with random edges; batches of points are searched for greedily on the graph so far, and relaxed distance
pruning picks their out-edges from what the search met, dropping a candidate that an edge kept reaches ``alpha``
times closer; reverse edges are added and pruned alike. Every query is searched by a beam on every shard of its length,
each shard returns its best, and the best of all shards are kept, with cosines computed anew in double precision. Larger shards need a wider
beam for the same recall; the README has recall against both.

Every row is indexed, and vectors of every length are: a length has shards and queries of its own, as cosines exist only within a length.
Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id. Repeated ids are separate candidates of the same id; a row is no candidate for its own id. Ties go to the smaller id. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .neardup import packed_vectors, unit

SEEDS = 32


class PrunedGraph:
    """Directed graph over unit vectors; distances are Euclidean, so the order is that of cosines."""

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 24, alpha: float = 1.2, passes: int = 1, spare: int = 16, seed: int = 9):
        self.x, self.degree, self.alpha = x.astype(np.float32), degree, alpha
        n, rng = len(x), np.random.default_rng(seed)
        self.edges = np.full((n, degree + spare), -1, np.int64)
        if n > 1:
            self.edges[:, : degree // 2] = (np.arange(n)[:, None] + rng.integers(1, n, (n, degree // 2))) % n
        centre = np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1)) if n else 0
        self.seeds = np.unique(np.r_[centre, rng.permutation(n)[: SEEDS - 1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        for _ in range(passes):
            order = rng.permutation(n)
            for i in range(0, n, 256):
                self._insert(order[i : i + 256], beam)

    def _prune(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Out-edges of the points from candidates (-1: none)."""
        rows = np.arange(len(points))
        cand = np.sort(cand, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == points[:, None]] = -1
        y = self.x[cand]
        near = np.sqrt(np.maximum(2 - 2 * np.einsum("bd,bcd->bc", self.x[points], y), 0))
        near[cand < 0] = np.inf
        among = np.sqrt(np.maximum(2 - 2 * (y @ y.transpose(0, 2, 1)), 0))
        left, out = near.copy(), np.full((len(points), self.degree), -1, np.int64)
        for k in range(self.degree):
            best = left.argmin(1)
            real = np.isfinite(left[rows, best])
            if not real.any():
                break
            out[real, k] = cand[rows, best][real]
            left[rows, best] = np.inf
            left[self.alpha * among[rows, best] <= near] = np.inf
        return out

    def _insert(self, points: np.ndarray, beam: int) -> None:
        met, _ = self.search(self.x[points], beam)
        self.edges[points, : self.degree] = self._prune(points, np.concatenate([met, self.edges[points]], 1))
        self.edges[points, self.degree :] = -1
        source, target = np.repeat(points, self.degree), self.edges[points, : self.degree].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hubs, starts, more = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(starts, more)
        self.edges[hubs] = -np.sort(-self.edges[hubs], 1)  # free places last
        have = (self.edges[hubs] >= 0).sum(1)
        # reverse edges go to free places; only a point without enough of them is pruned
        fit = np.repeat(have + more <= self.edges.shape[1], more)
        self.edges[target[fit], (np.repeat(have, more) + rank)[fit]] = source[fit]
        source, target, rank = source[~fit], target[~fit], rank[~fit]
        for first in range(0, int(rank.max(initial=-1)) + 1, 2 * self.degree):
            part = (rank >= first) & (rank < first + 2 * self.degree)
            hubs, row = np.unique(target[part], return_inverse=True)
            new = np.full((len(hubs), 2 * self.degree), -1, np.int64)
            new[row, rank[part] - first] = source[part]
            for i in range(0, len(hubs), 512):
                h = hubs[i : i + 512]
                both = np.concatenate([self.edges[h], new[i : i + 512]], 1)
                self.edges[h, : self.degree] = self._prune(h, both[:, (both >= 0).any(0)])
                self.edges[h, self.degree :] = -1

    def search(self, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``beam`` nearest met for each query, -1 where there are fewer; all queries in lockstep."""
        q, n = queries.astype(np.float32), len(self.x)
        m, rows = len(q), np.arange(len(q))
        at_row = (rows * (n + 1))[:, None]
        seen = np.zeros(m * (n + 1), bool)
        seen[at_row.ravel() + n] = True  # id -1
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        fresh = np.broadcast_to(self.seeds, (m, len(self.seeds)))
        while True:
            seen[(at_row + np.where(fresh < 0, n, fresh)).ravel()] = True
            s = np.einsum("qd,qcd->qc", q, self.x.take(fresh, 0, mode="wrap"))
            s[fresh < 0] = -np.inf
            ids, sims = np.concatenate([ids, fresh], 1), np.concatenate([sims, s], 1)
            done = np.concatenate([done, fresh < 0], 1)
            top = np.argpartition(-sims, beam - 1, 1)[:, :beam] if ids.shape[1] > beam else np.tile(np.arange(ids.shape[1]), (m, 1))
            ids, sims, done = (np.take_along_axis(a, top, 1) for a in (ids, sims, done))
            if done.all():
                break
            open_sims = np.where(done, -np.inf, sims)
            at = np.argpartition(-open_sims, width - 1, 1)[:, :width] if beam > width else np.argsort(-open_sims, 1)[:, :width]
            chosen = np.where(np.take_along_axis(done, at, 1), -1, np.take_along_axis(ids, at, 1))
            np.put_along_axis(done, at, True, 1)
            fresh = np.where(chosen[:, :, None] >= 0, self.edges.take(chosen, 0, mode="wrap"), -1).reshape(m, -1)
            fresh = np.where(seen.take((at_row + np.where(fresh < 0, n, fresh)).ravel()).reshape(fresh.shape), -1, fresh)
            fresh = np.sort(fresh, 1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            # as few columns as the query with the most new points needs
            fresh = np.sort(fresh, 1)[:, fresh.shape[1] - max(1, int((fresh >= 0).sum(1).max())) :]
        return ids, sims


def nearest(frame: DataFrame, k: int = 5, every: int = 50, shard_bytes: int = 2 << 20, query_block: int = 256, beam: int = 96) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every``."""
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    rows = rows.where(F.size("embedding") > 0)
    # there are no more lengths than the longest vector has components
    shards = {r["size"]: -(-r["count"] * 4 * r["size"] // shard_bytes) for r in rows.groupBy(F.size("embedding").alias("size")).count().collect()}

    def blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                places, v = packed_vectors(b.column("embedding"))
                sizes = [len(x) // 8 for x in v]
                columns = [pa.array(x, pa.int32()) for x in (sizes, [shards[size] for size in sizes])]
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(places)), *columns, pa.array(v, pa.binary())], ["vec_id", "size", "shards", "v"])

    blobs = rows.mapInArrow(blob, "vec_id long, size int, shards int, v binary")
    points = blobs.withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int")).withColumn("query", F.lit(False))
    queries = blobs.where(F.col("vec_id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("query", F.lit(True))
    # a shard's points come before its queries
    both = points.union(queries).select("size", "shard", "query", "vec_id", "v").repartition("size", "shard").sortWithinPartitions("size", "shard", "query", "vec_id", "v")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, graph = None, [], None
        for size, number, is_query, part in _parts(batches, query_block):
            if (size, number) != shard:
                shard, points, graph = (size, number), [], None
            if not is_query:
                points.append(part)
                continue
            if graph is None and not points:
                continue  # no vector was dealt to this shard
            if graph is None:
                ids, x = (np.concatenate(c) for c in zip(*points))
                points, x = [], unit(x)
                graph = PrunedGraph(x)
            yield _best(graph, ids, x, *part, k, beam)

    found = both.mapInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, bool, tuple[np.ndarray, np.ndarray]]]:
    """(size, shard, query, (ids, vectors)) of rows in a row that have all three in common, ``most`` at a time."""
    for b in batches:
        size, shard, query, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "shard", "query", "vec_id"))
        v = b.column("v").to_pylist()
        edges = np.flatnonzero((size[1:] != size[:-1]) | (shard[1:] != shard[:-1]) | (query[1:] != query[:-1])) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
            for i in range(start, stop, most):
                j = min(i + most, stop)
                yield int(size[i]), int(shard[i]), bool(query[i]), (ids[i:j], np.frombuffer(b"".join(v[i:j])).reshape(j - i, -1))


def _best(graph: PrunedGraph, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    q = unit(q)
    met, _ = graph.search(q, beam)
    score = np.clip(np.einsum("qd,qcd->qc", q, x[met]), -1, 1)
    score[(met < 0) | (ids[met] == q_ids[:, None])] = -np.inf
    order = np.lexsort((ids[met], -score))[:, :k]
    best, found = np.take_along_axis(score, order, 1), np.take_along_axis(ids[met], order, 1)
    real = np.isfinite(best).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, order.shape[1])[real]), pa.array(found.ravel()[real]), pa.array(best.ravel()[real])], ["query_id", "vec_id", "score"])
