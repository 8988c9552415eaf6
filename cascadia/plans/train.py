"""Training of cascades: group importances, the knapsack split, and the searches for a threshold or a top-K ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.models import Callbacks
from ..operators.relational import digest, digest_bucket, hash_split
from .cascade import Cascade, UNSURE, tri_state
from .plan import FeaturePlan

CUTOFFS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
THRESHOLDS = (0.6, 0.7, 0.8, 0.9, 1.0)
LOSS_BUDGET, PRECISION, SAMPLES, NEEDED = 0.001, 0.95, 100, 99
#: Stored rows are narrow, so a part of them may have this many.
PART_ROWS = 100_000


class Features:
    """The row id, the label and all features of the rows, built once and stored until the end of the block.

    Texts and other columns that features are built from aren't stored. ``rows`` has few parts: a fit of many passes costs as many tasks as there are parts.
    """

    def __init__(self, rows: DataFrame, plan: FeaturePlan, label: str):
        self._held = plan.build(rows).select(plan.row_id, label, *plan.columns()).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> DataFrame:
        parts = max(self._held.sparkSession.sparkContext.defaultParallelism, -(-self._held.count() // PART_ROWS))
        return self._held.coalesce(parts)

    def __exit__(self, *_: object) -> None:
        self._held.unpersist()


def permuted(df: DataFrame, row_id: str, columns: Sequence[str], seed: int, bucket_rows: int = 200_000) -> DataFrame:
    """The rows with the named columns taken from other rows, by a seeded order.

    Rows are dealt to buckets of about ``bucket_rows`` by a digest of their id and get places within them, once by one seed and once by another, so no single task orders a large table.
    """
    buckets = max(1, -(-df.count() // bucket_rows))
    bucket = digest_bucket(F.col(row_id), seed, buckets)

    def placed(key: int) -> DataFrame:
        own = Window.partitionBy("_b").orderBy(digest(F.col(row_id), key), row_id)
        return df.withColumn("_b", bucket).withColumn("_at", F.row_number().over(own))

    moved = placed(seed + 2).select("_b", "_at", *columns)
    return placed(seed + 1).drop(*columns).join(moved, ["_b", "_at"]).drop("_b", "_at")


def importances(valid: DataFrame, plan: FeaturePlan, callbacks: Callbacks, model: object, label: str, seed: int = 42) -> dict[str, float]:
    """How much the score falls when a group's columns are permuted together. The callbacks see the row id, the label and the features."""
    with Features(valid, plan, label) as held:
        base = callbacks.score(callbacks.predict(model, held), label)
        return {g.name: base - callbacks.score(callbacks.predict(model, permuted(held, plan.row_id, g.columns, seed + i)), label) for i, g in enumerate(plan.groups)}


def knapsack(values: Mapping[str, float], costs: Mapping[str, float], cutoff: float, scale: int = 1000) -> tuple[list[str], int]:
    """The most valuable groups within ``cutoff`` of the total cost, and their scaled cost."""
    total = sum(costs.values())
    weight = {k: round(costs[k] * scale / total) for k in values}
    room = int(scale * cutoff)
    best = np.zeros(room + 1)
    taken = []
    for name in values:
        w, keep = weight[name], np.zeros(room + 1, bool)
        if w <= room:
            other = best[: room + 1 - w] + values[name]
            keep[w:] = other > best[w:]
            best = np.r_[best[:w], np.maximum(best[w:], other)]
        taken.append((name, keep))
    at, chosen = room, []
    for name, keep in reversed(taken):
        if keep[at]:
            chosen.append(name)
            at -= weight[name]
    chosen = [k for k in values if k in chosen]
    return chosen, sum(weight[k] for k in chosen)


def threshold_cost(small: DataFrame, big: DataFrame, row_id: str, label: str, callbacks: Callbacks, least: float, small_cost: float, total_cost: float) -> tuple[float, float]:
    """(threshold, expected cost) of the cheapest threshold whose combined predictions still score over ``least``."""
    joined = small.join(big.select(row_id, F.col("predict").alias("_big")), row_id).persist(StorageLevel.MEMORY_AND_DISK)
    sure = joined.agg(*[F.avg((tri_state(F.col("predict_proba"), t) != UNSURE).cast("double")).alias(str(i)) for i, t in enumerate(THRESHOLDS)]).first()
    found = (1.0, total_cost)
    for i, t in enumerate(THRESHOLDS):
        state = tri_state(F.col("predict_proba"), t)
        mixed = joined.withColumn("predict", F.when(state == UNSURE, F.col("_big")).otherwise(state.cast("double")))
        cost = sure[i] * small_cost + (1 - sure[i]) * total_cost
        if cost < found[1] and callbacks.score(mixed, label) > least:
            found = (t, cost)
    joined.unpersist()
    return found


def train_cascade(rows: DataFrame, plan: FeaturePlan, label: str, callbacks: Callbacks, seed: int = 42) -> Cascade:
    """Splits, fits, searches all cutoffs and thresholds, and fits both models anew on all rows. The callbacks see the row id, the label and the features."""
    with Features(rows, plan, label) as data:
        train, valid = hash_split(data, plan.row_id, 75, seed)
        every = plan.columns()
        model = callbacks.train(train, every, label)
        predicted = callbacks.predict(model, valid).persist(StorageLevel.MEMORY_AND_DISK)
        base = callbacks.score(predicted, label)
        values, costs = importances(valid, plan, callbacks, model, label, seed), plan.costs(rows)
        best: tuple[float, float, float, list[str]] | None = None
        tried: set[tuple[str, ...]] = set()
        for cutoff in CUTOFFS:
            chosen, cost = knapsack(values, costs, cutoff)
            if not chosen or tuple(chosen) in tried:
                continue
            tried.add(tuple(chosen))
            small = callbacks.train(train, plan.columns(chosen), label)
            threshold, expected = threshold_cost(callbacks.predict_proba(small, valid), predicted, plan.row_id, label, callbacks, base - LOSS_BUDGET, cost, 1000)
            if best is None or expected < best[0]:
                best = expected, threshold, cutoff, chosen
        if best is None:  # no group is cheap enough: the full model answers every row
            best = 1000.0, 1.0, 1.0, [g.name for g in plan.groups]
        _, threshold, cutoff, chosen = best
        rest = [c for c in every if c not in plan.columns(chosen)]
        out = Cascade(chosen, threshold, cutoff, callbacks.train(data, plan.columns(chosen), label), callbacks.train(data, [*plan.columns(chosen), *rest], label), values, costs)
        predicted.unpersist()
        return out


def ratio_search(small: np.ndarray, big: np.ndarray, k: int, seed: int = 42) -> tuple[int, float, float] | None:
    """(ratio, mean sample size, mean k) of the smallest ratio with ``PRECISION`` in ``NEEDED`` of ``SAMPLES`` samples of a quarter of the rows."""
    n = len(small)
    rng = np.random.default_rng(seed)
    size = max(1, n // 4)
    own_k = max(1, round(k * size / n)) if n else 1
    samples = [rng.choice(n, size, replace=False) for _ in range(SAMPLES)]
    tops = [(s[np.argsort(-big[s], kind="stable")[:own_k]], s[np.argsort(-small[s], kind="stable")]) for s in samples]
    for ratio in [*range(1, 100), *range(101, max(102, size // own_k + 1), 10)]:
        good = sum(len(np.intersect1d(top, order[: own_k * ratio])) / own_k >= PRECISION for top, order in tops)
        if good >= NEEDED:
            return ratio, float(size), float(own_k)
    return None


def in_sample(hashes: np.ndarray, i: int) -> np.ndarray:
    """Which rows, given by 64-bit hashes, are in sample ``i`` of a quarter."""
    z = hashes.astype(np.uint64) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
    return (z ^ z >> np.uint64(31)) >> np.uint64(62) == 0


def _sample_counts(scores: DataFrame, cuts: list[tuple[float, int]] | None = None) -> np.ndarray:
    """The rows of each sample and of all (last); with ``cuts`` only rows that come before the sample's (small score, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SAMPLES + 1, np.int64)
        for b in batches:
            h, small = b.column("h").to_numpy(), b.column("small").to_numpy()
            total[-1] += len(h)
            for i in range(SAMPLES):
                chosen = in_sample(h, i)
                if cuts is not None:
                    chosen &= (small > cuts[i][0]) | ((small == cuts[i][0]) & (h < cuts[i][1]))
                total[i] += np.count_nonzero(chosen)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SAMPLES + 1)), pa.array(total)], ["i", "n"])

    counts = np.zeros(SAMPLES + 1, np.int64)
    for r in scores.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r["i"]] = r["n"]
    return counts


def ratio_search_rows(both: DataFrame, row_id: str, small: str, big: str, k: int, seed: int = 42) -> tuple[int, float, float] | None:
    """As ``ratio_search``, with samples of all rows of a table and of any size.

    A sample's rows are chosen by a hash. Its best rows by the big score are the first of its rows among the best of all, of which only
    somewhat more than ``k`` come to the driver. The ratio it needs follows from the place, by the small score, of the last row that
    ``PRECISION`` asks for, and that place is counted over all rows.
    """
    least = F.lit(float("-inf"))
    scores = both.select(F.xxhash64(row_id, F.lit(seed), F.lit("ratio")).alias("h"), *[F.nanvl(F.coalesce(F.col(c).cast("double"), least), least).alias(n) for c, n in ((small, "small"), (big, "big"))])
    scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
    *sizes, n = _sample_counts(scores).tolist()
    if not n:
        scores.unpersist()
        return None
    own_k = [max(1, round(k * size / n)) for size in sizes]
    wanted = k + 10 * math.isqrt(k) + 100
    while True:
        head = scores.orderBy(F.desc("big"), "h").limit(wanted).toArrow()
        h, s = head.column("h").to_numpy(), head.column("small").to_numpy()
        places = [np.flatnonzero(in_sample(h, i))[: own_k[i]] for i in range(SAMPLES)]
        if wanted >= n or all(len(p) == own_k[i] for i, p in enumerate(places)):
            break
        wanted *= 2
    cuts, able = [], np.zeros(SAMPLES, bool)
    for i, p in enumerate(places):
        last = math.ceil(PRECISION * own_k[i] - 1e-9) - 1
        able[i] = last < len(p)
        at = p[np.lexsort((h[p], -s[p]))[last]] if able[i] else 0
        cuts.append((float(s[at]), int(h[at])))
    depth = _sample_counts(scores, cuts)[:-1]
    scores.unpersist()
    size, mean_k = float(np.mean(sizes)), float(np.mean(own_k))
    for ratio in [*range(1, 100), *range(101, max(102, int(size / mean_k) + 1), 10)]:
        if np.count_nonzero(able & (depth < np.array(own_k) * ratio)) >= NEEDED:
            return ratio, size, mean_k
    return None


def train_top_k(rows: DataFrame, plan: FeaturePlan, label: str, callbacks: Callbacks, k: int, seed: int = 42) -> Cascade:
    """As ``train_cascade`` for approximate top-K. The ratio search reads the two scores of all validation rows."""
    with Features(rows, plan, label) as data:
        train, valid = hash_split(data, plan.row_id, 50, seed)
        every = plan.columns()
        model = callbacks.train(train, every, label)
        values, costs = importances(valid, plan, callbacks, model, label, seed), plan.costs(rows)
        full = callbacks.predict_proba(model, valid).select(plan.row_id, F.col("predict_proba").alias("_big"))
        best = None
        tried: set[tuple[str, ...]] = set()
        for cutoff in CUTOFFS:
            chosen, cost = knapsack(values, costs, cutoff)
            if not chosen or tuple(chosen) in tried:
                continue
            tried.add(tuple(chosen))
            small = callbacks.train(train, plan.columns(chosen), label)
            both = callbacks.predict_proba(small, valid).select(plan.row_id, "predict_proba").join(full, plan.row_id)
            found = ratio_search_rows(both, plan.row_id, "predict_proba", "_big", k, seed)
            if found is None:
                continue
            ratio, n, own_k = found
            expected = cost * n + (1000 - cost) * min(n, ratio * own_k)
            if best is None or expected < best[0]:
                best = expected, cutoff, chosen, ratio
        if best is None:
            best = 0.0, 1.0, [g.name for g in plan.groups], 1
        _, cutoff, chosen, ratio = best
        rest = [c for c in every if c not in plan.columns(chosen)]
        return Cascade(chosen, 1.0, cutoff, callbacks.train(data, plan.columns(chosen), label), callbacks.train(data, [*plan.columns(chosen), *rest], label), values, costs, ratio)
