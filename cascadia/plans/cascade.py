"""Cascades: a cheap model answers confident rows, the full one the rest; and approximate top-K by pruning.

Rows are filtered before the remaining features are built, never guarded inside an expression, so features of
confident rows are not computed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.models import Callbacks, LinearModel
from .plan import FeaturePlan

UNSURE = 2


@dataclass
class Cascade:
    """What training finds: the groups of the small model, the threshold or top-K ratio, and both models."""

    important: list[str]
    threshold: float
    cost_cutoff: float
    small_model: object
    big_model: object
    importances: dict[str, float]
    costs: dict[str, float]
    ratio: int | None = None

    def settings(self) -> dict:
        return {k: v for k, v in asdict(self).items() if not k.endswith("_model")}


def tri_state(p: Column, threshold: float) -> Column:
    """1 or 0 where the model is sure, else 2. Both comparisons are strict; null is unsure."""
    return F.when(p > threshold, 1).when(p < 1 - threshold, 0).otherwise(UNSURE)


def combine(small: DataFrame, big: DataFrame, row_id: str, label: str, kind: str) -> DataFrame:
    """Small labels where they are sure; big ones by id for the rest."""
    sure = small.where(F.col(label) != UNSURE).select(row_id, F.col(label).cast(kind).alias(label))
    return sure.unionByName(big.select(row_id, F.col(label).cast(kind).alias(label)))


def linear_callbacks(score: Callable[[DataFrame, str], float] | None = None) -> Callbacks:
    """Callbacks of fixed linear models: scoring is one expression."""

    def missing(*_) -> object:
        raise NotImplementedError("fixed coefficients are not trained")

    return Callbacks(missing, lambda m, df: df.withColumn("predict", m.label()), lambda m, df: df.withColumn("predict_proba", m.proba()), score or missing)


class CascadeExecutor:
    def __init__(self, plan: FeaturePlan, callbacks: Callbacks, cascade: Cascade, threshold: float | None = None):
        self.plan, self.callbacks, self.cascade, self.held = plan, callbacks, cascade, []
        self.threshold = cascade.threshold if threshold is None else threshold

    def hold(self, df: DataFrame) -> DataFrame:
        """Stores a frame that more than one branch reads, on executors' disks where memory is short; a lost copy is computed again."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def release(self) -> None:
        """Frees what is stored; frames made before stay right, but are computed anew."""
        while self.held:
            self.held.pop().unpersist()

    def __enter__(self) -> CascadeExecutor:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def small(self, rows: DataFrame) -> DataFrame:
        """The rows with the important features and the small model's probability."""
        return self.callbacks.predict_proba(self.cascade.small_model, self.plan.build(rows, self.cascade.important))

    def big(self, rows: DataFrame) -> DataFrame:
        """row_id, predict for rows that may have some features already."""
        return self.callbacks.predict(self.cascade.big_model, self.plan.build(rows)).select(self.plan.row_id, "predict")

    def labelled(self, rows: DataFrame) -> DataFrame:
        return self.small(rows).withColumn("small_label", tri_state(F.col("predict_proba"), self.threshold))

    def batch(self, rows: DataFrame, keep: bool = True, detail: bool = False) -> DataFrame:
        """row_id, predict (and answered_by) for each row. At a threshold of 1 no probability is sure and the full model answers alone. ``keep`` stores the small model's result, which both branches read, until ``release``."""
        if self.threshold >= 1:
            every = self.big(rows).withColumn("predict", F.col("predict").cast("double"))
            return every.withColumn("answered_by", F.lit("big")) if detail else every
        scored = self.hold(self.labelled(rows)) if keep else self.labelled(rows)
        hard = scored.where(F.col("small_label") == UNSURE).drop("predict_proba", "small_label")
        big = self.big(hard)
        sure = scored.where(F.col("small_label") != UNSURE).select(self.plan.row_id, F.col("small_label").cast("double").alias("predict"))
        if detail:
            sure, big = sure.withColumn("answered_by", F.lit("small")), big.withColumn("answered_by", F.lit("big"))
        return sure.unionByName(big.withColumn("predict", F.col("predict").cast("double")))

    def point(self, row: DataFrame) -> DataFrame:
        """One row; the full plan isn't even started where the small model is sure."""
        scored = self.hold(self.labelled(row))
        found = scored.select("small_label").first()
        if found is None or found[0] != UNSURE:
            return scored.select(self.plan.row_id, F.col("small_label").cast("double").alias("predict"))
        return self.big(scored.drop("predict_proba", "small_label")).withColumn("predict", F.col("predict").cast("double"))

    def top_k(self, rows: DataFrame, k: int, ratio: int | None = None) -> DataFrame:
        """row_id, score: pruned rows score 0, candidates get the full model's probability."""
        scored = self.hold(self.small(rows))
        chosen = candidates(scored, "predict_proba", self.plan.row_id, k * (ratio or self.cascade.ratio or 1))
        full = self.callbacks.predict_proba(self.cascade.big_model, self.plan.build(chosen.drop("predict_proba")))
        rest = scored.join(chosen.select(self.plan.row_id), self.plan.row_id, "left_anti")
        return full.select(self.plan.row_id, F.col("predict_proba").alias("score")).unionByName(rest.select(self.plan.row_id, F.lit(0.0).alias("score")))


def candidates(scored: DataFrame, score: str, row_id: str, wanted: int) -> DataFrame:
    """All rows that score at least as the ``wanted``-th best; ties stay, so there may be more."""
    from ..operators.ranks import top_k

    least = top_k(scored.select(row_id, score), score, row_id, wanted).agg(F.min(score).alias("_least"))
    return scored.crossJoin(F.broadcast(least)).where(F.col(score) >= F.col("_least")).drop("_least")  # one row


def fixed(small: LinearModel, big: LinearModel, important: Sequence[str], threshold: float, ratio: int | None = None) -> Cascade:
    return Cascade(list(important), threshold, 0.0, small, big, {}, {}, ratio)
