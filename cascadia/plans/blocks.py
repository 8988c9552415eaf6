"""Cascades over sparse blocks: text features and other columns stacked in long form (row_id, idx, value).

A block is built for the rows it is given. The small model reads the cheap blocks of all rows; the other blocks are built for unsure rows only
and stacked beside the cheap ones, which aren't built again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..operators.linalg import classify, linear_sparse, logistic
from .cascade import UNSURE, tri_state


@dataclass(frozen=True)
class Block:
    """``build`` gives (row_id, idx, value) of the rows it is given; idx is below ``width``."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    width: int


@dataclass(frozen=True)
class BlockPlan:
    row_id: str
    blocks: Sequence[Block]

    def stack(self, rows: DataFrame, names: Iterable[str]) -> DataFrame:
        """The named blocks at their places in the whole vector, so parts of it that are built apart fit together."""
        chosen, offset, out = set(names), 0, None
        for block in self.blocks:
            if block.name in chosen:
                part = block.build(rows).select(self.row_id, (F.col("idx") + offset).cast("int").alias("idx"), F.col("value").cast("double").alias("value"))
                out = part if out is None else out.unionByName(part)
            offset += block.width
        if out is None:
            raise ValueError("no such block")
        return out


@dataclass(frozen=True)
class SparseModel:
    """(idx, weight) over the whole vector, and an intercept."""

    weights: DataFrame
    intercept: float


class BlockCascade:
    def __init__(self, plan: BlockPlan, cheap: Sequence[str], small: SparseModel, big: SparseModel, threshold: float):
        self.plan, self.cheap, self.small, self.big, self.threshold, self.held = plan, list(cheap), small, big, threshold, []

    def _hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def batch(self, rows: DataFrame) -> DataFrame:
        """row_id, predict, answered_by for each row; ids must be unique. At a threshold of 1 no probability is sure and the full model answers alone."""
        key, rest = self.plan.row_id, [b.name for b in self.plan.blocks if b.name not in self.cheap]
        if self.threshold >= 1:
            every = linear_sparse(rows, key, self.plan.stack(rows, [*self.cheap, *rest]), self.big.weights, self.big.intercept)
            return every.select(key, classify(F.col("score")).alias("predict"), F.lit("big").alias("answered_by"))
        features = self._hold(self.plan.stack(rows, self.cheap))
        scored = linear_sparse(rows, key, features, self.small.weights, self.small.intercept)
        state = self._hold(scored.select(key, tri_state(logistic(F.col("score")), self.threshold).alias("state")))
        unsure = state.where(F.col("state") == UNSURE).select(key)
        # stored, so that no filter of a block is pushed to rows that are sure
        hard = self._hold(rows.join(unsure, key, "left_semi"))
        more = features.join(unsure, key, "left_semi").unionByName(self.plan.stack(hard, rest))
        answered = linear_sparse(hard, key, more, self.big.weights, self.big.intercept)
        big = answered.select(key, classify(F.col("score")).alias("predict"), F.lit("big").alias("answered_by"))
        return state.where(F.col("state") != UNSURE).select(key, F.col("state").alias("predict"), F.lit("small").alias("answered_by")).unionByName(big)
