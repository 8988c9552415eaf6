"""Quality metrics as one distributed aggregate each."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F


def auc_frame(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``auc``: the rank-sum statistic with average ranks for ties.

    Only different scores are sorted by rank: rows are counted by score first, and the running counts are of ranges
    of scores and then within each range, so no single task orders them all.
    """
    return _auc_of(_score_counts(df, label, score))


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s"))
    return counts.agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def _auc_of(counts: DataFrame) -> DataFrame:
    from ..operators.ranks import running_totals

    run = running_totals(counts, "s", "neg", "below")
    total = run.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0)).alias("u"))
    return total.select(F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc"))


def auc(df: DataFrame, label: str, score: str) -> float:
    """The value of ``auc_frame``. Counts are stored meanwhile, so the rows are scored once."""
    counts = _score_counts(df, label, score).persist(StorageLevel.MEMORY_AND_DISK)
    value = _auc_of(counts).first()[0]
    counts.unpersist()
    return float("nan") if value is None else float(value)


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def rmsle(y: Column, p: Column) -> Column:
    """Predictions below 0 count as 0."""
    d = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(y)
    return F.sqrt(F.avg(d * d))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def percentiles(c: Column, shares: list[float]) -> Column:
    return F.percentile(c, F.lit(shares))


def precision_at_k(found: DataFrame, true: DataFrame, row_id: str, k: int) -> DataFrame:
    """One row ``precision``: the share of the true top k that was found."""
    return found.join(true.select(row_id), row_id, "left_semi").agg((F.count(F.lit(1)) / F.lit(float(k))).alias("precision"))
