"""Element-wise arithmetic, stacking of blocks and linear scoring.

Sparse blocks are long tables (row_id, idx, value); dense ones are array columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import bounded


def binop(a: Column, op: str, b: Column, kind: str = "double") -> Column:
    """Both sides are cast first; division by 0 gives null."""
    a, b = a.cast(kind), b.cast(kind)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[op]()


def vector_binop(a: Column, op: str, b: Column, kind: str = "double") -> Column:
    """The same for two array columns, element by element."""
    return F.zip_with(a, b, lambda x, y: binop(x, op, y, kind))


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded as SQL engines in binary arithmetic do: scaled, to the nearest whole number with halves away from 0, scaled back.

    What rounds to 0 keeps its sign, so -0.0 stays apart from 0.0; what the scale makes infinite stays as it is.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    scaled = c * F.lit(10.0**digits)
    size = F.abs(scaled)
    whole = F.rint(size) + (size - F.rint(size) == 0.5).cast("double")
    return F.when(size == float("inf"), c).otherwise(F.signum(scaled) * whole / F.lit(10.0**digits))


def dense(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def stack_dense(*blocks: Column) -> Column:
    return F.concat(*blocks)


def reshape(vector: Column, width: int) -> Column:
    """Rows of ``width`` elements."""
    starts = F.sequence(F.lit(0), F.size(vector) - width, F.lit(width))
    return F.transform(starts, lambda i: F.slice(vector, i + 1, width))


def stack_sparse(row_id: str, blocks: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Blocks of (table, width) side by side; indices move by the widths before them."""
    offset, parts = 0, []
    for block, width in blocks:
        parts.append(block.select(row_id, (F.col("idx") + offset).cast("int").alias("idx"), F.col("value").cast("double").alias("value")))
        offset += width
    return reduce(DataFrame.unionByName, parts)


def linear(weights: Mapping[str, float], intercept: float) -> Column:
    """The weighted sum of columns; null counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w)) for c, w in weights.items()], F.lit(float(intercept)))


def linear_vector(vector: Column, weights: Sequence[float], intercept: float) -> Column:
    products = F.zip_with(vector, F.lit([float(w) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(float(intercept)), lambda a, x: a + x)


def linear_sparse(rows: DataFrame, row_id: str, features: DataFrame, weights: DataFrame, intercept: float) -> DataFrame:
    """(row_id, score) for every row, also those without a feature. ``weights`` is (idx, weight), broadcast if its plan bounds it."""
    sums = features.join(bounded(weights), "idx").groupBy(row_id).agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    return rows.select(row_id).join(sums, row_id, "left").select(row_id, (F.coalesce("s", F.lit(0.0)) + float(intercept)).alias("score"))


def logistic(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def classify(score: Column) -> Column:
    return (score > 0).cast("int")


def pair_ratios(vector: Column, pairs: Sequence[tuple[int, int]]) -> Column:
    """a[i] / sqrt(a[j]) for many index pairs; null where a[j] is not positive."""
    table = F.lit([[i, j] for i, j in pairs])
    return F.transform(table, lambda p: F.when(F.get(vector, p[1]) > 0, F.get(vector, p[0]) / F.sqrt(F.get(vector, p[1]))))
