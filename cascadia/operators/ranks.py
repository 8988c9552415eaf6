"""Running totals and top rows without sorting everything in one task, and the check that a side may be broadcast."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MOST_BROADCAST = 1_000_000


def most_rows(df: DataFrame) -> int | None:
    """The number of rows that the plan proves there are no more than; None: it proves nothing."""
    rows = df._jdf.queryExecution().optimizedPlan().maxRows()
    return int(rows.get()) if rows.isDefined() else None


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The table with a broadcast hint if its plan proves that it has no more than ``most`` rows; else as it is, for the optimizer to join by its size."""
    rows = most_rows(df)
    return df if rows is None or rows > most else F.broadcast(df)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of the driver's rows, whose plan says how many they are."""
    return spark.createDataFrame(list(rows), schema).limit(len(rows))


def range_bounds(df: DataFrame, order: str, parts: int, each: int = 20) -> list:
    """Values that cut the order into up to ``parts`` ranges of about the same size. They come from the ``parts * each`` values with the smallest hash, so they are the same on every run."""
    drawn = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(parts * each)
    values = sorted(r[0] for r in drawn.collect() if r[0] == r[0])
    return values[each::each]


def range_number(c: Column, bounds: list) -> Column:
    """How many of the bounds, which are in order, are no larger than the value; 0 for null. Bounds are looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= c))

    coarse = passed(F.lit(bounds[::step]))
    at = (coarse - 1) * step
    return F.when(coarse == 0, 0).otherwise(at + passed(F.slice(F.lit(bounds), at + 1, F.lit(step))))


def running_totals(df: DataFrame, order: str, value: str, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """The sum of ``value`` over all rows up to and with each row, in order of ``order`` and then ``ties``, which together tell rows apart.

    Ranges are cut by fixed bounds first, and a row's range follows from its value alone, so the totals of the ranges (one row for each of them,
    summed up in a window of their own) and the running totals within them always speak of the same ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_range", range_number(F.col(order), range_bounds(df, order, parts)))
    starts = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each range, and no more ranges than partitions
    return ranged.withColumn("_own", F.sum(value).over(within)).join(F.broadcast(starts), "_range").withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def top_k(df: DataFrame, score: str, row_id: str, k: int) -> DataFrame:
    """The k rows with the largest score, ties by id: each task keeps k rows."""
    return df.orderBy(F.desc(score), row_id).limit(k)
