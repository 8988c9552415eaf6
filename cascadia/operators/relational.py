"""Lookups, star joins and the group features that pipelines feed to a model.

Joins carry no broadcast hint: the optimizer broadcasts a side whose size is under the session's threshold and
shuffles otherwise, so the same plan holds when a lookup table outgrows memory.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from .ranks import running_totals

AGGREGATES = {
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


def lookup_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], on_duplicate: str = "sum", suffix: str | None = None) -> DataFrame:
    """Left join that keeps exactly one row for each left row; numeric columns of missing matches are 0, others null.

    ``on_duplicate`` is what repeated right keys do: "sum" adds their numeric columns (others keep their smallest
    value), "error" fails when the query runs, "fanout" repeats the left row. Null keys match nothing.
    """
    keys = [on] if isinstance(on, str) else list(on)
    values = [c for c in right.columns if c not in keys]
    if clash := [c for c in values if c in left.columns]:
        if suffix is None:
            raise ValueError(f"columns on both sides: {clash}; give a suffix")
        right = right.withColumnsRenamed({c: c + suffix for c in clash})
        values = [c for c in right.columns if c not in keys]
    numeric = numeric_columns(right, keys)
    for k in keys:
        right = right.withColumn(k, F.col(k).cast(left.schema[k].dataType))
    if on_duplicate == "sum":
        right = right.groupBy(*keys).agg(*[(F.sum(c).cast(right.schema[c].dataType) if c in numeric else F.min(c)).alias(c) for c in values])
    elif on_duplicate == "error":
        one = F.when(F.count("*") > 1, F.raise_error(F.lit(f"repeated key in {keys}"))).otherwise(F.lit(True))
        checked = right.groupBy(*keys).agg(one.alias("_one"), *[F.min(c).alias(c) for c in values])
        right = checked.where("_one").drop("_one")
    elif on_duplicate != "fanout":
        raise ValueError(on_duplicate)
    return left.join(right, keys, "left").fillna(0, subset=numeric).select(*left.columns, *values)


def star_join(base: DataFrame, lookups: Sequence[tuple[DataFrame, str | Sequence[str]]]) -> DataFrame:
    """Chained lookups; one may use a column that an earlier one brought."""
    return reduce(lambda df, r: lookup_join(df, *r), lookups, base)


def join_order(base_columns: Sequence[str], lookups: Sequence[tuple[Sequence[str], Sequence[str]]]) -> list[int]:
    """An order of (keys, columns brought) in which every key is there when it is used."""
    have, left, order = set(base_columns), list(range(len(lookups))), []
    while left:
        ready = [i for i in left if set(lookups[i][0]) <= have]
        if not ready:
            raise ValueError(f"no table brings the keys of {[lookups[i][0] for i in left]}")
        order.append(ready[0])
        have |= set(lookups[ready[0]][1])
        left.remove(ready[0])
    return order


def independent_lookups(base_columns: Sequence[str], lookups: Sequence[tuple[Sequence[str], Sequence[str]]]) -> list[bool]:
    """Which lookups need the base table's columns alone."""
    return [set(keys) <= set(base_columns) for keys, _ in lookups]


def select_columns(names: Sequence[str], *frames: DataFrame, row_id: str) -> DataFrame:
    """Named columns; the first frame that has a name gives it. Frames are matched by ``row_id``."""
    wanted: dict[int, list[str]] = {}
    for name in names:
        wanted.setdefault(next(i for i, f in enumerate(frames) if name in f.columns), []).append(name)
    parts = [frames[i].select(row_id, *[c for c in cols if c != row_id]) for i, cols in sorted(wanted.items())]
    joined = reduce(lambda a, b: a.join(b, row_id, "inner"), parts)
    return joined.select(row_id, *[c for c in names if c != row_id])


def hconcat(row_id: str, *frames: DataFrame) -> DataFrame:
    """Columns side by side, matched by ``row_id``."""
    return reduce(lambda a, b: a.join(b, row_id, "inner"), frames)


def vconcat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def one_row(df: DataFrame, key: str, value: object) -> DataFrame:
    """A point query's row."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def agg_features(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Sequence[str]], prefix: str, size: str | None = None) -> DataFrame:
    """Columns PREFIX_COLUMN_AGGREGATE, and the group's rows as PREFIX_``size``; null keys form no group, NaN counts as null."""
    types = dict(df.dtypes)
    kept = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    out = []
    for column, names in aggregates.items():
        c = F.nanvl(F.col(column), F.lit(None)) if types[column] in ("double", "float") else F.col(column)
        out += [AGGREGATES[n](c).alias(f"{prefix}_{column}_{n}".upper()) for n in names]
    if size:
        out.append(F.count(F.lit(1)).alias(f"{prefix}_{size}".upper()))
    return kept.groupBy(*keys).agg(*out)


def share(column: Column, value: object) -> Column:
    """The mean of a one-hot column, without making it; null is another value."""
    return F.avg(F.when(column.eqNullSafe(F.lit(value)), 1.0).otherwise(0.0))


def only(condition: Column, column: Column) -> Column:
    """The column where the condition holds, for filtered aggregates in one pass."""
    return F.when(condition, column)


def one_hot(df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """A 0/1 column for each value, in order of value, and COLUMN_nan for null. A table can't have columns without end: over ``most`` values take ``one_hot_sparse``."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values; one_hot_sparse takes any number")
    made = {f"{column}_{v}": F.col(column).eqNullSafe(F.lit(v)).cast("int") for v in sorted(values)}
    return df.withColumns(made | {f"{column}_nan": F.col(column).isNull().cast("int")})


def one_hot_sparse(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(row_id, idx, value): the same block in long form for any number of values. idx is 0 for null, and 1 and up in order of value."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1))
    codes = running_totals(values, column, "_one", "idx").drop("_one")
    return df.select(row_id, column).join(codes, column, "left").select(row_id, F.coalesce("idx", F.lit(0)).alias("idx"), F.lit(1).alias("value"))


def factorize(df: DataFrame, column: str, row_id: str, out: str) -> DataFrame:
    """Codes from 0 in order of each value's first row; null is -1. The distinct values are ranked, not the rows, range by range."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("_first")).withColumn("_one", F.lit(1))
    codes = running_totals(first, "_first", "_one", out, [column]).select(column, (F.col(out) - 1).alias(out))
    return df.join(codes, column, "left").fillna(-1, subset=[out])


def nullify(df: DataFrame, column: str, sentinel: object) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(sentinel)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def clamp_zero(c: Column) -> Column:
    """Negative, null and NaN become 0."""
    return F.when((c > 0) & ~F.isnan(c.cast("double")), c).otherwise(F.lit(0).cast("double"))


def not_equal(c: Column, value: object) -> Column:
    """True for null too."""
    return ~c.eqNullSafe(F.lit(value))


def text_concat(*columns: Column, separator: str = " ") -> Column:
    """Null is empty and keeps its separator."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(separator)] * bool(parts) + [F.coalesce(c, F.lit(""))]
    return F.concat(*parts)


def popularity_features(df: DataFrame, key: str, positive: Column, prefix: str) -> DataFrame:
    """How often each key occurs, how often positively, and both against the most frequent key and all rows.

    The totals are one row joined to the groups.
    """
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(positive.cast("int")).alias("pos"))
    totals = groups.agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.max("pos").alias("most_pos"))
    joined = groups.crossJoin(F.broadcast(totals))  # an aggregate without keys: one row
    return joined.select(
        key,
        F.col("n").cast("float").alias(f"{prefix}_played"),
        F.col("pos").cast("float").alias(f"{prefix}_played_pos"),
        (F.col("n") / F.col("most")).cast("float").alias(f"{prefix}_played_rel"),
        (F.col("n") / F.col("all")).cast("float").alias(f"{prefix}_played_rel_global"),
        F.try_divide(F.col("pos"), F.col("most_pos")).cast("float").alias(f"{prefix}_played_pos_rel"),
        (F.col("pos") / F.col("n")).cast("float").alias(f"{prefix}_played_ratio"),
    )


def cast_all(df: DataFrame, kind: str, without: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in without else F.col(f"`{c}`").cast(kind).alias(c) for c in df.columns])


def digest(c: Column, seed: int) -> Column:
    """32 hex digits of a value as text and a seed; null counts as empty. Any engine can work them out."""
    return F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(f":{seed}")))


def digest_bucket(c: Column, seed: int, buckets: Column | int) -> Column:
    """A bucket number from the first eight digits."""
    return F.conv(F.substring(digest(c, seed), 1, 8), 16, 10).cast("long") % buckets


def hash_split(df: DataFrame, row_id: str, percent: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the id: the same rows on every run and every cluster."""
    part = digest_bucket(F.col(row_id), seed, 100)
    return df.where(part < percent), df.where(part >= percent)
