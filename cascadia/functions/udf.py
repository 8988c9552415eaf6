"""Host functions over keys: computed once for each different argument, or with overlapping calls.

Functions must be pure: a retried task calls them again. They get plain Python values, None for null. Each mapped table takes one Python process
of a task; pandas is loaded there only for functions of whole columns.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

if TYPE_CHECKING:
    import pandas as pd


class Cache:
    """Least recently used results, ``most`` at most; None: no bound."""

    def __init__(self, f: Callable, most: int | None = None):
        self.f, self.most, self.held, self.calls = f, most, OrderedDict(), 0

    def __call__(self, *args):
        if args in self.held:
            self.held.move_to_end(args)
            return self.held[args]
        self.calls += 1
        out = self.held[args] = self.f(*args)
        if self.most is not None and len(self.held) > self.most:
            self.held.popitem(last=False)
        return out


def cached_map(df: DataFrame, f: Callable, inputs: Sequence[str], out: str, kind: str) -> DataFrame:
    """``f`` of the input columns, called once for each different combination in the whole table.

    Arguments are made distinct, computed, and joined back null-safely; a hot combination is one row of the small side.
    """
    keys = [f"_k{i}" for i in range(len(inputs))]
    distinct = df.select(*[F.col(c).alias(k) for c, k in zip(inputs, keys)]).distinct()
    return df.join(_mapped(distinct, f, keys, out, kind, None), [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(inputs, keys)], "left").drop(*keys)


def async_map(df: DataFrame, f: Callable, inputs: Sequence[str], out: str, kind: str, threads: int = 10) -> DataFrame:
    """``f`` of the input columns, ``threads`` calls at a time in each task: for functions that wait."""
    return _mapped(df, f, inputs, out, kind, threads)


def lru_map(df: DataFrame, f: Callable, inputs: Sequence[str], out: str, kind: str, most: int | None = None, whole: Mapping[str, tuple[Callable[[pd.Series], pd.Series], str, str]] | None = None) -> DataFrame:
    """``f`` of the input columns with a cache for each task. ``whole`` adds functions of whole columns, as name: (function, input, type), in the same process."""
    return _mapped(df, f, inputs, out, kind, None, most or 1 << 16, whole)


def _mapped(
    df: DataFrame, f: Callable, inputs: Sequence[str], out: str, kind: str, threads: int | None, cache: int | None = None, whole: Mapping[str, tuple[Callable[[pd.Series], pd.Series], str, str]] | None = None
) -> DataFrame:
    types, whole, inputs = dict(df.dtypes), dict(whole or {}), list(inputs)
    kinds = {out: kind} | {name: own for name, (_, _, own) in whole.items()}
    schema = ", ".join(f"`{c}` {t}" for c, t in [*((c, types[c]) for c in df.columns), *kinds.items()])
    arrow = {c: to_arrow_type(DataType.fromDDL(t)) for c, t in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = Cache(f, cache) if cache else f
        pool = ThreadPoolExecutor(threads) if threads else None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in inputs)))
                values = pool.map(lambda r: call(*r), rows) if pool else (call(*r) for r in rows)
                made = [pa.array(list(values), arrow[out])]
                for name, (g, c, _) in whole.items():
                    made.append(pa.array(g(batch.column(c).to_pandas()), arrow[name], from_pandas=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *kinds])
        finally:
            if pool:
                pool.shutdown()

    return df.mapInArrow(run, schema)


def vectorized(f: Callable[[pd.Series], pd.Series], kind: str) -> Callable[..., Column]:
    """A function of whole columns of a batch."""
    return F.pandas_udf(f, kind)
