"""A feature plan: named groups of columns over one row id, and the model that reads them."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FeatureGroup:
    """``build`` adds ``columns`` to the rows it is given, one row out for each row in.

    Because it is given rows, a plan can shorten them first: nothing is computed for a row that needs no more features.
    ``cost`` is seconds or any other unit; None: measured.
    """

    name: str
    build: Callable[[DataFrame], DataFrame]
    columns: Sequence[str]
    cost: float | None = None


@dataclass(frozen=True)
class FeaturePlan:
    row_id: str
    groups: Sequence[FeatureGroup] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        columns = self.columns()
        if len(set(columns)) != len(columns):
            raise ValueError("two groups give the same column")

    def group(self, name: str) -> FeatureGroup:
        return next(g for g in self.groups if g.name == name)

    def columns(self, names: Iterable[str] | None = None) -> list[str]:
        return [c for g in self.groups if names is None or g.name in set(names) for c in g.columns]

    def build(self, rows: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """The rows with the columns of the named groups; columns they already have are not built again."""
        chosen = None if names is None else set(names)
        for g in self.groups:
            if (chosen is None or g.name in chosen) and not set(g.columns) <= set(rows.columns):
                rows = g.build(rows)
        return rows

    def costs(self, rows: DataFrame, repeats: int = 3) -> dict[str, float]:
        """Declared costs, or the median seconds of building a group alone and throwing it away."""

        def seconds(g: FeatureGroup) -> float:
            took = []
            for _ in range(repeats):
                start = time.perf_counter()
                g.build(rows).select(self.row_id, *g.columns).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - start)
            return statistics.median(took)

        return {g.name: float(g.cost) if g.cost is not None else seconds(g) for g in self.groups}
