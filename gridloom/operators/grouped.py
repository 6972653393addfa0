"""Groups of a frame's rows and their aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ieee import is_number, nan_max, nan_min

FUNCTIONS = {"sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "count": F.count}


def _aggregate(func: Callable[[pd.Series], float]):
    def run(values: pd.Series) -> float:
        return func(values)

    # types as objects: pandas_udf reads them, and can't read this module's postponed ones
    run.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(run, "double")


class GroupBy:
    """Numeric columns only in sum, mean, std, min and max; results keep their columns' names; keys keep their type."""

    def __init__(self, frame, by: list[str]):
        self.frame, self.df, self.by = frame, frame.df, by

    def _numeric(self, make: Callable[[str, object], Column]) -> DataFrame:
        fields = [f for f in self.df.schema if f.name not in self.by and is_number(f.dataType)]
        if not fields:
            return self.df.select(*self.by).distinct()
        return self.df.groupBy(*self.by).agg(*[make(f.name, f.dataType).alias(f.name) for f in fields])

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.count(F.lit(1)).alias("count"))

    def sum(self) -> DataFrame:
        return self._numeric(lambda c, k: F.sum(c))

    def mean(self) -> DataFrame:
        return self._numeric(lambda c, k: F.avg(c))

    def std(self) -> DataFrame:
        """Of the population."""
        return self._numeric(lambda c, k: F.stddev_pop(c))

    def min(self) -> DataFrame:
        return self._numeric(lambda c, k: nan_min(F.col(c), k))

    def max(self) -> DataFrame:
        return self._numeric(lambda c, k: nan_max(F.col(c), k))

    def agg(self, *pairs: tuple[str, str] | Column) -> DataFrame:
        """By columns, or by (column, function) pairs named column_function; several keys are fine."""
        return self.df.groupBy(*self.by).agg(*[p if isinstance(p, Column) else FUNCTIONS[p[1]](p[0]).alias(f"{p[0]}_{p[1]}") for p in pairs])

    def apply(self, func: Callable[[pd.Series], float]) -> DataFrame:
        """A function of one group's values of one column, for every other column, as doubles. Each group is one task's batch: prefer agg()."""
        names = [c for c in self.df.columns if c not in self.by]
        return self.df.groupBy(*self.by).agg(*[_aggregate(func)(F.col(c)).alias(c) for c in names])

    def _edge(self, pick) -> DataFrame:
        rest = [c for c in self.df.columns if c not in self.by]
        order = F.struct(*self.frame._ordered())
        return self.df.groupBy(*self.by).agg(pick(F.struct(*rest), order).alias("_row")).select(*[F.col(c) if c in self.by else F.col(f"_row.{c}") for c in self.df.columns])

    def first(self) -> DataFrame:
        """Each group's first row in the frame's order; partial aggregation, no sort."""
        return self._edge(F.min_by)

    def last(self) -> DataFrame:
        return self._edge(F.max_by)

    def size(self) -> dict:
        """Group sizes on the driver, by key; a frame of them is count()."""
        return {r[0] if len(self.by) == 1 else tuple(r[: len(self.by)]): r["count"] for r in self.count().collect()}

    def get_group(self, *key):
        """The rows of one group; None if there are none."""
        cond = None
        for c, v in zip(self.by, key, strict=True):
            cond = F.col(c).eqNullSafe(F.lit(v)) if cond is None else cond & F.col(c).eqNullSafe(F.lit(v))
        found = self.frame.filter(cond)
        return None if found.is_empty() else found
