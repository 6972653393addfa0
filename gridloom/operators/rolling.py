"""Windows of a number of rows: rolling aggregates, shifts, changes and exponential weights."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.ieee import NAN, fill_of, ieee_div, is_float, is_number, nan_max, nan_min
from gridloom.plans.storage import with_ordinal

#: Rows of a block when windows aren't partitioned; blocks are windows of their own, with the rows before them repeated.
BLOCK_ROWS = 100_000


class RowWindow:
    """A window of ``size`` rows up to the current one. Expressions from its methods are added by with_column() or over().

    Rolling results are NaN until a window is full (``incomplete=None`` gives null instead). With partitions, the plan is one shuffle by
    their keys. Without, over() cuts the ordered rows into blocks and repeats the rows that reach into the next one,
    so that no task gets all rows.
    """

    def __init__(self, df: DataFrame, size: int, partition: Sequence[str] = (), order: Sequence = (), incomplete: float | None = NAN):
        if size < 1:
            raise ValueError("a window has at least one row")
        self.df, self.size, self.partition, self.order, self.incomplete = df, size, list(partition), list(order), incomplete
        #: Rows that the expressions made so far look back or ahead; infinite if they need all earlier rows.
        self.reach: float = 0

    def partition_by(self, *columns: str) -> RowWindow:
        return RowWindow(self.df, self.size, columns, self.order, self.incomplete)

    def order_by(self, column: str, ascending: bool = True) -> RowWindow:
        return RowWindow(self.df, self.size, self.partition, [F.col(column).asc() if ascending else F.col(column).desc()], self.incomplete)

    def fill_incomplete(self, value: float | None) -> RowWindow:
        return RowWindow(self.df, self.size, self.partition, self.order, value)

    def _spec(self):
        if not self.order:
            raise ValueError("windows need an order")
        return W.partitionBy(*self.partition).orderBy(*self.order)

    def _full(self, column: str, make: Callable) -> Column:
        if not is_float(self.df.schema[column].dataType):
            raise TypeError(f"{column} is not a float column")
        self.reach = max(self.reach, self.size - 1)
        w = self._spec().rowsBetween(-(self.size - 1), 0)
        return F.when(F.count(F.lit(1)).over(w) == self.size, make(w)).otherwise(F.lit(self.incomplete).cast("double"))

    def rolling_sum(self, column: str) -> Column:
        return self._full(column, lambda w: F.sum(column).over(w))

    def rolling_mean(self, column: str) -> Column:
        return self._full(column, lambda w: F.avg(column).over(w))

    def rolling_std(self, column: str) -> Column:
        """Of the population."""
        return self._full(column, lambda w: F.stddev_pop(column).over(w))

    def rolling_min(self, column: str) -> Column:
        return self._full(column, lambda w: nan_min(F.col(column), self.df.schema[column].dataType, lambda a: a.over(w)))

    def rolling_max(self, column: str) -> Column:
        return self._full(column, lambda w: nan_max(F.col(column), self.df.schema[column].dataType, lambda a: a.over(w)))

    def rolling_apply(self, column: str, f: Callable[[Column], Column]) -> Column:
        """A function of the array of a full window's values."""
        return self._full(column, lambda w: f(F.collect_list(column).over(w)))

    def _shift(self, column: str, k: int, shift) -> Column:
        self.reach = max(self.reach, abs(k))
        return shift(F.col(column), k, fill_of(self.df.schema[column].dataType)).over(self._spec())

    def lag(self, column: str, periods: int = 1) -> Column:
        """The value ``periods`` rows before; NaN, 0, false or empty text where there is none."""
        return self._shift(column, periods, F.lag)

    def lead(self, column: str, periods: int = 1) -> Column:
        return self._shift(column, periods, F.lead)

    def pct_change(self, column: str) -> Column:
        if not is_number(self.df.schema[column].dataType):
            raise TypeError(f"{column} is not numeric")
        self.reach = max(self.reach, 1)
        x = F.col(column).cast("double")
        before = F.lag(x, 1).over(self._spec())
        return F.coalesce(ieee_div(x - before, before), F.lit(NAN))

    def ewm(self, column: str, alpha: float) -> Column:
        """e[0] = x[0]; e[t] = alpha * x[t] + (1 - alpha) * e[t - 1], by folding the rows up to the current one: for short partitions."""
        self.reach = math.inf
        xs = F.collect_list(F.col(column).cast("double")).over(self._spec().rowsBetween(W.unboundedPreceding, 0))
        return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), xs[0], lambda e, x: alpha * x + (1 - alpha) * e)

    def ewm_long(self, column: str, alpha: float, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """The same as a table, a partition at a time in pandas: linear in the rows of a partition, which one task holds.

        Without partitions, rows run in blocks of ``block_rows``, and each block starts from the last value of the one before.
        """
        if not self.partition:
            return self._ewm_blocks(column, alpha, name, block_rows)
        order = [c if isinstance(c, str) else None for c in self.order]
        if None in order:
            raise ValueError("ewm_long with partitions needs column names to order by")

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(order)
            return g.assign(**{name: g[column].astype(float).ewm(alpha=alpha, adjust=False).mean()})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema) + f", `{name}` double"
        return self.df.groupBy(*self.partition).applyInPandas(run, schema)

    def _ewm_blocks(self, column: str, alpha: float, name: str, block_rows: int) -> DataFrame:
        """ewm() over all rows in order: blocks are folded from nothing, their ends chained (a row a block), then folded from the chained starts.

        A block of k values that folds to ``a`` from zero ends at a + (1 - alpha)^k * start. Nulls change nothing, as in ewm().
        """
        if not self.order:
            raise ValueError("windows need an order")
        rows = with_ordinal(self.df, self.order, "_i")
        x = F.col(column).cast("double")
        values = rows.select("_i", F.floor(F.col("_i") / block_rows).alias("_b"), x.alias("_x"), x.isNull().alias("_none"))

        def folded(g: pd.DataFrame, e: float | None) -> list[float | None]:
            out = []
            for v, none in zip(g["_x"].tolist(), g["_none"].tolist(), strict=True):
                if not none:
                    e = v if e is None else alpha * v + (1 - alpha) * e
                out.append(e)
            return out

        def ends(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g[~g["_none"]].sort_values("_i")
            if g.empty:
                return pd.DataFrame({"b": [], "k": [], "first": [], "rest": []})
            return pd.DataFrame({"b": [key[0]], "k": [len(g)], "first": [folded(g, None)[-1]], "rest": [folded(g, 0.0)[-1]]})

        starts, e = {}, None
        # tuples, since a null and a NaN are different starts
        for r in sorted(map(tuple, values.groupBy("_b").applyInPandas(ends, "b long, k long, first double, rest double").collect())):
            b, k, first, rest = r
            starts[b] = e
            e = first if e is None else rest + (e if math.isinf(e) and 0 < alpha < 1 else (1 - alpha) ** k * e)
        known = values.sparkSession.sparkContext.broadcast(starts)

        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("_i")
            out = folded(g, known.value.get(key[0]))
            return pd.DataFrame({"_i": g["_i"].to_numpy(), "_e": [0.0 if v is None else v for v in out], "_has": [v is not None for v in out]})

        made = values.groupBy("_b").applyInPandas(run, "_i long, _e double, _has boolean")
        return rows.join(made, "_i").withColumn(name, F.when(F.col("_has"), F.col("_e"))).drop("_i", "_e", "_has")

    def over(self, name: str, make: Callable[[RowWindow], Column], reach: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """The table with the column ``make(window)``, which looks back or ahead as far as its expressions say, or ``reach`` rows if that is more (for expressions of one's own).

        Without partitions, ewm() is refused (see ewm_long()), rows get their place in order, and the window runs within blocks of at least ``reach``
        rows; rows within reach of a neighbouring block are repeated there and left out of its result.
        """
        if self.partition:
            return self.df.withColumn(name, make(self))
        probe = RowWindow(self.df, self.size, (), self.order, self.incomplete)
        make(probe)
        if math.isinf(probe.reach):
            raise ValueError("ewm needs all earlier rows: without partitions, use ewm_long")
        reach = max(probe.reach, max(self.size - 1, 1) if reach is None else reach)
        n = max(block_rows, reach)
        rows = with_ordinal(self.df, self.order, "_i")
        own = F.floor(F.col("_i") / n)
        place = F.col("_i") % n
        blocks = F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.when(place >= n - reach, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))), F.when((place < reach) & (own > 0), F.struct((own - 1).alias("b"), F.lit(False).alias("own"))))
        spread = rows.withColumn("_block", F.explode(F.filter(blocks, lambda b: b.isNotNull()))).select("*", F.col("_block.b").alias("_b"), F.col("_block.own").alias("_own")).drop("_block")
        inner = RowWindow(spread, self.size, ["_b"], ["_i"], self.incomplete)
        return spread.withColumn(name, make(inner)).filter("_own").drop("_b", "_own", "_i")
