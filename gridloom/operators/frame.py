"""Frame: a lazy table whose rows may have an order. Every operator returns a plan; only counts and exports run jobs."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.ieee import NAN, is_float, is_number
from gridloom.operators.grouped import GroupBy
from gridloom.operators.rolling import RowWindow
from gridloom.plans.storage import with_ordinal
from gridloom.sources import files

JOIN_HOW = {"inner": "inner", "left": "left", "outer": "outer"}
#: Sketches enclose a quartile by this share of the rows on both sides.
QUARTILE_SPAN = 0.002
KINDS = {"int64": T.LongType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "utf8": T.StringType()}


class Frame:
    """A DataFrame with an order: the columns (unique together) by which rows stand. Operators that need one say so."""

    def __init__(self, df: DataFrame, order_by: Sequence[str] | str = ()):
        self.df = df
        self.order = [order_by] if isinstance(order_by, str) else list(order_by)

    # construction -----------------------------------------------------------------------------------------------

    @classmethod
    def new(cls, spark: SparkSession, columns: dict[str, Sequence], order_by: Sequence[str] = ()) -> Frame:
        """From equally long columns of one type each."""
        if len({len(v) for v in columns.values()}) > 1:
            raise ValueError("all columns must have the same length")
        return cls(spark.createDataFrame(pd.DataFrame(columns)), order_by)

    @classmethod
    def empty(cls, spark: SparkSession, columns: dict[str, str]) -> Frame:
        """No rows; types int64, float64, bool or utf8."""
        return cls(spark.createDataFrame([], T.StructType([T.StructField(n, KINDS[k]) for n, k in columns.items()])))

    def _like(self, df: DataFrame) -> Frame:
        return Frame(df, [c for c in self.order if c in df.columns] if all(c in df.columns for c in self.order) else ())

    def _ordered(self) -> list[str]:
        if not self.order:
            raise ValueError("this operator needs rows in an order: Frame(df, order_by=[...])")
        return self.order

    def _need(self, *names: str) -> None:
        for n in names:
            if n not in self.df.columns:
                raise ValueError(f"no column {n!r}")

    # shape and columns ------------------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.df.columns)

    def shape_frame(self) -> DataFrame:
        """The shape as one row, as part of a plan."""
        return self.df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(self.df.columns)).cast("long"))

    def select(self, cols: Sequence[str]) -> Frame:
        self._need(*cols)
        return self._like(self.df.select(*cols))

    def column_length(self, name: str) -> int:
        """Values of a column, nulls too."""
        self._need(name)
        return self.df.select(name).count()

    def get_column(self, name: str) -> DataFrame | None:
        return self.df.select(name) if name in self.df.columns else None

    def __getitem__(self, name: str) -> list:
        """The values of a column on the driver, in order if there is one."""
        self._need(name)
        df = self.df.orderBy(*self.order) if self.order else self.df
        return df.select(name).toArrow().column(0).to_pylist()

    def with_column(self, name: str, value: Column) -> Frame:
        """Add a column, or replace it where it stands."""
        return self._like(self.df.withColumn(name, value))

    def with_values(self, name: str, values: Sequence) -> Frame:
        """Attach a local vector by row order."""
        spark, rows = self.df.sparkSession, with_ordinal(self.df, self._ordered())
        side = spark.createDataFrame(pd.DataFrame({"_i": range(len(values)), "_v": values}))
        if rows.count() != len(values):
            raise ValueError("the vector must be as long as the frame")
        joined = rows.join(side, "_i")
        return self._like(joined.select(*[F.col("_v").alias(name) if c == name else F.col(c) for c in self.columns], *([] if name in self.columns else [F.col("_v").alias(name)])))

    def drop(self, cols: Sequence[str]) -> Frame:
        return self._like(self.df.drop(*cols))

    # filters ----------------------------------------------------------------------------------------------------

    def filter(self, condition: Column | str | Sequence[bool]) -> Frame:
        """By an expression, SQL text, or a local mask with a value for each row in order."""
        if isinstance(condition, str | Column):
            return self._like(self.df.filter(condition))
        mask = self.with_values("_mask", list(condition))
        return self._like(mask.df.filter("_mask").drop("_mask"))

    def compare(self, column: str, op: str, value: float) -> Frame:
        """Rows whose number is gt, lt or eq to a float; NaN is none of them. Other types are an error."""
        self._need(column)
        kind, c = self.df.schema[column].dataType, F.col(column)
        if not is_number(kind):
            raise TypeError(f"{column} is not numeric")
        test = {"gt": c > value, "lt": c < value, "eq": c == value}[op]
        return self._like(self.df.filter(test & ~F.isnan(c) if is_float(kind) else test))

    # order ------------------------------------------------------------------------------------------------------

    def sort_by(self, column: str, ascending: bool = True) -> Frame:
        """Rows of equal value keep the frame's order in both directions; NaN comes last ascending."""
        self._need(column)
        key = F.col(column).asc() if ascending else F.col(column).desc()
        return Frame(self.df.orderBy(key, *self.order), self.order)

    sort_values = sort_by

    def head(self, n: int = 5) -> Frame:
        return self._like(self.df.orderBy(*self._ordered()).limit(n))

    def tail(self, n: int = 5) -> Frame:
        last = self.df.orderBy(*[F.col(c).desc() for c in self._ordered()]).limit(n)
        return self._like(last.orderBy(*self.order))

    def slice(self, offset: int, length: int) -> Frame:
        return self._like(self.df.orderBy(*self._ordered()).offset(offset).limit(length))

    def top_k(self, column: str, k: int, ascending: bool = False) -> Frame:
        key = F.col(column).asc() if ascending else F.col(column).desc()
        return self._like(self.df.orderBy(key, *self.order).limit(k))

    # joins ------------------------------------------------------------------------------------------------------

    def join(self, other: Frame, on: str, how: str = "inner") -> Frame:
        """Equi-join on one key; the other side's columns of the same name get ``_y``. ``right`` puts the other side first."""
        if how == "right":
            return other.join(self, on, "left")
        if how not in JOIN_HOW:
            raise ValueError(f"unknown join {how!r}")
        self._need(on)
        other._need(on)
        renamed = [f"{c}_y" if c in self.columns and c != on else c for c in other.columns]
        clash = (set(renamed) - {on}) & set(self.columns)
        if clash or len(set(renamed)) < len(renamed):
            raise ValueError(f"column names still collide: {sorted(clash)}")
        return Frame(self.df.join(other.df.toDF(*renamed), on, JOIN_HOW[how]))

    # groups and aggregates --------------------------------------------------------------------------------------

    def groupby(self, *by: str) -> GroupBy:
        self._need(*by)
        return GroupBy(self, list(by))

    def groupby_count(self, by: str) -> DataFrame:
        return self.groupby(by).count()

    def aggregate(self, column: str, func: str) -> DataFrame:
        """One row with sum, min or max as a double; of no rows: 0 for sums and integers, NaN for the extremes of floats."""
        self._need(column)
        kind, c = self.df.schema[column].dataType, F.col(column)
        if not is_number(kind):
            raise TypeError(f"{column} is not numeric")
        value = {"sum": F.sum, "min": F.min, "max": F.max}[func](c).cast("double")
        return self.df.agg(F.coalesce(value, F.lit(NAN if is_float(kind) and func != "sum" else 0.0)).alias(func))

    def describe(self) -> DataFrame:
        """A row a column: column, count, mean, std (population), min, 25%, 50%, 75%, max.

        A quartile is the value at place floor(n * q) of the sorted values. One pass gives all columns' sums and, from sketches,
        two values that enclose each quartile; a second counts what lies below; a third sorts, by ranges, only what lies between
        them, of all columns at once. Columns that aren't numeric, or have no values, have NaN everywhere. Runs jobs; the result
        is local.
        """
        names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
        make = {"count": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
        numeric = [f.name for f in self.df.schema if is_number(f.dataType)]
        values = self.df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{k}") for k, c in enumerate(numeric)])
        near = [F.lit(q + d) for q in (0.25, 0.5, 0.75) for d in (-QUARTILE_SPAN, QUARTILE_SPAN)]
        aggs = [m(f"v{k}").cast("double").alias(f"{s}{k}") for k in range(len(numeric)) for s, m in make.items()]
        aggs += [F.percentile_approx(f"v{k}", F.array(*near), int(4 / QUARTILE_SPAN)).alias(f"near{k}") for k in range(len(numeric))]
        stats = values.agg(*aggs).first() if aggs else None
        spans = [(k, q, int(stats[f"count{k}"] * q), *stats[f"near{k}"][2 * j : 2 * j + 2]) for k in range(len(numeric)) if stats[f"count{k}"] for j, q in enumerate((0.25, 0.5, 0.75))]
        found = self._at_places(values, spans) if spans else {}
        out = []
        for c in self.columns:
            row = dict.fromkeys(names, NAN)
            k = numeric.index(c) if c in numeric else None
            if k is not None and stats[f"count{k}"]:
                row |= {s: stats[f"{s}{k}"] for s in make} | {f"{int(q * 100)}%": found[k, q] for q in (0.25, 0.5, 0.75)}
            out.append((c, *[row[n] for n in names]))
        return self.df.sparkSession.createDataFrame(out, "column string, " + ", ".join(f"`{n}` double" for n in names))

    @staticmethod
    def _at_places(values: DataFrame, spans: list[tuple]) -> dict:
        """The value at a place of a sorted column, for each (column, q, place, low, high); a span that misses its place is widened
        to the whole column."""
        count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
        below = values.agg(*[x for j, (k, _, _, low, high) in enumerate(spans) for x in (count(F.col(f"v{k}") < low).alias(f"b{j}"), count(F.col(f"v{k}").between(low, high)).alias(f"n{j}"))]).first()
        found, rest = {}, []
        for j, (k, q, place, low, high) in enumerate(spans):
            inside = below[f"b{j}"] <= place < below[f"b{j}"] + below[f"n{j}"]
            if inside and low == high:
                found[k, q] = low
            else:
                rest.append((k, q, place - (below[f"b{j}"] if inside else 0), low if inside else None, high))
        if rest:
            lists = [F.when(F.col(f"v{k}").between(low, high) if low is not None else F.col(f"v{k}").isNotNull(), F.struct(F.lit(i).alias("i"), F.col(f"v{k}").alias("v"))) for i, (k, _, _, low, high) in enumerate(rest)]
            some = with_ordinal(values.select(F.explode(F.array_compact(F.array(*lists))).alias("x")).select("x.i", "x.v"), ["i", "v"], "_place")
            starts = {r["i"]: r["at"] for r in some.groupBy("i").agg(F.min("_place").alias("at")).collect()}
            places = {starts[i] + place: (k, q) for i, (k, q, place, _, _) in enumerate(rest)}
            found |= {places[r["_place"]]: r["v"] for r in some.filter(F.col("_place").isin(*places)).collect()}
        return found

    # windows and reshaping --------------------------------------------------------------------------------------

    def window(self, size: int) -> RowWindow:
        return RowWindow(self.df, size, (), self.order)

    def pivot_table(self, index: str, columns: str, values: str, aggfunc: str, names: Sequence | None = None) -> DataFrame:
        """Cells are sum, mean, count, min or max; empty ones 0; new columns in ascending order. Give ``names`` to spare a job."""
        self._need(index, columns, values)
        if names is None:
            names = [r[0] for r in self.df.select(columns).distinct().orderBy(columns).collect()]
        agg = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[aggfunc](values)
        return self.df.groupBy(index).pivot(columns, list(names)).agg(agg).na.fill(0)

    def melt(self, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
        """A row for each row and value column; values of different types become text."""
        self._need(*id_vars, *value_vars)
        kinds = {self.df.schema[c].dataType.simpleString() for c in value_vars}
        df = self.df if len(kinds) == 1 else self.df.withColumns({c: F.col(c).cast("string") for c in value_vars})
        return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)

    # samples ----------------------------------------------------------------------------------------------------

    def sample(self, n: int, replace: bool = False, seed: int = 0) -> Frame:
        """Exactly n rows (all, if there are fewer and none may repeat), by random order, or n draws of a place each."""
        if not replace:
            # what can't be among the n least draws is left out before the sort: a share of n / rows and six deviations more
            drawn, rows = self.df.withColumn("_r", F.rand(seed)), max(1, self.df.count())
            drawn = drawn.filter(F.col("_r") <= (n + 6 * n**0.5 + 40) / rows)
            return self._like(drawn.orderBy("_r").limit(n).drop("_r"))
        rows = with_ordinal(self.df, self.order or [F.rand(seed)])
        size = rows.count()
        if not size:
            return self._like(self.df)
        draws = self.df.sparkSession.range(n).select(F.floor(F.rand(seed) * size).alias("_i"))
        return self._like(rows.join(draws, "_i").drop("_i"))

    def folds(self, n_folds: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
        """The rows with their fold: runs of len / n_folds rows in order, the last with the rest; shuffled ones by random order."""
        if n_folds < 1:
            raise ValueError("n_folds must be at least 1")
        df = self.df.withColumn("_r", F.rand(seed)) if shuffle else self.df
        rows = with_ordinal(df, ["_r"] if shuffle else self._ordered())
        size = rows.count() // n_folds
        fold = F.least(F.floor(F.col("_i") / size), F.lit(n_folds - 1)) if size else F.lit(n_folds - 1)
        return rows.withColumn("fold", fold.cast("int")).drop("_i", "_r")

    def cv_split(self, n_folds: int, shuffle: bool = False, seed: int = 0) -> list[tuple[Frame, Frame]]:
        """(train, test) for each fold."""
        rows = self.folds(n_folds, shuffle, seed)
        return [(self._like(rows.filter(F.col("fold") != k).drop("fold")), self._like(rows.filter(F.col("fold") == k).drop("fold"))) for k in range(n_folds)]

    # export -----------------------------------------------------------------------------------------------------

    def to_csv(self, path: str, options: files.CsvWriteOptions | None = None) -> None:
        files.write_csv(self.df, path, options)

    def to_jsonl(self, path: str) -> None:
        files.write_jsonl(self.df, path)

    def to_json(self, path: str) -> None:
        files.write_json(self.df, path)

    def to_parquet(self, path: str) -> None:
        files.write_parquet(self.df, path)

    def to_ipc(self, path: str) -> None:
        files.write_ipc(self.df, path)

    def to_arrow(self):
        return files.to_arrow(self.df)

    def sql(self, text: str, name: str = "frame") -> DataFrame:
        """SQL over this frame under the given name."""
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError("not a name")
        return self.df.sparkSession.sql(text.replace(f"{{{name}}}", "{df}"), df=self.df)

    def equals(self, other: Frame) -> bool:
        """Whether both have the same columns, types and rows, each as often; order is no matter unless both have one."""
        if self.df.dtypes != other.df.dtypes:
            return False
        mine, others = self.df, other.df
        if self.order and other.order:
            mine, others = (with_ordinal(x.df, x.order, "_i") for x in (self, other))
        return mine.exceptAll(others).isEmpty() and others.exceptAll(mine).isEmpty()

    __eq__ = equals
    __hash__ = None

    def clone(self) -> Frame:
        return Frame(self.df, self.order)

    @classmethod
    def from_pandas(cls, spark: SparkSession, frame: pd.DataFrame, order_by: Sequence[str] = ()) -> Frame:
        return cls(spark.createDataFrame(frame), order_by)

    def __repr__(self) -> str:
        """Shape and types, and with an order the first and last five rows."""
        rows, columns = self.shape
        head = f"Frame {rows} x {columns}: {', '.join(f'{n}: {k}' for n, k in self.df.dtypes)}"
        if not self.order:
            return head
        first = self.head(5 if rows > 10 else 10).df.toPandas().to_string(index=False)
        if rows <= 10:
            return f"{head}\n{first}"
        last = self.tail(5).df.toPandas().to_string(index=False, header=False)
        return f"{head}\n{first}\n...\n{last}"
