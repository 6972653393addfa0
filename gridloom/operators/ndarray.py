"""N-dimensional arrays as tables of (idx, value): idx is the row-major place, the shape is kept on the driver."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.ieee import ieee_div, ieee_ln, nan_max, nan_min
from gridloom.sources.files import from_numpy

#: Arrays of at most so many elements (160 MB) are broadcast to the other operand.
SMALL = 10_000_000


def strides_of(shape: Sequence[int]) -> list[int]:
    return [prod(shape[k + 1 :]) for k in range(len(shape))]


def ravel(index: Sequence[int], shape: Sequence[int]) -> int:
    return sum(i * s for i, s in zip(index, strides_of(shape), strict=True))


def unravel(flat: int, shape: Sequence[int]) -> list[int]:
    return [flat // s % n for s, n in zip(strides_of(shape), shape, strict=True)]


def broadcast_shapes(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...] | None:
    """The shape both stretch to, from the right, where sizes are equal or 1; None if they don't."""
    n = max(len(a), len(b))
    pairs = list(zip([1] * (n - len(a)) + list(a), [1] * (n - len(b)) + list(b), strict=True))
    return None if any(x != y and 1 not in (x, y) for x, y in pairs) else tuple(y if x == 1 else x for x, y in pairs)


def broadcastable(a: Sequence[int], b: Sequence[int]) -> bool:
    return broadcast_shapes(a, b) is not None


def axis_index(idx: Column, axis: int, shape: Sequence[int]) -> Column:
    """The place along one axis of a flat place."""
    return F.floor(idx / F.lit(strides_of(shape)[axis])) % shape[axis] if len(shape) > 1 else idx


def mapped(idx: Column, shape: Sequence[int], target: Sequence[int]) -> Column:
    """The flat place in ``shape`` that a flat place in ``target``, to which it stretches, reads."""
    lead, at = len(target) - len(shape), F.lit(0).cast("long")
    for k, (n, s) in enumerate(zip(shape, strides_of(shape), strict=True)):
        if n != 1:
            at = at + axis_index(idx, lead + k, target) * s
    return at.cast("long")


class NDArray:
    def __init__(self, df: DataFrame, shape: Sequence[int]):
        self.df, self.shape = df, tuple(int(n) for n in shape)

    # construction -----------------------------------------------------------------------------------------------

    @classmethod
    def from_values(cls, spark: SparkSession, values: Sequence[float], shape: Sequence[int] | None = None) -> NDArray:
        flat = np.asarray(values, np.float64).ravel()
        shape = np.shape(values) if shape is None else shape
        if prod(shape) != len(flat):
            raise ValueError("the values don't fill the shape")
        return cls(spark.createDataFrame(pa.table({"idx": np.arange(len(flat)), "value": flat})), shape)

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray) -> NDArray:
        return cls.from_values(spark, array)

    @classmethod
    def full(cls, spark: SparkSession, shape: Sequence[int], value: float) -> NDArray:
        return cls(spark.range(prod(shape)).select(F.col("id").alias("idx"), F.lit(float(value)).alias("value")), shape)

    @classmethod
    def zeros(cls, spark: SparkSession, shape: Sequence[int]) -> NDArray:
        return cls.full(spark, shape, 0.0)

    @classmethod
    def ones(cls, spark: SparkSession, shape: Sequence[int]) -> NDArray:
        return cls.full(spark, shape, 1.0)

    @classmethod
    def random(cls, spark: SparkSession, shape: Sequence[int], seed: int = 0) -> NDArray:
        return cls(spark.range(prod(shape)).select(F.col("id").alias("idx"), F.rand(seed).alias("value")), shape)

    @classmethod
    def arange(cls, spark: SparkSession, start: float, stop: float, step: float = 1.0) -> NDArray:
        """start, start + step, ... below stop; nothing if step leads away from it."""
        if step == 0:
            raise ValueError("step must not be 0")
        n = max(0, int(np.ceil((stop - start) / step))) if step > 0 else 0
        return cls(spark.range(n).select(F.col("id").alias("idx"), (F.lit(float(start)) + F.col("id") * float(step)).alias("value")), [n])

    @classmethod
    def from_rows(cls, df: DataFrame, row: str, vector: str, rows: int, width: int) -> NDArray:
        """A matrix from a table with a row number (0, 1, ...) and an array of ``width`` numbers in each row."""
        cells = df.select(F.col(row).alias("_r"), F.posexplode(vector).alias("_k", "_v"))
        return cls(cells.select((F.col("_r") * width + F.col("_k")).cast("long").alias("idx"), F.col("_v").cast("double").alias("value")), [rows, width])

    # shape ------------------------------------------------------------------------------------------------------

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    def __len__(self) -> int:
        return self.size

    def is_empty(self) -> bool:
        return self.size == 0

    @property
    def strides(self) -> list[int]:
        return strides_of(self.shape)

    def ravel_index(self, index: Sequence[int]) -> int:
        return ravel(index, self.shape)

    def reshape(self, shape: Sequence[int]) -> NDArray:
        if prod(shape) != self.size:
            raise ValueError("a reshape keeps the number of elements")
        return NDArray(self.df, shape)

    def transpose(self) -> NDArray:
        if self.ndim != 2:
            raise ValueError("only matrices are transposed")
        r, c = self.shape
        return NDArray(self.df.select((F.col("idx") % c * r + F.floor(F.col("idx") / c)).cast("long").alias("idx"), "value"), [c, r])

    def get(self, index: Sequence[int]) -> float | None:
        if len(index) != self.ndim or any(not 0 <= i < n for i, n in zip(index, self.shape, strict=True)):
            return None
        row = self.df.filter(F.col("idx") == self.ravel_index(index)).select("value").first()
        return row and row[0]

    def set(self, index: Sequence[int], value: float) -> NDArray:
        at = F.col("idx") == self.ravel_index(index)
        return NDArray(self.df.select("idx", F.when(at, F.lit(float(value))).otherwise(F.col("value")).alias("value")), self.shape)

    def __getitem__(self, index) -> float:
        found = self.get([index] if isinstance(index, int) else list(index))
        if found is None:
            raise IndexError(index)
        return found

    def to_numpy(self) -> np.ndarray:
        """All elements on the driver; only for arrays that fit there."""
        t = self.df.toArrow()
        out = np.zeros(self.size)
        out[t["idx"].to_numpy()] = t["value"].to_numpy()
        return out.reshape(self.shape)

    # arithmetic -------------------------------------------------------------------------------------------------

    def map(self, f: Callable[[Column], Column]) -> NDArray:
        return NDArray(self.df.select("idx", f(F.col("value")).alias("value")), self.shape)

    def combine(self, other: NDArray, f: Callable[[Column, Column], Column]) -> NDArray | None:
        """Element by element after stretching both; None if the shapes don't fit.

        Equal shapes join on idx. Otherwise each result place reads one place of each operand; an operand of at most
        SMALL elements is broadcast.
        """
        target = broadcast_shapes(self.shape, other.shape)
        if target is None:
            return None
        small = lambda a: F.broadcast if a.size <= SMALL else (lambda df: df)
        if self.shape == other.shape:
            joined = self.df.withColumnRenamed("value", "a").join(other.df.withColumnRenamed("value", "b"), "idx")
        else:
            if self.shape == target:
                left = self.df.withColumnRenamed("value", "a")
            else:
                places = self.df.sparkSession.range(prod(target)).select(F.col("id").alias("idx"))
                left = places.withColumn("_a", mapped(F.col("idx"), self.shape, target)).join(small(self)(self.df.select(F.col("idx").alias("_a"), F.col("value").alias("a"))), "_a").drop("_a")
            right = other.df.select(F.col("idx").alias("_b"), F.col("value").alias("b"))
            joined = left.withColumn("_b", mapped(F.col("idx"), other.shape, target)).join(small(other)(right), "_b")
        return NDArray(joined.select("idx", f(F.col("a"), F.col("b")).alias("value")), target)

    def add_broadcast(self, other: NDArray) -> NDArray | None:
        return self.combine(other, operator.add)

    def sub_broadcast(self, other: NDArray) -> NDArray | None:
        return self.combine(other, operator.sub)

    def mul_broadcast(self, other: NDArray) -> NDArray | None:
        return self.combine(other, operator.mul)

    def div_broadcast(self, other: NDArray) -> NDArray | None:
        return self.combine(other, ieee_div)

    def _operate(self, other, f) -> NDArray:
        if not isinstance(other, NDArray):
            return self.map(lambda v: f(v, F.lit(float(other))))
        made = self.combine(other, f)
        if made is None:
            raise ValueError(f"shapes {self.shape} and {other.shape} don't fit")
        return made

    def __add__(self, other) -> NDArray:
        return self._operate(other, operator.add)

    def __sub__(self, other) -> NDArray:
        return self._operate(other, operator.sub)

    def __mul__(self, other) -> NDArray:
        return self._operate(other, operator.mul)

    def __truediv__(self, other) -> NDArray:
        return self._operate(other, ieee_div)

    add_scalar, sub_scalar, mul_scalar, div_scalar = __add__, __sub__, __mul__, __truediv__

    def exp(self) -> NDArray:
        return self.map(F.exp)

    def ln(self) -> NDArray:
        return self.map(ieee_ln)

    def sin(self) -> NDArray:
        return self.map(F.sin)

    def cos(self) -> NDArray:
        return self.map(F.cos)

    def sqrt(self) -> NDArray:
        return self.map(F.sqrt)

    def pow(self, exponent: float) -> NDArray:
        return self.map(lambda v: F.pow(v, F.lit(float(exponent))))

    # reductions -------------------------------------------------------------------------------------------------

    def _reduce(self, agg: Column) -> float:
        return self.df.agg(agg).first()[0]

    def sum(self) -> float:
        return self._reduce(F.coalesce(F.sum("value"), F.lit(0.0)))

    def mean(self) -> float:
        return self._reduce(F.coalesce(F.avg("value"), F.lit(float("nan"))))

    def max(self) -> float:
        """NaN is left out; of nothing, minus infinity."""
        return self._reduce(nan_max(F.col("value"), self.df.schema["value"].dataType))

    def min(self) -> float:
        return self._reduce(nan_min(F.col("value"), self.df.schema["value"].dataType))

    def _along(self, axis: int, agg: Column) -> NDArray:
        if not 0 <= axis < self.ndim:
            raise ValueError("no such axis")
        rest = [n for k, n in enumerate(self.shape) if k != axis]
        s = self.strides[axis]
        outer, inner = F.floor(F.col("idx") / (s * self.shape[axis])), F.col("idx") % s
        grouped = self.df.groupBy((outer * s + inner).cast("long").alias("idx")).agg(agg.alias("value"))
        return NDArray(grouped, rest or [1])

    def sum_axis(self, axis: int) -> NDArray:
        return self._along(axis, F.sum("value"))

    def mean_axis(self, axis: int) -> NDArray:
        return self._along(axis, F.avg("value"))


def zeros(spark: SparkSession, shape: Sequence[int]) -> NDArray:
    return NDArray.zeros(spark, shape)


def ones(spark: SparkSession, shape: Sequence[int]) -> NDArray:
    return NDArray.ones(spark, shape)


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> NDArray:
    return NDArray.arange(spark, start, stop, step)


def vector_column(spark: SparkSession, values: np.ndarray, name: str = "value") -> DataFrame:
    return from_numpy(spark, values, name)
