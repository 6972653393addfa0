"""Floating-point expressions with IEEE results where Spark raises an error or gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN, INF = float("nan"), float("inf")


def ieee_div(n: Column, d: Column) -> Column:
    """n / d; a zero divisor gives NaN or an infinity with the sign of n."""
    n, d = n.cast("double"), d.cast("double")
    by_zero = F.when((n == 0) | F.isnan(n), F.lit(NAN)).when(n > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(n.isNull() | d.isNull(), F.lit(None)).when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def round_scaled(x: Column, digits: int) -> Column:
    """Rounds as DuckDB does: x * 10^digits to a whole number, halves away from zero. Spark's round() takes the decimal text of x,
    so it rounds 8.0046874999999993, shown as 8.0046875, up."""
    x = x.cast("double")
    scaled = x * F.lit(10.0**digits)
    even = F.rint(scaled)
    whole = F.when(F.abs(scaled - even) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(even)
    made = whole / F.lit(10.0**digits)
    return F.when(F.isnan(made) | (F.abs(made) == INF), x).otherwise(made)


def ieee_ln(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.ln(x))


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.DoubleType | T.FloatType)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def without_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def nan_min(c: Column, kind: T.DataType, agg=lambda x: x) -> Column:
    """Least value that is not NaN; infinity if there is none. ``agg`` may put the aggregate over a window."""
    return F.coalesce(agg(F.min(without_nan(c))), F.lit(INF)) if is_float(kind) else agg(F.min(c))


def nan_max(c: Column, kind: T.DataType, agg=lambda x: x) -> Column:
    return F.coalesce(agg(F.max(without_nan(c))), F.lit(-INF)) if is_float(kind) else agg(F.max(c))


def fill_of(kind: T.DataType):
    """What stands where a shifted column has no row: NaN, 0, false or an empty string."""
    if is_float(kind):
        return NAN
    return 0 if is_number(kind) else False if isinstance(kind, T.BooleanType) else "" if isinstance(kind, T.StringType) else None
