"""What the operators of this package share: words, the shared folder, joins that survive hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.storage import staged, staged_path

__all__ = ["SPACE", "WORD", "join_by_weight", "join_small_or_salted", "numbered", "released", "staged", "staged_path", "text_or_empty", "without_rows"]

#: Fixed values of the result contracts: a word, and a white-space character.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A table is broadcast only while its counted rows stay at or under this.
BROADCAST_ROWS = 100_000


def _release() -> None:
    """Memory that allocators hold but nothing uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over the batches of a task; at its end its worker, which waits for later tasks, keeps only what is in use."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _release()

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, written once so that the numbers stay, and the new column's name."""
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without_rows(rows: DataFrame, dropped: DataFrame, row: str, limit: int | None = None) -> DataFrame:
    """``rows`` without those whose numbers ``dropped`` has as ``row``; the numbers are counted and broadcast only if they are few."""
    gone = staged(dropped.select(F.col("row").alias(row)), "dropped")
    few = gone.count() <= (BROADCAST_ROWS if limit is None else limit)
    return rows.join(F.broadcast(gone) if few else gone, row, "left_anti").drop(row)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def join_small_or_salted(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows to a table with one row per key, on a null-safe key that may be very uneven in ``rows``.

    The table's rows are counted: at or under ``limit`` it is broadcast. Beyond that its rows are repeated once for
    each of 64 salts and joined by shuffle, so that a hot key is spread over 64 partitions. ``how``: inner or left.
    The table's key column is dropped.
    """
    small = table.withColumnRenamed(key, "_key")
    match = F.col(key).eqNullSafe(F.col("_key"))
    if small.count() <= limit:
        return rows.join(F.broadcast(small), match, how).drop("_key")
    salts = 64
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)))
    right = small.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    # a null-safe key that Spark can hash: the key and whether it is null
    zero = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    on = (zero(key) == zero("_key")) & (F.col(key).isNull() == F.col("_key").isNull()) & (F.col("_salt") == F.col("_salt2"))
    return left.join(right, on, how).drop("_key", "_salt", "_salt2")


def join_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows to a table on ``key``, where ``weight`` holds how many of ``rows`` have the key.

    At most 200 keys can weigh more than a 200th of ``total`` each: their rows of the table are broadcast, so no task
    gets a hot key; all others are joined by shuffle. ``total``: the rows, or what each of a fixed number of groups of
    the rows holds (a band's rows, say).
    """
    hot = F.col(weight) * 200 > total
    heavy = rows.join(F.broadcast(table.filter(hot)), key)
    light = rows.join(F.broadcast(table.filter(hot).select(key).distinct()), key, "left_anti").join(table.filter(~hot), key)
    return heavy.unionByName(light)
