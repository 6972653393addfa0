"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own_dir: list[str] = []
_collecting: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Where it is unset, a folder of our own, which only
    a session on one machine can use: any other gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="gridloom-"))
    return _own_dir[0]


def staged_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/gridloom/{tag}-{uuid.uuid4().hex}"
    for paths in _collecting:
        paths.append(path)
    return path


@contextmanager
def collected(paths: list[str]) -> Iterator[list[str]]:
    """Adds to ``paths`` what is staged meanwhile, so that it can be discarded when nothing reads it any more."""
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting[:] = [x for x in _collecting if x is not paths]


def discard(spark: SparkSession, paths: list[str], read_by: DataFrame | None = None) -> None:
    """Delete staged tables, but those that ``read_by`` still reads, and take the deleted ones off the list."""
    used = read_by.inputFiles() if read_by is not None else []
    for path in [p for p in paths if not any(p.rsplit("/", 1)[1] in f for f in used)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        paths.remove(path)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write the rows to the shared folder once and go on from there: later steps neither recompute them nor depend on an executor's disk."""
    path = staged_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, order: list, name: str = "_i") -> DataFrame:
    """Adds each row's place (0, 1, ...) in ``order``, without bringing all rows to one task.

    Rows are dealt by ranges, sorted and written with their place in their range; a range's start is the sum of the
    sizes of those before it, a row a range.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    kept = staged(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordinal")
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")
