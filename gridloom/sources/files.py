"""Readers and writers: CSV, JSON lines, JSON, Parquet, Arrow IPC, Arrow tables and NumPy vectors."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from glob import glob

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.ieee import is_float
from gridloom.functions.infer import infer_types, typed


@dataclass(frozen=True)
class CsvReadOptions:
    delimiter: str = ","
    has_headers: bool = True


@dataclass(frozen=True)
class CsvWriteOptions:
    delimiter: str = ","
    write_headers: bool = True
    float_precision: int = 0


def _csv_text(spark: SparkSession, path: str, options: CsvReadOptions) -> DataFrame:
    df = spark.read.option("sep", options.delimiter).option("header", options.has_headers).option("emptyValue", "").option("nullValue", None).csv(path)
    df = df if options.has_headers else df.toDF(*[f"column_{k}" for k in range(len(df.columns))])
    return df.na.fill("")


def read_csv(spark: SparkSession, path: str, options: CsvReadOptions | None = None) -> DataFrame:
    """Column types by vote; a column with a value that fails its type stays text."""
    df = _csv_text(spark, path, options or CsvReadOptions())
    return typed(df, infer_types(df), "text")


def read_csv_map(spark: SparkSession, path: str) -> DataFrame:
    """As read_csv(), but a value that fails its column's type is zero or false."""
    df = _csv_text(spark, path, CsvReadOptions())
    return typed(df, infer_types(df), "zero")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; the union of keys, alphabetically; missing, null and nested values are empty text before the vote."""
    return _voted(spark.read.option("primitivesAsString", True).json(path))


def _voted(df: DataFrame) -> DataFrame:
    df = df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.lit("").alias(f.name) for f in df.schema if f.name != "_corrupt_record"])
    return typed(df, infer_types(df), "zero")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_ipc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Arrow IPC files, or folders of them, all batches, one task a file; paths must be open to executors."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    folders = [p.removeprefix("file://") for p in paths]
    paths = [f for p in folders for f in (sorted(glob(f"{p}/*.arrow")) if os.path.isdir(p) else [p])]
    with pa.OSFile(paths[0].removeprefix("file://"), "rb") as f:
        schema = from_arrow_schema(spark, pa.ipc.open_file(f).schema)

    def load(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                with pa.OSFile(path.removeprefix("file://"), "rb") as f:
                    reader = pa.ipc.open_file(f)
                    for k in range(reader.num_record_batches):
                        yield reader.get_batch(k)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(load, schema)


def from_arrow_schema(spark: SparkSession, schema: pa.Schema) -> T.StructType:
    return spark.createDataFrame(schema.empty_table()).schema


def from_arrow(spark: SparkSession, table: pa.Table | pa.RecordBatch) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table)


def from_numpy(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    return spark.createDataFrame(pa.table({name: np.asarray(values, np.float64)}))


def _as_text(df: DataFrame, precision: int) -> DataFrame:
    """Floats as the writer wants them: fixed decimals, or the shortest form without a trailing .0."""

    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if not is_float(f.dataType):
            return c
        text = F.format_string(f"%.{precision}f", c) if precision else F.regexp_replace(c.cast("string"), r"\.0$", "")
        return F.when(c.isNotNull(), text).alias(f.name)

    return df.select(*[shown(f) for f in df.schema])


def write_csv(df: DataFrame, path: str, options: CsvWriteOptions | None = None) -> None:
    """A folder of CSV parts, written by all tasks."""
    o = options or CsvWriteOptions()
    _as_text(df, o.float_precision).write.option("sep", o.delimiter).option("header", o.write_headers).option("emptyValue", "").csv(path)


def _finite(df: DataFrame) -> DataFrame:
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name) if is_float(f.dataType) else F.col(f"`{f.name}`") for f in df.schema])


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a row; NaN and infinities are null."""
    _finite(df).write.option("ignoreNullFields", False).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A folder of text parts, each one pretty-printed array (or nothing, of no rows), written by all tasks."""

    def arrays(batches):
        first = True
        for b in batches:
            lines = []
            for row in b.column(0).to_pylist():
                pretty = json.dumps(json.loads(row), indent=2, ensure_ascii=False)
                lines.append(("[\n" if first else ",\n") + "\n".join("  " + x for x in pretty.split("\n")))
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[\n]" if first else "]"])], ["value"])

    rows = _finite(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(arrays, "value string").write.text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of objects in files of a folder or one file; types as read_jsonl() has them."""
    return _voted(spark.read.option("primitivesAsString", True).option("multiLine", True).json(path))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_ipc(df: DataFrame, path: str) -> None:
    """A folder of Arrow IPC files, one for each task, which must be open to executors; a file appears when it is whole."""
    folder = path.removeprefix("file://")
    os.makedirs(folder)
    schema = df.limit(0).toArrow().schema

    def save(batches):
        part = TaskContext.get().partitionId()
        name, made, rows = f"{folder}/part-{part:05d}.arrow", f"{folder}/.{part}-{TaskContext.get().taskAttemptId()}", 0
        with pa.OSFile(made, "wb") as f, pa.ipc.new_file(f, schema) as w:
            for b in batches:
                w.write_batch(pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(b.columns, schema, strict=True)], schema=schema))
                rows += b.num_rows
        os.replace(made, name)
        yield pa.RecordBatch.from_arrays([pa.array([rows])], ["rows"])

    df.mapInArrow(save, "rows long").agg(F.sum("rows")).first()


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def series_to_numpy(df: DataFrame, column: str) -> np.ndarray:
    kind = df.schema[column].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{column} is not numeric")
    return df.select(F.col(column).cast("double")).toArrow().column(0).to_numpy()
