"""Exact duplicates by two-pass Bloom filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import in_slices
from .common import SPACE, join_by_weight, numbered, staged, staged_path, text_or_empty, without_rows


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space ([\\x20\\x09-\\x0D]); of equal texts the row with the
    most code points, then the smallest doc_id, stays. Pass 1 marks in a Bloom filter what two rows or more have set: tasks
    send their rows' bit positions, a few bytes a row, and no rows. Pass 2 tests every row; only rows whose positions are all
    marked go through the exact grouping by digest. All others can have no equal and pass straight through. A filter for
    more rows has more slices, tested one after another, so it never fills up. Texts never shuffle, only digests do.

    Nulls: a null text counts as empty; a null doc_id sorts after all others and stays null. Rows repeated in full are
    separate rows of a group, of which exactly one is kept. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    return _decided(docs, text, doc_id, F.monotonically_increasing_id()).drop("row")


def _decided(docs: DataFrame, text: str, doc_id: str, row: Column) -> DataFrame:
    """As exact_duplicates(), with each row's number."""
    digests = staged(
        docs.select(
            row.alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.length(text_or_empty(text)).cast("long").alias("n_chars"),
            F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), SPACE, ""), 256)).alias("sha"),
        ),
        "digests",
    )
    total = digests.count()
    path = staged_path(docs.sparkSession, "tested")
    in_slices(digests, "sha", total, 2, lambda df: df.write.mode("append").parquet(path))
    tested = docs.sparkSession.read.schema(T.StructType([*digests.schema.fields, T.StructField("maybe", T.BooleanType())])).parquet(path)
    alone = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "row")
    again = tested.filter("maybe").drop("maybe")
    best = F.min(F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("best")
    groups = staged(again.groupBy("sha").agg(best, F.count(F.lit(1)).alias("group_size")).select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "groups")
    joined = join_by_weight(again, groups, "sha", "group_size", total)
    grouped = joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha", "row")
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "row")


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that exact_duplicates() keeps, with all their columns; null and repeated doc ids are no matter."""
    rows, row = numbered(docs)
    return without_rows(rows, _decided(rows, text, doc_id, F.col(row)).filter("NOT kept"), row)
