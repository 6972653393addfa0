"""Token ids as Parquet list columns, in files from which ids and metadata can be read apart."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_small_or_salted, text_or_empty
from .tokens import encoder

#: Row groups of 32 MB, pages of 256 KB and at most 2,000 rows with page indexes (so a few documents can be read alone);
#: ids are dictionary-encoded, the rising metadata columns delta-encoded.
PARQUET = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
ROWS = "part int, doc_id long, part_start long, n_tokens int, tokens array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every whole text, append ``end_id`` and write the ids under ``path`` in ascending doc_id order.

    Rows are dealt by ranges of doc_id, sorted and only then encoded, so what shuffles is text, once. Each row holds
    its file's number (part), the ids before it in that file (part_start), n_tokens and tokens.

    Nulls: a null text is an empty one, whose only id is ``end_id``; null doc ids come first. Equal doc ids follow each
    other in the order of a hash of their text. An empty table gives files without rows. Other columns are ignored.
    """

    def rows(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for texts, ids in ((batch.column("text").slice(k, 1000), batch.column("doc_id").slice(k, 1000)) for k in range(0, batch.num_rows, 1000)):
                values, n = encoder(tokenizer).encode_with_end(texts, end_id, np.int32)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))
                columns = [pa.array(np.full(len(n), part, np.int32)), ids, pa.array(start + ends - n), pa.array(n, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "part_start", "n_tokens", "tokens"])
                start += int(ends[-1])

    # equal rows have places too, so that any number of them can be cut into ranges
    place = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)).alias("p")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), F.xxhash64(text).alias("h"), place)
    dealt = narrow.repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h")
    dealt.select("doc_id", "text").mapInArrow(rows, ROWS).write.options(**PARQUET).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, part_start, n_tokens and start (ids of all documents before) without touching the ids."""
    rows = spark.read.schema(ROWS).parquet(path).select("part", "doc_id", "part_start", "n_tokens")
    return rows.join(F.broadcast(_bases(rows)), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def _bases(rows: DataFrame) -> DataFrame:
    """For each file, the ids in all files before it; a row a file."""
    totals = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base"))


def read_tokens(spark: SparkSession, path: str, condition=None) -> DataFrame:
    """The files' rows; a condition on doc_id or n_tokens skips row groups and pages by their statistics."""
    rows = spark.read.schema(ROWS).parquet(path)
    return rows if condition is None else rows.filter(condition)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files, for each document: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def crcs(batches):
        for b in batches:
            lists = b.column("tokens")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("part_start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    summed = rows.select("part", "doc_id", "part_start", "tokens").mapInArrow(crcs, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long")
    return join_small_or_salted(summed, _bases(rows.drop("tokens")), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", "part")
