"""Packing documents into fixed windows with source proportions, by deficit round-robin."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, staged, text_or_empty
from .tokens import encoder

#: Ids of a shard, the unit that one task packs in memory.
SHARD_IDS = 1_000_000
#: Keys of a block in running().
BLOCK_KEYS = 4096
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def round_robin(sizes: dict, share: dict, deficit: dict, start: int, window: int):
    """Yield (source, item, from, length, position) until all items of all queues are placed from position ``start`` on.

    ``sizes``: for each source a list of item sizes. When a window begins, each source earns its share of the window's
    room; sources are visited in turn, and one is served, item after item, while it is owed something. Serving may
    overdraw, which the source then pays back in later windows. If no queue with items is owed anything, the one that
    is owed most is served, so windows are always full.
    """
    queues = {s: deque(enumerate(x)) for s, x in sizes.items() if x}
    order = list(queues)
    used = dict.fromkeys(order, 0)
    owed = {s: deficit.get(s, 0.0) for s in order}
    left, at, turn = sum(sum(x) for x in sizes.values()), start, 0
    while left:
        room = min(window - at % window, left)
        for s in order:
            owed[s] += share.get(s, 0.0) * room
        while room:
            for k in range(len(order)):
                s = order[(turn + k) % len(order)]
                if owed[s] > 0:
                    turn = (turn + k) % len(order)
                    break
            else:
                s = max(order, key=owed.__getitem__)
                turn = order.index(s)
            item, n = queues[s][0]
            take = min(n - used[s], room)
            yield s, item, used[s], take, at
            at, room, left = at + take, room - take, left - take
            used[s] += take
            owed[s] -= take
            if used[s] == n:
                queues[s].popleft()
                used[s] = 0
                if not queues[s]:
                    order.remove(s)
                    turn = turn % len(order) if order else 0


def running(rows: DataFrame, key: str, value: str, name: str, by: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of smaller ``key`` (0, 1, ...; per ``by``), by way of blocks of keys:
    a task sums a block, and one the blocks' sums."""
    group = [by] if by else []
    before = lambda over: F.coalesce(F.sum(value).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.withColumn("_block", F.floor(F.col(key) / BLOCK_KEYS))
    blocks = rows.groupBy("_block", *group).agg(F.sum(value).alias(value))
    blocks = blocks.select(F.col("_block").alias("_b"), *[F.col(c).alias("_by") for c in group], before(W.partitionBy(*group).orderBy("_block")).alias("_before"))
    on = F.col("_block") == F.col("_b")
    joined = rows.withColumn(name, before(W.partitionBy("_block", *group).orderBy(key))).join(blocks, on & F.col(by).eqNullSafe(F.col("_by")) if by else on)
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_b", "_by", "_before")


def pack_by_mixture(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, text: str = "text", source: str = "source", doc_id: str = "doc_id", shares: DataFrame | None = None) -> DataFrame:
    """Pieces of all documents in windows of ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Every document's ids (its encoded text, then ``end_id``) lie on one long tape that is cut into windows; only the
    tape's last window can be short. A first pass encodes documents where they are, writes and
    numbers them; they are dealt to shards by a hash of their number, and ids are counted by shard and source;
    running sums of the counts give each shard its place on the tape and, for each source, the deficit that all shards
    before have left it: its share of the tape so far, less what they hold of it. With these a second pass packs all
    shards at once, as one round-robin over the whole tape would carry its deficits from window to window. A source's
    target share is its share of all ids, by which all queues run out together; ``shares`` (source, share) sets others.

    Nulls: a null text is empty (its only id is ``end_id``), a null source is a source, a null doc_id stays null. Very
    long texts are cut at window ends like any other. Repeated rows are packed each. An empty table gives no pieces.
    Other columns are ignored.
    """
    # doc ids go through pandas as text, which keeps nulls and all digits
    narrow = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(source).cast("string").alias("source"), text_or_empty(text).alias("text"), F.xxhash64(doc_id, text).alias("h"))

    def encoded(batches):
        for b in batches:
            ids, n = encoder(tokenizer).encode_with_end(b.column("text"), end_id)
            width = ids.dtype.itemsize
            ends = pa.array(np.concatenate([[0], np.cumsum(n * width)]), pa.int64())
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(ids)]).cast(pa.binary())
            kept = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n), pa.array(np.full(len(n), width, np.int32)), lists], [*kept.schema.names, "n", "width", "ids"])

    schema = T.StructType([f for f in narrow.schema if f.name != "text"]).add("n", "long").add("width", "integer").add("ids", "binary")
    # rows are dealt by number, so repeated rows go to shards like any others
    narrow = staged(narrow.mapInArrow(released(encoded), schema).withColumn("r", F.monotonically_increasing_id()), "pack-ids")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    narrow = narrow.withColumn("shard", F.pmod(F.xxhash64("r", F.lit(7)), F.lit(max(1, -(-total // SHARD_IDS)))))
    counts = staged(narrow.groupBy("shard", "source").agg(F.sum("n").alias("n")), "pack-counts")
    starts = running(counts.groupBy("shard").agg(F.sum("n").alias("n")), "shard", "n", "at").select(F.col("shard").alias("_shard"), "at")
    if shares is None:
        shares = counts.groupBy("source").agg((F.sum("n") / F.lit(float(max(total, 1)))).alias("share"))
    shares = shares.select(F.col("source").alias("_source"), "share")
    plan = (
        running(counts, "shard", "n", "before", "source")
        .join(starts, F.col("shard") == F.col("_shard"))
        .join(shares, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("shard", "source", "at", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("at") - F.col("before")).alias("deficit"))
    )

    def packed(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        key = lambda s: s if isinstance(s, str) else None
        rows = rows.sort_values(["h", "doc_id", "r"], kind="stable")
        ids = [np.frombuffer(x, "<u2" if w == 2 else "<u4").astype("<u4") for x, w in zip(rows["ids"], rows["width"], strict=True)]
        names, docs_ = [key(s) for s in rows["source"]], rows["doc_id"].tolist()
        queues: dict = {s: [] for s in sorted({*names}, key=lambda s: (s is None, s or ""))}
        for k, s in enumerate(names):
            queues[s].append(k)
        share = {key(s): x for s, x in zip(plan["source"], plan["share"], strict=True)}
        owed = {key(s): x for s, x in zip(plan["source"], plan["deficit"], strict=True)}
        out = []
        for s, item, begin, n, at in round_robin({s: [len(ids[k]) for k in q] for s, q in queues.items()}, share, owed, int(plan["at"].iloc[0]), window):
            k = queues[s][item]
            out.append((docs_[k], begin, n, zlib.crc32(ids[k][begin : begin + n]), len(ids[k]), at // window, at % window, s))
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    pieces = narrow.groupBy("shard").cogroup(plan.groupBy("shard")).applyInPandas(packed, PIECES)
    return pieces.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
