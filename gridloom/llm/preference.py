"""Preference pairs: one prompt of the turns two conversations share, and two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.storage import with_ordinal

from .common import join_by_weight, staged

#: Turns of a chunk: a longer segment is rendered in chunks, so that no task holds a whole conversation.
CHUNK_TURNS = 64
#: A null turn stands after all others.
_LAST = (1 << 63) - 1


def rendered(role: Column, text: Column) -> tuple[Column, Column]:
    """Head and body of a turn; the body, with its end mark, is what a model learns of an assistant's turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n")), F.concat(text, F.lit("<|im_end|>\n"))


def _common_turns(turns: DataFrame) -> DataFrame:
    """(pair_id, first_turn, n): the first turn in which the two sides differ, null if they nowhere do, and the rows of the pair.

    Sides are compared turn by turn, by the count and the sums of 128 bits of hashes of a turn's rows, which add up on both sides
    of the shuffle; no task sees a conversation as a whole.
    """
    wide = [F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)]
    hashes = [h for x in wide for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1)))]
    of = lambda side: [F.when(F.col("side") == side, h) for h in hashes]
    digest = lambda side: F.struct(F.count_if(F.col("side") == side).alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(of(side))])
    by_turn = turns.groupBy("pair_id", "turn").agg(digest("chosen").alias("c"), digest("rejected").alias("r"), F.count(F.lit(1)).alias("n"))
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    return by_turn.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("first_turn"), F.sum("n").alias("n"))


def _render(turns: Column) -> Column:
    """Text and learnt spans (from, to; in characters of the text) of sorted turns."""
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        head, body = rendered(t["role"], t["text"])
        at = (F.length(s["text"]) + F.length(head)).cast("int")
        span = F.struct(at.alias("from"), (at + F.length(body)).cast("int").alias("to"))
        return F.struct(F.concat(s["text"], head, body).alias("text"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, add)


def _in_parts(placed: DataFrame, chunk_turns: int) -> DataFrame:
    """Adds part: 0, and in chunks of more than ``chunk_turns`` rows (repeated or null turns) the row's place by ``chunk_turns``.

    Such chunks are counted first. Their rows get places by ranges over all of them, so one of very many rows is spread.
    """
    key = ["pair", "segment", "chunk"]
    zero = F.lit(0).cast("long").alias("part")
    sizes = staged(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk_turns), "long-chunks")
    if sizes.isEmpty():
        return placed.select("*", zero)
    total = placed.count()
    joined = placed.withColumn("key", F.struct(*key))
    sizes = sizes.select(F.struct(*key).alias("key"), "n")
    hot = sizes.filter(F.col("n") * 200 > total).select("key")
    plain = joined.join(F.broadcast(hot), "key", "left_anti").join(sizes, "key", "left_anti").select(*placed.columns, zero)
    # equal rows are told apart by where they stand
    rows = join_by_weight(joined, sizes, "key", "n", total).drop("key", "n").withColumn("_r", F.monotonically_increasing_id())
    rows = with_ordinal(rows, [*key, "turn", "role", "text", "_r"], "_i")
    starts = staged(rows.groupBy(*key).agg(F.min("_i").alias("_start"), F.count(F.lit(1)).alias("n")).select(F.struct(*key).alias("key"), "_start", "n"), "chunk-starts")
    rows = join_by_weight(rows.withColumn("key", F.struct(*key)), starts, "key", "n", total)
    return plain.unionByName(rows.select(*placed.columns, F.floor((F.col("_i") - F.col("_start")) / chunk_turns).alias("part")))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """From turns (pair_id, turn, role, text) of chosen and rejected conversations: pair_id, segment, chunk, part, n_turns, text, spans.

    The turns before the first in which the two sides of a pair differ are its prompt, rendered once; what follows is
    each side's completion. ``spans`` are the parts of a completion that count for the loss: what the assistant says,
    with the end mark. A prompt has none. A segment of usual length is one row; one whose turns are numbered over
    several times ``chunk_turns`` has a row for each chunk, in order, and a chunk of more rows than that, by repeated or null
    turns, one for each part of it.

    Nulls: a null role or text is empty, a null turn is last, a null pair_id is a pair. A pair with one side only has no
    common turn. A side that ends with the common turns has an empty completion, which still has its row. Repeated
    rows are repeated turns. An empty table gives no rows; other columns are ignored.
    """
    side = lambda df, name: df.select("pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(name).alias("side"))
    # pairs are joined by a key without nulls
    turns = side(chosen, "chosen").unionByName(side(rejected, "rejected")).withColumn("pair", F.struct(F.col("pair_id").isNull().alias("none"), F.coalesce(F.col("pair_id"), F.lit(0)).alias("id")))
    pairs = staged(_common_turns(turns.withColumnRenamed("pair_id", "_p").withColumnRenamed("pair", "pair_id")), "pairs").withColumnRenamed("pair_id", "pair")
    total = turns.count()
    placed = join_by_weight(turns, pairs, "pair", "n", total)
    common = F.col("first_turn").isNull() | (F.col("turn") < F.col("first_turn"))
    # the chosen side renders the common turns
    placed = placed.filter(~common | (F.col("side") == "chosen")).withColumn("segment", F.when(common, F.lit("prompt")).otherwise(F.col("side")))
    chunk = F.when(F.col("turn") == _LAST, F.lit(_LAST)).otherwise(F.floor(F.col("turn") / chunk_turns))
    placed = _in_parts(placed.select("pair", "pair_id", "segment", chunk.alias("chunk"), "turn", "role", "text"), chunk_turns)
    listed = placed.groupBy("pair_id", "segment", "chunk", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    made = listed.select("pair_id", "segment", "chunk", "part", F.size("turns").alias("n_turns"), _render(F.col("turns")).alias("r"))
    none = F.array().cast("array<struct<from:int,to:int>>")
    full = made.select("pair_id", "segment", "chunk", "part", "n_turns", "r.text", F.when(F.col("segment") == "prompt", none).otherwise(F.col("r.spans")).alias("spans"))
    ends = turns.groupBy("pair").agg(F.first("pair_id").alias("pair_id"), *[F.max(F.when(F.col("side") == s, F.col("turn"))).alias(s) for s in ("chosen", "rejected")])
    ends = ends.join(pairs, "pair")
    sides = F.array(*[F.when(F.col("first_turn").isNull() | F.col(s).isNull() | (F.col(s) < F.col("first_turn")), F.lit(s)) for s in ("chosen", "rejected")])
    empty = ends.select("pair_id", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("segment"))
    return full.unionByName(empty.select("pair_id", "segment", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("n_turns"), F.lit("").alias("text"), none.alias("spans")))
