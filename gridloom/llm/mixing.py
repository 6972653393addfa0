"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, join_by_weight, join_small_or_salted, numbered, staged, text_or_empty

#: Units that one task pairs off in a row; a node of the reduction tree has about this many children.
FAN_IN = 128


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets from rows of (source, source_size), one row a source: source, source_size, target.

    Sources by code point, null last, take the weights in turn. They share ``share`` of all sizes by weight; none gets
    more than ``most`` times its own size, and what it can't take is shared again among the others by weight. With
    sources in ascending order of cap / weight, the level that source k and all later ones would share, were all
    earlier ones at their caps, is largest at the level that holds; so no loop is needed.
    """
    everything = W.partitionBy()
    ranked = sizes.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    by_ratio = W.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_n"))
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    level = F.max("_level").over(everything)
    return ranked.withColumn("_level", (share * total - before) / after).select("source", "source_size", F.least(F.col("_cap"), level * F.col("_w")).alias("target"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _pivot(state: Column, x: Column, seed: int) -> Column:
    """One pairing: random mass (size times probability) goes from one unit to the other until one is integral.

    The direction is drawn so that each probability keeps its expectation; the sum of masses stays as it is.
    """
    cur = state["cur"]
    room_c, mass_c = (1 - cur["p"]) * cur["size"], cur["p"] * cur["size"]
    room_x, mass_x = (1 - x["p"]) * x["size"], x["p"] * x["size"]
    draw = F.pmod(F.xxhash64(cur["h"], x["h"], cur["twin"], x["twin"], F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    moves = F.struct(F.least(room_c, mass_x).alias("up"), F.least(mass_c, room_x).alias("down"), draw.alias("draw"))

    def chosen(m: Column) -> Column:
        up = m["draw"] * (m["up"] + m["down"]) <= m["down"]
        return F.struct(
            up.alias("up"),
            F.when(up, room_c <= mass_x).otherwise(mass_c <= room_x).alias("cur_done"),
            (cur["p"] + F.when(up, m["up"]).otherwise(-m["down"]) / cur["size"]).alias("cp"),
            (x["p"] + F.when(up, -m["up"]).otherwise(m["down"]) / x["size"]).alias("xp"),
        )

    def settled(c: Column) -> Column:
        one = lambda yes: F.when(yes, F.lit(1.0)).otherwise(F.lit(0.0))
        done = F.when(c["cur_done"], _unit(cur, one(c["up"]))).otherwise(_unit(x, one(~c["up"])))
        rest = F.when(c["cur_done"], _unit(x, c["xp"])).otherwise(_unit(cur, c["cp"]))
        return F.struct(rest.alias("cur"), F.concat(state["done"], F.array(done)).alias("done"))

    return _let(_let(moves, chosen), settled)


def _unit(u: Column, p: Column) -> Column:
    return F.struct(u["size"].alias("size"), u["h"].alias("h"), u["twin"].alias("twin"), u["doc_id"].alias("doc_id"), u["row"].alias("row"), u["copies"].alias("copies"), p.alias("p"))


def _paired(units: DataFrame, seed: int) -> DataFrame:
    """Rows of (source, blocks, unit): each block of a source is paired off, largest units first, to decided units and one left over."""
    block = F.pmod(F.xxhash64(F.col("unit.h"), F.col("unit.twin"), F.lit(seed)), F.col("blocks"))
    listed = units.groupBy("source", "blocks", block.alias("block")).agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
    first = F.col("units")[0]
    start = F.struct(first.alias("cur"), F.slice("units", 1, 0).alias("done"))
    return listed.select("source", "blocks", F.aggregate(F.expr("slice(units, 2, size(units))"), start, lambda s, x: _pivot(s, x, seed)).alias("s")).select("source", "blocks", "s.cur", "s.done")


def _closed(roots: DataFrame) -> DataFrame:
    """Decided units of sources that have come to one node: the unit left over takes its nearest copy, and the words this
    adds or loses are given back by turning over other units of that node, largest first, while that lessens them."""
    cur = F.col("cur")
    nearest = F.when(cur["p"] >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    start = F.struct(((nearest - cur["p"]) * cur["size"]).alias("off"), F.array(_unit(cur, nearest)).alias("out"))

    def turned(s: Column, u: Column) -> Column:
        off = s["off"] + (1 - 2 * u["p"]) * u["size"]
        turn = F.abs(off) < F.abs(s["off"])
        return F.struct(F.when(turn, off).otherwise(s["off"]).alias("off"), F.concat(s["out"], F.array(_unit(u, F.when(turn, 1 - u["p"]).otherwise(u["p"])))).alias("out"))

    return roots.select("source", F.explode(F.aggregate("done", start, turned)["out"]).alias("unit"))


def _with_twins(slim: DataFrame) -> DataFrame:
    """``slim`` with twin: 0, 1, ... among rows of equal doc_id and text, whose places thus differ; the same numbers however the
    rows are dealt. Tasks number their own rows, and a row for each of them says where they begin."""
    twins = staged(slim.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "mix-twins")
    if twins.isEmpty():
        return slim.withColumn("twin", F.lit(0).cast("long")).drop("part")
    total = slim.count()
    hot = twins.filter(F.col("n") * 200 > total).select("h")
    alone = slim.join(F.broadcast(hot), "h", "left_anti").join(twins, "h", "left_anti").withColumn("twin", F.lit(0).cast("long"))
    many = join_by_weight(slim, twins, "h", "n", total).drop("n")
    sizes = many.groupBy("h", "part").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(W.partitionBy("h").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("h", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("h", "part").orderBy("row"))
    many = many.withColumn("place", place).join(sizes, ["h", "part"]).withColumn("twin", (F.col("before") + F.col("place") - 1).cast("long"))
    columns = [c for c in slim.columns if c != "part"] + ["twin"]
    return staged(alone.select(columns).unionByName(many.select(columns)), "mix-rows")


def mix_to_weights(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, text: str = "text", source: str = "source", doc_id: str = "doc_id", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Each source's target is in words (see source_targets()). A document is due target / source_size copies: the whole
    part is taken outright, the fractional part is a probability that pivotal rounding turns into 0 or 1. Units of one
    source are dealt to blocks of about ``fan_in`` by hash and paired off there, which leaves one undecided unit a
    block; these go up a tree in which each level is dealt and paired the same way, until a source has one unit left.
    Every pairing preserves the source's words; what the last unit's rounding adds or loses (half of one document at
    most) is given back within that last node, see _closed(). All draws are hashes of doc_id, text and, among
    rows that are equal in both, a number: reruns agree on any number of partitions. A hot source only has more blocks, and so
    have very many equal rows.

    Nulls: a null text has size 0, a null source is a source, a null doc_id stays null. Documents without words, and
    all of an empty table, have nothing to decide. Rows repeated in full are separate units, each decided for itself.
    Other columns are ignored.
    """
    return _decided(docs, weights, share, most, text, source, doc_id, fan_in, F.lit(0)).drop("row")


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as mix_to_weights() takes it."""
    rows, row = numbered(docs)
    taken = _decided(rows, weights, share, most, text, source, doc_id, FAN_IN, F.col(row)).filter("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1).cast("long"), "copies").alias(f"_{row}_times"))
    joined = rows.join(taken, row)
    return joined.select(*[F.col(c) for c in rows.columns if c != row], F.explode(f"_{row}_times").alias(f"_{row}_time")).drop(f"_{row}_time")


def _decided(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, text: str, source: str, doc_id: str, fan_in: int, row: Column) -> DataFrame:
    """As mix_to_weights(), with each row's number."""
    size = F.coalesce(F.regexp_count(text_or_empty(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = staged(docs.select(row.cast("long").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(doc_id, text).alias("h"), F.spark_partition_id().alias("part")), "mix")
    slim = _with_twins(slim)
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = staged(source_targets(per_source.drop("n"), weights, share, most), "targets")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.select("source", F.floor(due).alias("copies"), (due - F.floor(due)).alias("p"))
    units = join_small_or_salted(slim, rates, "source")
    undecided = (F.col("p") > 0) & (F.col("size") > 0)
    plain = units.filter(~undecided).select("row", "doc_id", "source", "size", "copies")

    unit = F.struct(F.col("size").cast("double").alias("size"), "h", "twin", "doc_id", "row", "copies", "p").alias("unit")
    blocks = targets.select("source").join(per_source.select(F.col("source").alias("_s"), F.ceil(F.col("n") / fan_in).alias("blocks")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    level = join_small_or_salted(units.filter(undecided), blocks, "source").select("source", "blocks", unit)
    parts, seed = [], 1
    while True:
        paired = staged(_paired(level, seed), f"mix-level{seed}")
        at_root = F.col("blocks") <= 1
        parts += [paired.filter(~at_root).select("source", F.explode("done").alias("unit")), _closed(paired.filter(at_root))]
        most_blocks = paired.agg(F.max("blocks")).first()[0]
        if most_blocks is None or most_blocks <= 1:
            break
        level = paired.filter(~at_root).select("source", F.col("cur").alias("unit"), F.ceil(F.col("blocks") / fan_in).alias("blocks"))
        seed += 1
    last = reduce(DataFrame.unionByName, parts)
    rounded = last.select("unit.row", "unit.doc_id", "source", F.col("unit.size").cast("long").alias("size"), (F.col("unit.copies") + F.col("unit.p").cast("long")).alias("copies"))
    out = join_small_or_salted(plain.unionByName(rounded), targets, "source")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", F.col("copies").cast("long").alias("copies"), "row")
