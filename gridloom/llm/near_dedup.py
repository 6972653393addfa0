"""Near duplicates by consistent weighted sampling over TF-IDF word shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import Layout, marks, slice_bits, tested
from .common import join_by_weight, numbered, released, staged, text_or_empty, without_rows
from .components import connected
from .shingles import (
    ConsistentSampler,
    Weigher,
    arrow_bytes,
    bucket_of,
    features,
    node_keys,
    outlines,
    runs,
    similarity_bounds,
    unpacked,
    weighted_jaccard,
    word_hashes,
)

#: Words of a shingle, the least similarity, bands and rows of a band (a pair at 0.8 shares a band with probability 0.997).
SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 8, 3
#: Document frequencies are counted in this many hash buckets, of which a task sends its counts in slices of SLICE.
BUCKETS, SLICE = 1 << 18, 1 << 12
#: A shingle in fewer than one of RARE documents has the full weight, whatever the size of the corpus.
RARE = 64
#: Outsiders of a bucket that a task holds and their bytes, members that stream past them, and nodes of a hub that one copy
#: of its text is compared to: parts of a bucket or a hub, so that however large it is, tasks stay as they are.
BLOCK, BLOCK_BYTES, RUN, PART = 256, 8 << 20, 512, 64


def idf_table(texts: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """From all rows of (text): an inverse document frequency between 1 and 1.5 for each bucket.

    It is 1 + ln(n / df) / (2 ln RARE), and 1.5 where df is under n / RARE. What other shingles add to a bucket by
    chance is a fixed share of n, is taken off and lies under n / RARE, so weights stay as they are at any size of the
    corpus. The bound of 1.5 matters: the shingles that an edit makes are new to the corpus, while those that thousands
    of copies share are frequent, so that unbounded weights would pull copies of one text apart the more the more of
    them there are. Each task counts its own documents; its counts travel in slices of SLICE buckets and are added up a
    slice at a time, so the driver gets BUCKETS numbers and no more.
    """

    def counted(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            data, at = arrow_bytes(b.column(0))
            for first, last in runs(at):
                _, feature, _ = features(*word_hashes(data, at[first : last + 1]), size)
                n += np.bincount(bucket_of(feature, BUCKETS), minlength=BUCKETS)
        parts = n.reshape(-1, SLICE)
        some = np.flatnonzero(parts.any(axis=1))
        task = pa.array(np.full(len(some), TaskContext.get().partitionId() % 16), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), task, pa.array([parts[k].tobytes() for k in some], pa.binary())], ["slice", "task", "n"])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column("slice").to_pylist(), b.column("n").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "n"])

    kind = "slice int, n binary"
    # two steps of sums: a slice's parts are dealt to several tasks first
    some = texts.select("text").mapInArrow(released(counted), "slice int, task int, n binary").repartition("slice", "task").mapInArrow(added, kind)
    df = np.zeros(BUCKETS)
    for r in some.repartition("slice").mapInArrow(added, kind).toLocalIterator():
        df[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(bytes(r["n"]), np.int64)
    n = max(1, texts.count())
    # chance adds about as much to a bucket as it holds in the middle
    df = np.maximum(df - np.median(df), 1)
    return (1 + 0.5 * np.clip(np.log(n / df) / np.log(RARE), 0, 1)).astype(np.float32)


def _signatures(full: DataFrame, idf, size: int, bands: int, rows: int) -> DataFrame:
    """The rows of ``full`` without text, with node (a key of the text's words), bands (a 64-bit key each; none for texts
    without words), outline and rarity (the mean idf of its shingles)."""

    def signed(batches):
        sample, weigh = ConsistentSampler(bands * rows), Weigher(idf.value)
        for b in batches:
            data, at = arrow_bytes(b.column("text"))
            rest = b.drop_columns(["text"])
            for first, last in runs(at):
                flat, counts = word_hashes(data, at[first : last + 1])
                n = last - first
                owner, feature, tf = features(flat, counts, size)
                weight = weigh(feature, tf)
                found = sample(owner, feature, weight, n)
                outline = outlines(owner, feature, weight, n)
                rarity = np.bincount(owner, weights=weight, minlength=n) / np.maximum(np.bincount(owner, weights=tf, minlength=n), 1)
                keys = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    keys = (keys ^ found[:, k::rows]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(32)
                has = counts > 0
                ends = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                node = pa.array([x.tobytes() for x in node_keys(flat, counts)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].ravel().view(np.int64)))
                made = [node, lists, pa.array([x.tobytes() for x in outline], pa.binary()), pa.array(rarity)]
                yield pa.RecordBatch.from_arrays([*rest.slice(first, n).columns, *made], [*rest.schema.names, "node", "bands", "outline", "rarity"])

    schema = T.StructType([f for f in full.schema if f.name != "text"])
    schema = schema.add("node", "binary").add("bands", T.ArrayType(T.LongType())).add("outline", "binary").add("rarity", "double")
    return full.mapInArrow(released(signed), schema)


def _similar(pairs: DataFrame, texts: DataFrame, idf, least: float, size: int) -> DataFrame:
    """Of (node, hub, n) those (node, hub) whose weighted similarity is ``least`` or more; a hub has about ``n`` nodes at most.

    A node's text goes to its hubs. A hub's text goes once to each part of about PART of its nodes, so a hub of very many
    nodes is spread; within a part it comes first, and the nodes stream past it.
    """

    def verified(batches):
        weigh, hub = Weigher(idf.value), (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        for b in batches:
            data, at = arrow_bytes(b.column("text"))
            is_hub = b.column("is_hub").to_pylist()
            keep = []
            for first, last in runs(at):
                owner, feature, tf = features(*word_hashes(data, at[first : last + 1]), size)
                w, ends = weigh(feature, tf), np.searchsorted(owner, np.arange(last - first + 1))
                for k in range(last - first):
                    own = feature[ends[k] : ends[k + 1]], w[ends[k] : ends[k + 1]]
                    if is_hub[first + k]:
                        hub = own
                    elif weighted_jaccard(*own, *hub) >= least:
                        keep.append(first + k)
            yield b.select(["node", "hub"]).take(pa.array(keep, pa.int64()))

    salted = pairs.select("node", "hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART)).alias("salt"))
    nodes = salted.join(texts, "node").select("hub", "salt", F.lit(False).alias("is_hub"), "node", "text")
    hubs = salted.select("hub", "salt").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "salt", F.lit(True).alias("is_hub"), F.col("hub").alias("node"), "text")
    dealt = hubs.unionByName(nodes).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub"))
    return dealt.select("hub", "node", "is_hub", "text").mapInArrow(released(verified), "node binary, hub binary")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    Texts link if the weighted Jaccard similarity of their TF-IDF word shingles (lower case, ``size`` words) is ``least``
    or more; a class is a connected component of links, its id the smallest doc_id in it, and that row is kept. Texts
    with the same words are one node. Nodes that share a band's bucket are candidates; the links among them are found
    up to those within one class, without pairing off buckets:

    1. A bucket's hub is its node with the least rare shingles, which of many edited copies is one with few edits. All
       others are compared to it, and nearly all copies of one text become one class.
    2. Nodes outside the hub's class are compared to all members of the bucket that are in other classes.

    Outlines (weights by hash group) give a bound that a similarity can't pass: pairs under it need no look at their
    shingles. Pairs that are in one class by then are left out, and no other: there is no cap.

    Nulls: a null text is empty; texts without words are equal to each other only; a null doc_id sorts last and stays
    null. Texts of fewer than ``size`` words have one shingle of them all. Repeated rows are rows of a class of which
    one is kept. Empty tables give empty results; other columns are ignored.
    """
    return _decided(docs, text, doc_id, F.monotonically_increasing_id(), size, least, bands, rows).drop("row")


def _decided(docs: DataFrame, text: str, doc_id: str, row: Column, size: int = SHINGLE, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As near_duplicates(), with each row's number."""
    full = docs.select(row.alias("row"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    # a text's own key, by which it is found again: two hashes of 64 bits
    raw = F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("text"), F.xxhash64(F.lit(7), "text"))]))
    full = full.withColumns({"raw": raw, "size": F.octet_length("text")})
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(full, size))
    signed = staged(_signatures(full, idf, size, bands, rows), "near-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    form = F.first(F.struct("bands", "outline", "rarity", "raw", "size")).alias("form")
    nodes = staged(signed.groupBy("node").agg(best, F.count(F.lit(1)).alias("copies"), form).select("node", "best", "copies", "form.*"), "near-nodes")
    total = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    labels = _labels(full, nodes, idf, total, size, least)
    return _classes(signed.select("row", "doc_id", "node"), nodes.select("node", "best", "copies"), labels, total)


@F.pandas_udf(T.BooleanType())
def _may_reach(a, b, least):
    import pandas as pd

    if not len(a):
        return pd.Series(np.zeros(0, bool))
    (a_low, a_high), (b_low, b_high) = unpacked(a.tolist()), unpacked(b.tolist())
    bound = np.minimum(a_high, b_high).sum(axis=1) / np.maximum(np.maximum(a_low, b_low).sum(axis=1), 1e-30)
    return pd.Series(bound >= least.to_numpy())


def _met(open_: DataFrame, texts: DataFrame, idf, least: float, size: int) -> DataFrame:
    """Links (node, hub) of the rest of open buckets, from (bucket, n, rest, bytes, node, cls, outline, outside) for their members.

    Outsiders are dealt to blocks of about BLOCK nodes and bounded bytes, members to runs of about RUN nodes. A task holds
    a block's features; a run of members streams past. Of pairs in two classes whose outlines may be similar enough the
    similarity is computed, and what links is one class from then on: a task gives a link only where it joins two classes,
    so it never gives more links than it has nodes.
    """
    blocks = F.greatest(F.ceil(F.col("rest") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    members_runs = F.ceil(F.col("n") / RUN)
    with_text = open_.join(texts, "node")
    members = with_text.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.pmod(F.xxhash64("node"), members_runs).alias("run"), F.lit(True).alias("member"), "node", "cls", "outline", "text")
    outsiders = with_text.filter("outside").select("bucket", F.pmod(F.xxhash64("node", F.lit(3)), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), members_runs - 1)).alias("run"), F.lit(False).alias("member"), "node", "cls", "outline", "text")

    def linked(batches):
        weigh, at_key, held, forms, parent = Weigher(idf.value), None, [], None, {}

        def root(x: bytes) -> bytes:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        for b in batches:
            data, at = arrow_bytes(b.column("text"))
            keys = list(zip(*[b.column(c).to_pylist() for c in ("bucket", "block", "run")], strict=True))
            member, node, cls, outline = (b.column(c).to_pylist() for c in ("member", "node", "cls", "outline"))
            out: list[tuple[bytes, bytes]] = []
            for first, last in runs(at):
                owner, feature, tf = features(*word_hashes(data, at[first : last + 1]), size)
                w, ends = weigh(feature, tf), np.searchsorted(owner, np.arange(last - first + 1))
                for k in range(first, last):
                    own = feature[ends[k - first] : ends[k - first + 1]], w[ends[k - first] : ends[k - first + 1]]
                    if keys[k] != at_key:
                        at_key, held, forms, parent = keys[k], [], None, {}
                    if not member[k]:
                        held.append((node[k], cls[k], outline[k], *(x.copy() for x in own)))
                        continue
                    if forms is None:
                        forms = unpacked([x[2] for x in held])
                    bound = similarity_bounds(unpacked([outline[k]]), forms)[0]
                    for j in np.flatnonzero(bound >= least).tolist():
                        one, other = root(cls[k]), root(held[j][1])
                        if one != other and weighted_jaccard(*own, held[j][3], held[j][4]) >= least:
                            parent[other] = one
                            out.append((node[k], held[j][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["node", "hub"])

    dealt = members.unionByName(outsiders).repartition("bucket", "block", "run").sortWithinPartitions("bucket", "block", "run", "member")
    return dealt.mapInArrow(released(linked), "node binary, hub binary").distinct()


def _texts_of(full: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for rows of (node, raw). While one slice of a Bloom filter holds all wanted keys, it spares the shuffle most
    other texts; copies meet before the shuffle, and the join leaves out the rest."""
    wanted = staged(wanted, "near-wanted")
    layout = Layout(wanted.count())
    rows = full.select("raw", "text")
    if layout.slices == 1:
        rows = tested(rows, "raw", 0, slice_bits(marks(wanted, "raw", layout), 0, layout), layout).filter("maybe")
    return rows.groupBy("raw").agg(F.first("text").alias("text")).join(wanted, "raw").select("node", "text")


def _labels(full: DataFrame, nodes: DataFrame, idf, total: int, size: int, least: float) -> DataFrame:
    """(node, cls) for all nodes that have a link."""
    at = nodes.select("node", "rarity", "size", F.posexplode("bands").alias("band", "key")).select("node", "rarity", "size", F.xxhash64("band", "key").alias("bucket"))
    first = F.min(F.struct("rarity", "node")).alias("first")
    shared = staged(at.groupBy("bucket").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "n", F.col("first.node").alias("main")), "near-buckets")
    members = staged(join_by_weight(at.select("bucket", "node", "size"), shared, "bucket", "n", total), "near-members")
    outline = nodes.select("node", "outline")

    pairs = members.filter(F.col("node") != F.col("main")).groupBy("node", F.col("main").alias("hub")).agg(F.max("n").alias("n"))
    mains = shared.groupBy(F.col("main").alias("node")).agg(F.sum("n").alias("w")).join(outline, "node").select(F.col("node").alias("hub"), "w", F.col("outline").alias("hub_outline"))
    pairs = join_by_weight(pairs.join(outline, "node"), mains, "hub", "w", total).filter(_may_reach("outline", "hub_outline", F.lit(least)))
    pairs = staged(pairs.select("node", "hub", "n"), "near-pairs")

    texts = staged(_texts_of(full, members.select("node").distinct().join(nodes.select("node", "raw"), "node")), "near-texts")
    found = staged(_similar(pairs, texts, idf, least, size), "near-links")
    labels = connected(found)
    label = labels.select(F.col("node").alias("_node"), F.col("cls").alias("_cls"))
    of = lambda rows, node, cls: rows.join(label, F.col(node) == F.col("_node"), "left").withColumn(cls, F.coalesce("_cls", node)).drop("_node", "_cls")
    mains = of(shared, "main", "main_cls").select("bucket", "main_cls", F.col("n").alias("_n"))
    now = join_by_weight(of(members.select("bucket", "n", "node", "size"), "node", "cls"), mains, "bucket", "_n", total)
    now = staged(now.select("bucket", "n", "node", "size", "cls", (F.col("cls") != F.col("main_cls")).alias("outside")), "near-now")
    rest = staged(now.filter("outside").groupBy("bucket").agg(F.count(F.lit(1)).alias("rest"), F.sum("size").alias("bytes"), F.first("n").alias("_n")), "near-open")
    if rest.isEmpty():
        return labels
    open_ = join_by_weight(now.drop("size"), rest, "bucket", "_n", total).drop("_n").join(outline, "node")
    found = staged(_met(open_, texts, idf, least, size), "near-links")
    return labels if found.isEmpty() else connected(labels.select("node", F.col("cls").alias("hub")).unionByName(found))


def _classes(slim: DataFrame, nodes: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    nodes = staged(nodes.join(labels, "node", "left"), "near-classes")
    own = nodes.filter("cls IS NOT NULL")
    classes = staged(own.groupBy("cls").agg(F.min("best").alias("keep"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n")), "near-classes")
    single = nodes.filter("cls IS NULL").select("node", "copies", F.col("best").alias("keep"), F.col("copies").alias("class_size"))
    multi = join_by_weight(own, classes, "cls", "n", total).select("node", "copies", "keep", "class_size")
    rows = join_by_weight(slim, single.unionByName(multi), "node", "copies", total)
    return rows.select("doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("keep.row")).alias("kept"), "row")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that near_duplicates() keeps, with all their columns; null and repeated doc ids are no matter."""
    rows, row = numbered(docs)
    return without_rows(rows, _decided(rows, text, doc_id, F.col(row)).filter("NOT kept"), row)
