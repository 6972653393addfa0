"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_weight, staged

#: Links, counted first, that one task joins by itself; more of them take the steps over tables. Both give the same classes.
ONE_TASK = 200_000


def connected(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, cls) for the nodes of undirected (node, hub) links of binary keys: cls is the least node of the component."""
    edges = staged(edges.select("node", "hub").distinct(), "links")
    return staged(_joined(edges), "labels") if edges.count() <= one_task else _spread(edges)


def _joined(edges: DataFrame) -> DataFrame:
    def joined(batches):
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = sorted((root(x), root(y)))
                parent[y] = x
        nodes = list(parent)
        for k in range(0, len(nodes), 10_000):
            some = nodes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([root(x) for x in some], pa.binary())], ["node", "cls"])

    return edges.coalesce(1).mapInArrow(joined, "node binary, cls binary")


def _spread(edges: DataFrame) -> DataFrame:
    """Each step takes the least label among the neighbours, then the label of that label, until none changes. Nodes of many
    links and classes of many nodes are hot keys, so their few rows of the table they meet are broadcast."""
    both = edges.unionByName(edges.select(F.col("hub").alias("node"), F.col("node").alias("hub"))).distinct()
    both = staged(both, "links")
    total = both.count()
    degrees = staged(both.groupBy("node").agg(F.least(F.col("node"), F.min("hub")).alias("cls"), F.count(F.lit(1)).alias("n")), "labels")
    labels = degrees
    while True:
        near = join_by_weight(both, labels.select(F.col("node").alias("hub"), "cls", "n"), "hub", "n", total).select("node", "cls")
        least = near.groupBy("node").agg(F.min("cls").alias("near"))
        least = staged(labels.join(least, "node").select("node", F.least("cls", "near").alias("cls"), F.col("cls").alias("old"), "n"), "labels")
        sizes = least.groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
        jump = sizes.join(least.select(F.col("node").alias("cls"), F.col("cls").alias("further")), "cls")
        new = staged(join_by_weight(least, jump, "cls", "size", total).select("node", F.least("cls", "further").alias("cls"), "old", "n"), "labels")
        if new.filter("cls <> old").isEmpty():
            return new.select("node", "cls")
        labels = new.drop("old")
