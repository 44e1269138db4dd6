"""Connected components of a graph of longs, by large and small stars over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, ship

#: Different edges that one task joins at once: a set number, whatever the size of the tables. Rounds of shuffles would take more files than it has rows.
FEW = 1 << 14


def _joined(batches):
    """(node, root) of all edges (a, b) of the task, a > b."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = np.fromiter(parent, np.int64, len(parent))
    for start in range(0, len(nodes), 65_536):
        some = nodes[start : start + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([root(x) for x in some.tolist()], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """From edges (a, b) of longs: (node, root) of each node that has an edge to another, root the least of its component. Up to `few` different
    edges are joined by one task; more of them by rounds:

    A large star links the greater neighbours of a node to its least one, a small star the smaller ones; both keep the
    components, and alternating them leaves stars after about log^2(n) rounds. Every round is an aggregate and a join
    on nodes; a hub's rows meet in joins, which adaptive execution splits, and in aggregates, which are summed before the
    shuffle. Rounds are cut by checkpoints. Only sums reach the driver."""
    stars = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = sign(stars)
    if seen[0] <= few:
        return ship(stars.coalesce(1)).mapInArrow(_joined, "node long, root long")
    while seen[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # greater neighbours went to the least one; a node keeps its own link to it, too
        large = large.union(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = checkpointed(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        now = sign(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b")).distinct())
