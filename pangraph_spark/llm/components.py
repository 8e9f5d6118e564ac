"""Connected components of large edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EDGES = "a long, b long"
#: Edges that one task may finish alone (16 MB); more go through the rounds of stars.
ONE_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, root)`` of every node of the edges that is not its component's least node."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while len(a):
        pa_, pb = parent[a], parent[b]
        low, high = np.minimum(pa_, pb), np.maximum(pa_, pb)
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def local_forests(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each partition's batches are contracted to stars."""

    def step(batch):
        node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield common.arrow(a=pa.array(node, pa.int64()), b=pa.array(root, pa.int64()))

    return common.map_arrow(edges.select("a", "b"), step, EDGES)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(a, b)``; the root is the component's least node.

    Alternates large and small stars until nothing changes.  No step needs the rows of a node together:
    least neighbours are pre-aggregated, and the join that hands them out is one that adaptive execution
    can split.
    """
    now = common.cut(local_forests(edges.where(F.col("a") != F.col("b"))).distinct())
    mark = _mark(now)
    if 0 < mark[0] <= ONE_TASK:
        now, mark = common.cut(_finish(now)), (0,)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = common.cut(small)
        if (then := _mark(new)) == mark:
            break
        now, mark = new, then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _finish(edges: DataFrame) -> DataFrame:
    """Stars of all components, for edges known to fit one task."""

    def run(batches):
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if found:
            node, root = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield common.arrow(a=pa.array(node, pa.int64()), b=pa.array(root, pa.int64()))

    return edges.repartition(1).mapInArrow(run, EDGES)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**31)))).first()
    return tuple(row)
