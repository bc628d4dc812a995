"""Connected components: forests within partitions, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import keep

#: Edges that one task shrinks in memory.
EDGES = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half step over edges (u, v) with u > v: what u sees is hung onto the least of it.

    The minimum of a node combines before the shuffle, and the join back on it splits like any skewed join.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as (node, least node of its tree)."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
    nodes, index = np.unique(np.concatenate([np.concatenate(u), np.concatenate(v)]), return_inverse=True)
    n = len(index) // 2
    a, b = index[:n], index[n:]
    root = np.arange(len(nodes))
    while True:
        # hang the greater root of each edge onto the lesser, then halve the paths
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    tree = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tree]), pa.array(nodes[root[tree]])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of its component.

    Each partition first shrinks its edges to a forest, at most EDGES of them in one. Where several partitions are left, rounds
    of large and small stars join their trees until nothing changes; each is kept in the shared folder.
    """
    edges = keep(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    parts = max(1, -(-edges.count() // EDGES))
    forest = (edges.repartition(parts) if parts > 1 else edges.coalesce(1)).mapInArrow(_forest, "u long, v long")
    edges = keep(forest)
    sign = None
    while parts > 1:
        edges = keep(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    tree = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
