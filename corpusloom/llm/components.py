"""Connected components: one task for a graph of bounded size, alternating star operations for a larger one.

A star round takes seven shuffles, whose tasks the driver plans, follows and remembers
however few edges there are.  So rounds (each written to the shared folder) are only for
graphs that one task should not hold; both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.shared import drop_stash, stash

ALONE = 1 << 19  # edges that one task settles, 8 MB of ids


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges and the least node reachable from each.

    Roots hook onto smaller ones next to them, then every node looks up its root; two such
    steps at least halve the roots that have others beside them.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def settled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`a, b` of a whole graph -> `node, component`."""
    held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if held:
        nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One star operation on edges `a < b`: links a node's neighbours to the least of them.

    The least neighbour is a grouped minimum that is joined back, so a node with very many
    neighbours is never gathered in one task.
    """
    both = pairs if small else pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    center, other = ("b", "a") if small else ("a", "b")
    near = both.select(F.col(center).alias("c"), F.col(other).alias("o"))
    least = near.groupBy(F.col("c").alias("k")).agg(F.least(F.min("o"), F.col("k")).alias("m"))
    linked = near.join(least, F.col("c") == F.col("k"))
    if small:
        out = linked.select(F.col("m").alias("a"), F.col("o").alias("b")).union(least.select(F.col("m").alias("a"), F.col("k").alias("b")))
    else:
        out = linked.filter("o > c").select(F.col("m").alias("a"), F.col("o").alias("b"))
    return out.filter("a <> b").groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b")


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """`a, b` (longs, any order) -> `node, component`, the least node reachable; isolated nodes don't appear.

    Graphs of over `alone` different edges go by star rounds.
    """
    tidy = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = stash(tidy.groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b"), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen[0] <= alone:
            return now.coalesce(1).mapInArrow(settled_batches, "node long, component long")
        if seen == mark:
            break
        mark = seen
        after = stash(_star(_star(now, small=False), small=True), "edges")
        drop_stash(now)
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
