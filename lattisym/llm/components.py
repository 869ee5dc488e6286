"""Connected components of an edge table by alternating large-star and small-star steps.

The published two-step scheme (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
each step is one grouped minimum and one join, so a hub's neighbours are never gathered in one place. The minima are cut off
before the join, so that Spark can split a hub's rows. At most SMALL edges, a bounded number that is counted first, are settled by a union-find in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task settles (16 bytes each). More go through star steps; both ways are exact.
SMALL = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def settle(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) by hooking roots to smaller ones and halving paths."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def _one_task(batches):
    table = [x for x in batches if x.num_rows]
    if table:
        u, v = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in table]) for c in ("u", "v"))
        nodes, least = settle(u, v)
        for s in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + 10_000]), pa.array(least[s : s + 10_000])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of an edge; component is the least id reachable. Self-loops and repeated edges change nothing."""
    now = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    if now.count() <= small:
        return cut(now.coalesce(1).mapInArrow(_one_task, "node long, component long"))
    before = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError("components did not settle")
