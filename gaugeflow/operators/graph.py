"""Connected components of an edge table, distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Staged


class Forest:
    """Links of numbered nodes, reduced to a star for each component while they are gathered."""

    def __init__(self):
        self.a, self.b, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.size += len(a)
        if self.size > 1_000_000:
            self.reduce()

    def reduce(self) -> None:
        a = np.concatenate([self.a, *(x for x, _ in self.waiting)])
        b = np.concatenate([self.b, *(x for _, x in self.waiting)])
        self.waiting, self.size = [], 0
        nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
        u, v = ends[: len(a)], ends[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while not np.array_equal(root, up := root[root]):
                root = up
            if np.array_equal(root, before):
                break
        self.a, self.b = nodes[root != np.arange(len(nodes))], nodes[root[root != np.arange(len(nodes))]]


#: Links that a task holds at once; beyond it starts anew.
MOST_LINKS = 2_000_000
#: Links that a task is given, once tasks have replaced their own by stars.
TASK_LINKS = 500_000


def _contracted(batches):
    """Edges (u, v) of a task as one from each node to the least one that it reaches by them."""
    forest = Forest()

    def stars():
        forest.reduce()
        return pa.RecordBatch.from_arrays([pa.array(forest.a), pa.array(forest.b)], ["u", "v"])

    for batch in batches:
        forest.add(batch.column("u").to_numpy(), batch.column("v").to_numpy())
        if len(forest.a) + forest.size > MOST_LINKS:
            yield stars()
            forest = Forest()
    yield stars()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges(a, b)`, which are long; root is the smallest node reachable.

    Every task replaces its own edges by stars, which link the same nodes, before a table is written. What is
    left is dealt over a task for each TASK_LINKS of it; if one is enough, its stars are the components. Else
    large-star and small-star steps alternate: each takes the minimum of every node's
    neighbours (pre-aggregated before the shuffle, so a hub with very many neighbours is one row
    a task) and joins it back. A round ends the loop when every node points at one root.
    Self loops and null ends are dropped; an empty table gives no rows.
    """
    contracted = lambda df: Staged(df.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_contracted, "u long, v long"), "edges")
    # Every node points at a smaller one: (u, v) with u > v.
    start = edges.dropna(subset=["a", "b"]).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = contracted(start.filter("u <> v"))
    for _ in range(rounds):
        tasks = -(-now.df.count() // TASK_LINKS)
        if tasks < 2:
            whole = contracted(now.df.coalesce(1))
            now.drop()
            now = whole
            break
        e = now.df
        ends = e.select(F.col("u").alias("node"), F.col("v").alias("up")).union(e.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))
        ups = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.count("up").alias("n"), F.count("*").alias("all"))
        if ups.filter("low < high OR n > 0 AND n < all").isEmpty():
            break
        # Large star: every neighbour above a node is linked to the least of node and neighbours.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its lower neighbours are linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = contracted(small.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        now.drop()
        now = following
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return ends.distinct()
