"""Connected components of an edge table, by hooking and contraction.

Each round hooks every node to its least neighbour, follows the hooks to their roots by pointer jumping, and renames the
edges' ends; edges inside a component vanish. Nothing is collected: every table is written to the shared folder, so joins
on a busy root start from fresh exchanges that adaptive execution can split, and minima are combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes as (a, b) with a < b; edges with a null end vanish."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that isn't the least of its component; edges: columns a, b of one integer type."""
    left = written(ordered(edges))
    roots = None
    while not left.isEmpty():
        hooks = written(left.groupBy("b").agg(F.min("a").alias("p")))
        while True:
            up = hooks.select(F.col("b").alias("b2"), F.col("p").alias("p2"))
            moved = written(hooks.join(up, F.col("p") == F.col("b2"), "left").select("b", F.coalesce("p2", "p").alias("p"), F.col("p2").isNotNull().alias("moved")))
            hooks = moved.select("b", "p")
            if moved.where("moved").isEmpty():
                break
        up = hooks.select(F.col("b").alias("b2"), F.col("p").alias("p2"))
        if roots is None:
            roots = hooks
        else:
            roots = written(roots.join(up, F.col("p") == F.col("b2"), "left").select("b", F.coalesce("p2", "p").alias("p")).unionByName(hooks))
        new_a = left.join(up, F.col("a") == F.col("b2"), "left").select(F.coalesce("p2", "a").alias("a"), "b")
        new = new_a.join(up, F.col("b") == F.col("b2"), "left").select("a", F.coalesce("p2", "b").alias("b"))
        left = written(ordered(new))
    if roots is None:
        roots = left.select("b", F.col("a").alias("p"))
    return roots.select(F.col("b").alias("node"), F.col("p").alias("component"))


class Forest:
    """Union of the nodes 0..n-1 of one task, batch by batch."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def links(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least id of the tree, id) for every other id of a tree with several ids."""
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, ids)
        low = least[self.root]
        other = low != ids
        pairs = np.unique(np.stack([low[other], ids[other]], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]
