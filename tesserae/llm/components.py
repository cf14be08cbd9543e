"""Connected components of links between whole numbers, without a task that holds all links of a hub.

A link points from its larger to its smaller end. Dealt by the larger end, each task joins its links by union-find and
hands on one link a node, to the least node it is joined with; so no node has more links than there are tasks, however
many point at it. Links that now start elsewhere are dealt again. When none does, every node has one link, to a
smaller node, and following links of links finds the roots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_small, partitions, tidy


class Forest:
    """Union-find on 0 to n - 1 by arrays; a root is the least of its tree."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            p = self.parent[i]
            if (p == i).all():
                return i
            i = p

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while i.size:
            i, j = self.roots(i), self.roots(j)
            keep = i != j
            i, j = i[keep], j[keep]
            np.minimum.at(self.parent, np.maximum(i, j), np.minimum(i, j))


def _contract(batches):
    """One link a node of the partition's links (u, v), to the least node it is joined with; moved: the node had no link
    that starts here."""
    u, v = [], []
    for b in batches:
        u.append(b.column("u").to_numpy())
        v.append(b.column("v").to_numpy())
    if not u:
        return
    starts = np.concatenate(u)
    nodes, at = np.unique(np.concatenate([starts, *v]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.link(at[: len(starts)], at[len(starts) :])
    roots = forest.roots(np.arange(len(nodes)))
    tied = np.flatnonzero(roots != np.arange(len(nodes)))
    home = np.zeros(len(nodes), bool)
    home[at[: len(starts)]] = True
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[roots[tied]]), pa.array(~home[tied])], ["u", "v", "moved"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the least node that it reaches.

    Nodes without links don't occur in the result; null ends and loops are ignored, repeated links count once; no
    links, no rows.
    """
    n = partitions(links.sparkSession)
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        edges = checkpointed(edges.select("u", "v").repartition(n, "u").mapInArrow(tidy(_contract), "u long, v long, moved boolean"))
        if edges.filter("moved").isEmpty():
            break
    tree = edges.select("u", "v")
    while True:  # the ends that are no roots, once each, so that a hub is no task's burden
        up = tree.select(F.col("u").alias("v"), F.col("v").alias("_up"))
        up = checkpointed(up.join(tree.select("v").distinct(), "v"))
        if up.isEmpty():
            break
        tree = checkpointed(join_small(tree, up, "v", F.col("u")).select("u", F.coalesce("_up", "v").alias("v")))
    roots = tree.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
