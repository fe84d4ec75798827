"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import checkpointed


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of numbers, as links of each to the smallest that these reach: fewer than there are numbers, and tasks that see the same group give the same ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low != high
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while ((further := label[label]) != label).any():
            label = further
    led = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[led], nodes[label[led]]


def _settled(edges: DataFrame) -> bool:
    """Whether every link joins a node to its root: a node has one link down, and what that leads to has none."""
    ends = edges.select(F.expr("stack(2, a, 1, b, 0) as (node, down)"))
    downs = ends.groupBy("node").agg(F.sum("down").alias("downs"), F.min("down").alias("least"))
    return downs.where("downs > 1 or downs = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links with (a, b), comparable ids: (node, root), root the smallest id reachable; nodes without links are left out.

    Each round joins a node's links with its smallest neighbour, which AQE may split for a hot node, and
    takes minima that Spark combines before the shuffle. Rounds go on until only stars are left; their number
    grows as the logarithm of the longest path squared at worst.
    """
    # All links lead down, from a to a smaller b.
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(edges):
        least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low"))
        down = edges.join(least, "b", "left").select("a", F.coalesce("low", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = checkpointed(small.union(low.select("a", F.col("low").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
