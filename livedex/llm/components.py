"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round replaces edges by edges to the least neighbour: the large star links a node's larger neighbours to the
least of node and neighbours, the small star links the node and its smaller neighbours to the least one.  Components
are kept, edges never grow in number, and a few rounds end in stars around each component's least node.  Minima are
aggregated before the shuffle and written, so that a node with very many neighbours only weighs on a join of two tables,
which Spark splits where a key is frequent.  What a round wrote is deleted after the next one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    out = cut(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct())
    dropped(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    # a < b: the smaller neighbours of b; all of them, and b, go to the least
    least = cut(edges.groupBy("b").agg(F.min("a").alias("m")))
    linked = edges.join(least, "b")
    out = cut(linked.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(linked.select(F.col("m").alias("a"), "b")).where("a < b").distinct())
    dropped(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component: the least id) of every node of `edges` (a, b: longs); nodes without an edge aren't listed."""
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        half = _large(now)
        further = _small(half)
        dropped(now, half)
        # Stars are stable: no node is both a centre and a member, and no member has two centres.
        twice = further.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
        deep = further.select("a").distinct().join(further.select(F.col("b").alias("a")), "a", "left_semi").select(F.col("a").alias("b"))
        if twice.unionByName(deep).isEmpty():
            break
        now = further
    members = further.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return members.unionByName(further.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("component")))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number connected with each of 0..n-1 by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
