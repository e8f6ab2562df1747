"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.runtime import materialise


class Forest:
    """Union-find in which the smallest member is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            lo, hi = (a, b) if a < b else (b, a)
            self.up[hi] = lo
            self.up.setdefault(lo, lo)


def _local(frames):
    """Edges of one task as a forest: nothing is lost, long chains become stars."""
    for pdf in frames:
        forest = Forest()
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            forest.union(a, b)
        rows = [(x, forest.find(x)) for x in forest.up]
        yield pd.DataFrame([(x, r) for x, r in rows if x != r], columns=["a", "b"], dtype="int64")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. ``edges`` has a > b. Large: every neighbour above a node moves to the node's
    smallest neighbour. Small: a node and its smaller neighbours move to the smallest of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); the component is its smallest node."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    edges = materialise(edges.mapInPandas(_local, "a long, b long").distinct())
    mark = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
        edges = materialise(_star(_star(edges, True), False))
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
