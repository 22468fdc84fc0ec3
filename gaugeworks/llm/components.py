"""Connected components of a graph of ids, by the smallest id each node can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import stage


def _roots(up: DataFrame) -> DataFrame:
    """(node, root) of a forest of (node, root), root a smaller node: two doublings of the steps a round."""
    while True:
        for _ in range(2):
            above = up.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            further = up.join(above, "root", "left").withColumn("moved", F.col("beyond").isNotNull())
            up = further.select("node", F.coalesce("beyond", "root").alias("root"), "moved")
        further = stage(up)
        up = further.select("node", "root")
        if further.where("moved").isEmpty():
            return up


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Every node is put below its smallest neighbour, if that is smaller, and each of the trees that come
    of it becomes one node: a round leaves only the edges between trees, each once, so all rounds
    together move little more than the first. At the end the rounds' trees are put together, from the
    last to the first. Every round is written, which ends its lineage.
    """
    pair = edges.select(F.least(left, right).alias("low"), F.greatest(left, right).alias("high")).where("low <> high")
    pair = stage(pair.distinct())
    trees = []
    while not trees or not pair.isEmpty():
        up = _roots(pair.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")))
        trees.append(up)
        # a node with a smaller neighbour has a tree, the other end may be a tree's top
        moved = pair.join(up.toDF("high", "y"), "high").join(up.toDF("low", "x"), "low", "left").withColumn("x", F.coalesce("x", "low"))
        pair = stage(moved.where("x <> y").select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct())
    found = trees.pop()
    while trees:
        up = trees.pop()
        over = found.toDF("root", "component")
        below = up.join(over, "root", "left").select("node", F.coalesce("component", "root").alias("root"))
        found = stage(below.union(found))
    tops = found.select(F.col("root").alias("node"), "root").distinct()
    return found.union(tops).toDF("node", "component")
