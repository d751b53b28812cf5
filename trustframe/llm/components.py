"""Connected components of a link table by contraction, all in Spark.

Each round hooks every node to its smallest neighbour, shortens the chains by
pointer jumping and replaces the links by links between the roots.  Only local
minima stay roots, so the nodes at least halve per round and the rounds grow
with the logarithm of the node count.  Links are never collected; each round
is written to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _jump(parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return (parent.join(up, parent["root"] == up["__n"], "left")
                  .select("node", F.coalesce("__r", "root").alias("root")))


def _relabel(links: DataFrame, parent: DataFrame, col: str) -> DataFrame:
    to = parent.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return (links.join(to, links[col] == to["__n"], "left")
                 .withColumn(col, F.coalesce("__r", col)).drop("__n", "__r"))


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node that has a link; root is one node of its component."""
    edges = written(links.select(F.col(u).alias("u"), F.col(v).alias("v"))
                         .where("u <> v").distinct(), "links")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = written(both.groupBy(F.col("u").alias("node"))
                             .agg(F.min("v").alias("m"))
                             .select("node", F.least("node", "m").alias("root")), "parents")
        while True:
            jumped = written(_jump(_jump(parent)), "parents")
            moved = (jumped.join(parent.withColumnRenamed("root", "was"), "node")
                           .where("root <> was").isEmpty())
            parent = jumped
            if moved:
                break
        label = (parent if label is None
                 else written(_relabel(label, parent, "root"), "labels"))
        edges = written(_relabel(_relabel(edges, parent, "u"), parent, "v")
                        .where("u <> v").distinct(), "links")
    if label is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return label
