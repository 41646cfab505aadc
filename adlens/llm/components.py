"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Every round points the larger neighbours of each node, then the node and
    its smaller neighbours, at the smallest of them, until nothing changes;
    paths shorten by about half a round.  Minima are taken on the map side
    first, so a node with very many links costs no more than its rows.  Each
    round is a written table, so a lost executor repeats one round at most.
    """
    edges = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where("u <> v").distinct())
    edges = write_table(edges, "components")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = write_table(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = write_table(small, "components")
        same = after.exceptAll(edges).isEmpty() and after.count() == edges.count()
        edges = after
        if same:
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().join(nodes, "node", "left_anti")
    return nodes.unionByName(roots.select("node", F.col("node").alias("component")))
