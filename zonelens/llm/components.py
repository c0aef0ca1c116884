"""Connected components of a link table.

Nodes point at smaller nodes.  Each round keeps every node's smallest link, turns its
other links into links between those neighbours, and lets every node point at what its
parent points at.  Chains halve each round, and the rounds end when every node has one
link, to a node that has none: the smallest of its component.  Each round is an
aggregation and joins on the links, written to the shared folder (the last round alone
stays there); only whether anything moved comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelens.llm.common import cut, folder_of
from zonelens.session import remove_work


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of links (a, b); nodes without links are
    left out.  Links may repeat and go either way."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    last = folder_of(edges)
    while True:
        tree = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        up = tree.select(F.col("u").alias("m"), F.col("m").alias("above"))
        jumped = tree.join(up, "m", "left").select("u", F.coalesce("above", "m").alias("v"), F.col("above").isNotNull().alias("moved"))
        several = tree.where("most > m").select("u", "m")
        others = edges.join(several, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        state = cut(jumped.unionByName(others))
        edges = state.select("u", "v")
        remove_work(links.sparkSession, [last])
        last = folder_of(state)
        if state.where("moved").isEmpty():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
