"""Connected components by repeated contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); nodes of one component have the same root.

    Node ids should be hashes, so that their order is random: each round every node joins its least neighbour
    and edges are rewritten to what they joined, which leaves a fraction of the nodes. Loops, repeated edges
    and edges with a null end are ignored. Each round is cut at the shared checkpoint folder.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    assign = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        to = cut(to.select(F.col("a").alias("node"), "to"))
        at = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        bt = to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = cut(edges.join(at, "a").join(bt, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if assign is None:
            assign = to.withColumnRenamed("to", "root")
        else:
            step = to.select(F.col("node").alias("root"), F.col("to").alias("_to"))
            assign = cut(assign.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")))
    if assign is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # roots may themselves have joined another node in the round that assigned them
    while True:
        up = assign.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        nxt = cut(assign.join(up, "root", "left").select("node", F.coalesce("_to", "root").alias("root"), F.coalesce(F.col("_to") != F.col("root"), F.lit(False)).alias("moved")))
        assign = nxt.select("node", "root")
        if nxt.where("moved").isEmpty():
            return assign
