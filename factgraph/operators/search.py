"""Breadth-first search from many starts for the first marked node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.shared import cut_lineage, forget

#: No longer read: searches had places in a queue, which stayed below this.
FARTHEST = 1 << 62
#: Rounds whose nodes are written as one.
LEVELS = 8


def first_chain(edges: DataFrame, starts: DataFrame, marked: DataFrame) -> DataFrame:
    """(start, hit, depth, chain): the marked node that a breadth-first search from each start meets first, and the way.

    ``edges``: src, dst, ord (the order in which a node's edges are followed, from 0 on).  A search meets the nodes of a level in
    the order of their least ways, compared edge by edge.  So the first way to a marked node goes, from each node on it, along
    the first edge to a node that is nearer to a marked one.  How near each node is comes from one search backwards from all
    marked nodes, in which a node is a row, however many starts there are; the ways follow over pointers of doubling length.
    """
    links = cut_lineage(edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("ord").cast("long").alias("ord")))
    asked = cut_lineage(starts.select("start").where("start IS NOT NULL").distinct())
    left = asked.count()
    front = cut_lineage(marked.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    near, depth = front, 0
    while True:
        met = front.join(asked, F.col("node") == F.col("start"), "left").agg(F.count(F.lit(1)).alias("n"), F.count("start").alias("hit")).first()
        left -= met["hit"]
        if not left or not met["n"]:
            break
        depth += 1
        new = links.join(front.select(F.col("node").alias("to")), "to").select("node").distinct()
        front = cut_lineage(new.join(near.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        near = near.unionByName(front)
        if depth % LEVELS == 0:
            near = cut_lineage(near)
    there = near.select(F.col("node").alias("to"), F.col("depth").alias("__d"))
    first = links.join(there, "to").join(near, "node").where("__d = depth - 1").groupBy("node").agg(F.min_by("to", "ord").alias("above"))
    hits = cut_lineage(asked.join(near, F.col("start") == F.col("node")).select("start", "depth"))
    return _ways(hits, first)


def _ways(hits: DataFrame, first: DataFrame) -> DataFrame:
    """``hits`` with ``hit`` and ``chain``: the nodes from the start on, over ``first`` (node, above), ``depth`` times."""
    deepest = hits.agg(F.max("depth")).first()[0] or 0
    way, up, long = hits.select("start", F.col("start").alias("node"), F.lit(0).alias("at")), cut_lineage(first), 1
    while long <= deepest:
        way = cut_lineage(way.unionByName(way.join(up, "node").select("start", F.col("above").alias("node"), (F.col("at") + long).alias("at"))))
        long *= 2
        if long <= deepest:
            next_up = up.select(F.col("node").alias("above"), F.col("above").alias("top"))
            old, up = up, cut_lineage(up.join(next_up, "above").select("node", F.col("top").alias("above")))
            forget(old)
    chain = F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])
    ways = way.groupBy("start").agg(chain.alias("chain"))
    return hits.join(ways, "start").select("start", F.element_at("chain", -1).alias("hit"), "depth", "chain")
