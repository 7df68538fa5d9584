"""Levels and ancestors of acyclic graphs, over walks of doubling length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.operators import blocks
from factgraph.operators.graph import numbered
from factgraph.operators.relops import HOPS, along, condensed, contracted, doubled, strong_components, with_loops
from factgraph.operators.shared import cut_lineage, forget


def _nodes(step: DataFrame, nodes: DataFrame | None) -> DataFrame:
    own = step.select(F.col("s").alias("node")).union(step.select("d"))
    return (own if nodes is None else own.union(nodes.select("node"))).distinct()


def topological_levels(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
    """(node, level): edges of the longest walk that ends in a node; raises ValueError if there is a circle.

    A walk of n edges is one of 1, 2, 4, ... edges for each bit of n, one after another, so with walks of doubling length
    (squares of the edges, where the longest of parallel ones are all alike) each is applied once: a chain of 100,000 nodes
    takes 17 rounds.  Where walks get too many the graph is dense, and levels rise block by block.
    ``nodes`` (node) adds nodes without edges.
    """
    step = cut_lineage(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    return _levels(step, cut_lineage(_nodes(step, nodes)))[0]


def component_levels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, level) with each strong component as one node, named by its smallest."""
    step = cut_lineage(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    every, apart = cut_lineage(_nodes(step, None)), step.where("s <> d")
    groups, between = contracted(apart, blocks.strong_pieces(apart, every))
    return topological_levels(between, nodes=every.join(groups, "node", "left").select(F.coalesce("component", "node").alias("node")))


def _levels(step: DataFrame, every: DataFrame) -> tuple[DataFrame, str]:
    """(node, level) of ``every`` node (node) of different edges (s, d), and why walks weren't doubled further."""
    n = every.count()
    walks, ended = doubled(step, n)
    if ended == "circle":
        raise ValueError("the graph has a cycle")
    if ended == "many":
        for walk in walks[1:]:
            forget(walk)
        return _levels_in_blocks(step, every), ended
    levels = every.select("node", F.lit(0).alias("level"))

    def raised(levels: DataFrame, k: int) -> DataFrame:
        return along(levels, with_loops(walks[k], every, 1 << k), (F.col("level") + F.col("w")).alias("level"), F.max("level").alias("level"))

    for k in range(len(walks)):
        levels = raised(levels, k)
        if k % HOPS == HOPS - 1:
            levels = cut_lineage(levels)
    levels = cut_lineage(levels)
    for walk in walks[1:]:
        forget(walk)
    return levels, ended


def _levels_in_blocks(step: DataFrame, every: DataFrame) -> DataFrame:
    if not isinstance(every.schema["node"].dataType, T.IntegralType):
        names = cut_lineage(numbered(every, [], ["node"], "id"))
        a, b = (names.select(F.col("node").alias(c), F.col("id").alias(f"__{c}")) for c in "sd")
        by_id = cut_lineage(step.join(a, "s").join(b, "d").select(F.col("__s").alias("s"), F.col("__d").alias("d")))
        levels = _levels_in_blocks(by_id, names.select(F.col("id").alias("node")))
        return names.join(levels.withColumnRenamed("node", "id"), "id").select("node", "level")
    circle = lambda: not strong_components(step, "s", "d").isEmpty() or not step.where("s = d").isEmpty()
    levels = blocks.levels(step, every.select("node", F.lit(0).alias("level")), circle)
    if levels is None:
        raise ValueError("the graph has a cycle")
    return levels


def _acyclic(step: DataFrame, every: DataFrame) -> tuple[DataFrame, str] | None:
    try:
        return _levels(step, every)
    except ValueError:
        return None


def ancestor_counts(edges: DataFrame, src: str = "src", dst: str = "dst", groups: DataFrame | None = None) -> DataFrame:
    """(node, ancestors): how many other nodes reach each node, without a row for each pair.

    Components of ``groups`` (node, component), by default the strong ones, count as one node that all their members
    reach.  Where no block has a circle, levels tell sooner whether there is any, as steps to components take many rounds on
    deep acyclic graphs.  Each component has the set of those before it as bitmaps of 32,768 places.  On long thin graphs sets go
    over walks of doubling length; on dense ones they are made within blocks, and only what leads to other blocks moves.
    """
    step = cut_lineage(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d").distinct())
    every = cut_lineage(_nodes(step, None))
    whole = step.select(F.col("s").alias("src"), F.col("d").alias("dst"))
    known = None
    if groups is not None:
        whole = condensed(whole, groups)
    else:
        groups = blocks.strong_pieces(step, every)
        known = _acyclic(step, every) if groups.isEmpty() else None
        if known is None:
            groups, whole = contracted(step, groups)
        elif known[1] == "many":
            return _counted(step, known[0])
    member = cut_lineage(every.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    sizes = numbered(member.groupBy("component").agg(F.count(F.lit(1)).alias("size")), [], ["component"], "id")
    sizes = cut_lineage(sizes)
    a, b = (sizes.select(F.col("component").alias(c), F.col("id").alias(i)) for c, i in (("src", "s"), ("dst", "d")))
    walk = cut_lineage(whole.join(a, "src").join(b, "dst").select("s", "d"))
    own = sizes.select(F.col("id").alias("node"), F.expr("bitmap_bucket_number(id)").alias("bucket"), F.expr("bitmap_bit_position(id)").alias("place"))
    own = own.groupBy("node", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    walks, ended = doubled(walk, sizes.count())
    total = blocks.weights_before(walk, sizes) if ended == "many" else _weighed(_over(own, walks), sizes)
    total = total.select("node", (F.col("total") - 1).cast("long").alias("ancestors"))
    placed = sizes.select("component", F.col("id")).join(total, F.col("id") == F.col("node")).select("component", "ancestors")
    return member.join(placed, "component").select("node", "ancestors")


def _counted(step: DataFrame, levels: DataFrame) -> DataFrame:
    """(node, ancestors) of a dense graph whose levels are known: numbered by them, so that edges lead to larger numbers."""
    sizes = cut_lineage(numbered(levels.select("node", "level", F.lit(1).cast("long").alias("size")), [], ["level", "node"], "id"))
    a, b = (sizes.select(F.col("node").alias(c), F.col("id").alias(f"__{c}")) for c in "sd")
    walk = cut_lineage(step.join(a, "s").join(b, "d").select(F.col("__s").alias("s"), F.col("__d").alias("d")))
    total = blocks.weights_before(walk, sizes.select("id", "size", "level")).withColumnRenamed("node", "id")
    return sizes.select("node", "id").join(total, "id").select("node", (F.col("total") - 1).cast("long").alias("ancestors"))


def _weighed(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, total): the summed sizes of each set's members."""
    weight = sizes.select(F.expr("bitmap_bucket_number(id)").alias("bucket"), F.expr("bitmap_bit_position(id)").alias("place"), "size")
    alone = weight.where("size > 1")  # all others count one a bit
    counted = sets.select("node", "bucket", F.bitmap_count("bits").alias("n"), "bits")
    ones = counted.groupBy("node").agg(F.sum("n").alias("n"))
    held = F.conv(F.hex(F.substring(F.col("bits"), (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    more = counted.join(alone, "bucket").where(F.getbit(held, (F.col("place") % 8).cast("int")) == 1).groupBy("node").agg(F.sum(F.col("size") - 1).alias("more"))
    return ones.join(more, "node", "left").select("node", (F.col("n") + F.coalesce("more", F.lit(0))).alias("total"))


def _or(state: DataFrame) -> DataFrame:
    return state.groupBy("node", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _over(own: DataFrame, walks: list[DataFrame]) -> DataFrame:
    """Every node's set with those before it: over walks of 1, 2, 4, ... edges, each once."""
    sets = cut_lineage(own)
    for walk in walks:
        pushed = walk.join(sets, F.col("s") == F.col("node")).select(F.col("d").alias("node"), "bucket", "bits")
        old, sets = sets, cut_lineage(_or(pushed.unionByName(sets)))
        forget(old)
    return sets
