"""Settings that are inherited through any number of ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.shared import cut_lineage, forget


def over(child: Column, parent: Column) -> Column:
    """The maps as one; the child's entries win.  Associative, with the empty map as its unit."""
    return F.map_concat(child, F.map_filter(parent, lambda k, _: ~F.map_contains_key(child, k)))


def effective(nodes: DataFrame) -> DataFrame:
    """(node, settings): what each node has itself or has from the nearest ancestor that sets it.

    ``nodes``: node, parent (null, or unknown: a root), settings (map<string, string>; null: none).  As overriding is
    associative, each round composes a node's settings with those of the node they reach to and doubles how far that is,
    so any depth takes its logarithm in rounds.  Ancestors in a circle count once each.  Of several rows of a node
    the one of the smallest parent counts, and of those the one of the first settings.
    """
    kind = nodes.schema["settings"].dataType
    own = nodes.where("node IS NOT NULL").select("node", "parent", F.coalesce("settings", F.create_map().cast(kind)).alias("settings"))
    known = own.select(F.col("node").alias("parent")).distinct()
    one = own.groupBy("node").agg(F.min(F.struct(F.col("parent").alias("p"), F.sort_array(F.map_entries("settings")).alias("s"))).alias("m"))
    one = one.select("node", F.col("m.p").alias("parent"), F.map_from_entries("m.s").alias("settings"))
    rooted = one.where("parent IS NOT NULL").join(known, "parent", "left_semi").select("node", "parent", "settings")
    state = cut_lineage(rooted.unionByName(one.join(rooted.select("node"), "node", "left_anti").withColumn("parent", F.lit(None).cast(nodes.schema["node"].dataType))))
    longest, far = state.count(), 1
    while far < 2 * longest and not state.where("parent IS NOT NULL").isEmpty():
        above = state.select(F.col("node").alias("parent"), F.col("parent").alias("__next"), F.col("settings").alias("__above"))
        met = state.where("parent IS NOT NULL").join(above, "parent").select("node", F.col("__next").alias("parent"), over(F.col("settings"), F.col("__above")).alias("settings"))
        old, state, far = state, cut_lineage(met.unionByName(state.where("parent IS NULL"))), 2 * far
        forget(old)
    return state.select("node", "settings")
