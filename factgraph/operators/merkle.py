"""Fingerprints of a keyed table as a digest tree over ranges of key hashes.

Leaves are ranges of the keys' hashes; a leaf's digest is the sum of its rows' hashes, twice with other seeds, and a node's
is that of the nodes below it, so digests are partial aggregates and order doesn't matter.  Two snapshots are compared
from the root down: of each level only the children of nodes that differ are met, and at the end only differing leaves' rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.shared import cut_lineage

#: Children of a node as a power of two, and levels below the root: 65,536 leaves.
FAN, DEPTH = 4, 4


def leaf(keys: Sequence[str], depth: int = DEPTH) -> Column:
    """The number of the leaf that holds a key."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FAN * depth)


def digested(rows: DataFrame, keys: Sequence[str], values: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(keys, leaf, a, b): two hashes of each row's key and values."""
    text = F.to_json(F.struct(*keys, *values), {"ignoreNullFields": "false"})
    hashed = F.sha2(text, 256)
    half = lambda at: F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(*keys, leaf(keys, depth).alias("leaf"), half(1).alias("a"), half(16).alias("b"))


def tree(hashed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, node, n, a, b) of all levels; leaves from rows of :func:`digested`, each other level from the one below it."""
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")]
    level = cut_lineage(hashed.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), *sums))
    out = level.select(F.lit(depth).alias("level"), "node", "n", "a", "b")
    for k in range(depth - 1, -1, -1):
        level = level.groupBy(F.shiftright("node", FAN).alias("node")).agg(F.sum("n").alias("n"), *sums)
        out = out.unionByName(level.select(F.lit(k).alias("level"), "node", "n", "a", "b"))
    return out


def differing(before: DataFrame, after: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node): the leaves in which two trees differ; from the root down, below differing nodes only."""
    under = None
    for k in range(depth + 1):
        sides = []
        for side, name in ((before, "x"), (after, "y")):
            level = side.where(F.col("level") == k).select("node", F.struct("n", "a", "b").alias(name))
            sides.append(level if under is None else level.withColumn("above", F.shiftright("node", FAN)).join(under, "above", "left_semi").drop("above"))
        met = sides[0].join(sides[1], "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("node").alias("above"))
        under = cut_lineage(met)
        if under.isEmpty():
            break
    return under.select(F.col("above").alias("node"))


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(keys, change): added, removed or changed keys, found through the trees; a key is one row in each snapshot."""
    own = [digested(side, keys, values, depth) for side in (before, after)]
    leaves = differing(*[tree(side, depth) for side in own], depth)
    leaves = leaves.withColumnRenamed("node", "leaf")
    old, new = (side.join(leaves, "leaf", "left_semi").select(*keys, F.struct("a", "b").alias(name)) for side, name in zip(own, ("old", "new")))
    met = old.join(new, list(keys), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return met.select(*keys, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))
