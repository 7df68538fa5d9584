"""The file and package graph, and the symbol graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.operators import relops
from factgraph.operators.shared import cut_lineage


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 0 within the keys, by ``order`` (ties in any order).

    Rows are dealt by ranges of (keys, order), numbered within a range, and shifted by what the ranges before hold of
    the same keys; so one large project isn't one task.
    """
    part, at, n, before = "__part", "__at", "__n", "__before"
    sorts = [F.col(o) if isinstance(o, str) else o for o in order]
    places = [f"__o{i}" for i in range(len(sorts))]
    held = rows.withColumns(dict(zip(places, sorts)))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(held.repartitionByRange(ranges, *keys, *places).withColumn(part, F.spark_partition_id()))
    inside = dealt.withColumn(at, F.row_number().over(Window.partitionBy(part, *keys).orderBy(*places)))
    sizes = dealt.groupBy(part, *keys).agg(F.count(F.lit(1)).alias(n))  # a row for each key, and for each range
    shift = F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.withColumn(before, shift).drop(n)
    same = F.col(f"a.{part}") == F.col(f"b.{part}")
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    met = inside.alias("a").join(shifts.alias("b"), same)
    return met.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col(at) + F.col(before) - 1).cast("long").alias(name))


def nodes(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(project_id, label, kind, node_id): files and packages, numbered within a project as they are met.

    A file is met as itself, in path order, or before that as a target of an earlier file's import.
    """
    own = numbered(files.select("project_id", "path"), ["project_id"], [C.path_key(F.col("path"))], "file")
    met = own.select("project_id", F.col("path").alias("label"), F.lit("file").alias("kind"), F.struct(F.col("file"), F.lit(-1).alias("ord"), F.lit(0).alias("target")).alias("at"))
    at = lambda target: F.struct(F.col("file"), F.col("ord"), target.alias("target"))
    reached = resolved.join(own, ["project_id", "path"])
    inner = reached.where("resolution = 'project'").select("project_id", "file", "ord", F.posexplode("targets").alias("t", "label")).select("project_id", "label", F.lit("file").alias("kind"), at(F.col("t")).alias("at"))
    outer = reached.where("resolution = 'external' AND language <> 'python'").select("project_id", F.col("specifier").alias("label"), F.lit("package").alias("kind"), at(F.lit(0)).alias("at"))
    first = met.unionByName(inner).unionByName(outer).groupBy("project_id", "label", "kind").agg(F.min("at").alias("at"))
    return numbered(first, ["project_id"], ["at", "label"], "node_id").drop("at")


def by_label(nodes: DataFrame, project_id: str, label: str) -> DataFrame:
    return nodes.where((F.col("project_id") == project_id) & (F.col("label") == label))


def by_id(nodes: DataFrame, project_id: str, node_id: int) -> DataFrame:
    return nodes.where((F.col("project_id") == project_id) & (F.col("node_id") == node_id))


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """Files, packages or symbols."""
    return nodes.where(F.col("kind") == kind)


def topological_order(edges: DataFrame) -> DataFrame:
    """(label, place) of one project's nodes, before what they lead to; no rows if the edges have a circle."""
    from factgraph.operators import walks

    try:
        levels = walks.topological_levels(edges)
    except ValueError:
        return edges.select(F.col("src").alias("label"), F.lit(0).cast("long").alias("place")).limit(0)
    return numbered(levels, [], ["level", "node"], "place").select(F.col("node").alias("label"), "place")


def roots(nodes: DataFrame, edges: DataFrame, kind: str = "imports") -> DataFrame:
    """Nodes that no edge of a kind leads to."""
    return relops.difference(nodes, edges.where(F.col("kind") == kind).select("project_id", F.col("dst").alias("label")), ["project_id", "label"])


def dependents(edges: DataFrame, project_id: str, label: str) -> DataFrame:
    """Everything that reaches a file, over any edges."""
    own = edges.where(F.col("project_id") == project_id)
    start = own.sparkSession.createDataFrame([(label,)], "start string")
    return relops.reachable(own, start, "dst", "src").where("node <> start").select(F.col("node").alias("label"), "depth")


def symbol_graph(symbols: DataFrame, calls: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (files and symbols) and edges (contains, exports, calls, type_ref) of the declarations."""
    from factgraph.operators import semantic

    label = lambda p, k, n: F.concat_ws("#", p, k, n)
    named = symbols.select("project_id", "path", "name", "kind", "exported", label("path", "kind", "name").alias("label"), "extends", "type_refs")
    nodes = named.select("project_id", F.col("path").alias("label"), F.lit("file").alias("kind")).unionByName(named.select("project_id", "label", F.lit("symbol").alias("kind"))).distinct()
    contains = named.select("project_id", F.col("path").alias("src"), F.col("label").alias("dst"), F.lit("contains").alias("kind"))
    exports = named.where("exported").select("project_id", F.col("path").alias("src"), F.col("label").alias("dst"), F.lit("exports").alias("kind"))
    placed = semantic.enclosing(calls, symbols).where("in_symbol IS NOT NULL")
    callers = placed.select("project_id", "path", "callee", label("path", F.lit("function"), "in_symbol").alias("src")).distinct()
    targets = named.select("project_id", F.col("path").alias("to_path"), F.col("name").alias("callee"), F.col("label").alias("dst"))
    found = semantic.call_edges(calls, symbols, bindings).select("project_id", "path", "callee", "to_path").distinct()
    called = callers.join(found, ["project_id", "path", "callee"]).join(targets, ["project_id", "to_path", "callee"]).select("project_id", "src", "dst", F.lit("calls").alias("kind"))
    refs = named.select("project_id", "path", F.col("label").alias("src"), F.explode(F.array_union(F.coalesce("extends", F.array().cast("array<string>")), F.coalesce("type_refs", F.array().cast("array<string>")))).alias("name"))
    types = refs.join(named.select("project_id", "path", "name", F.col("label").alias("dst")), ["project_id", "path", "name"]).select("project_id", "src", "dst", F.lit("type_ref").alias("kind"))
    return nodes, contains.unionByName(exports).unionByName(called).unionByName(types).distinct()
