"""Symbols, calls and what refers to what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.operators import relops


def last_write(files: DataFrame, seq: str) -> DataFrame:
    """Of files that are written more than once the last, by ``seq``."""
    rest = [c for c in files.columns if c not in ("project_id", "path")]
    return files.groupBy("project_id", "path").agg(F.max_by(F.struct(*rest), seq).alias("__last")).select("project_id", "path", "__last.*")


def exported_symbol(symbols: DataFrame) -> DataFrame:
    """What a name that is imported from a file stands for: the first exported symbol of that name."""
    return symbols.where("exported").groupBy("project_id", "path", "name").agg(F.min(F.struct("ord", "kind")).alias("__first")).select("project_id", "path", "name", "__first.kind")


def symbols(facts: DataFrame) -> DataFrame:
    rows = facts.select("project_id", "path", "language", F.posexplode("symbols").alias("ord", "s"))
    return rows.select("project_id", "path", "language", "ord", "s.*")


def calls(facts: DataFrame) -> DataFrame:
    rows = facts.select("project_id", "path", "language", F.posexplode("calls").alias("ord", "c"))
    return rows.select("project_id", "path", "language", "ord", "c.*")


def duplicates(symbols: DataFrame) -> DataFrame:
    """Names declared twice or more in a file, with the last declaration's place."""
    return symbols.groupBy("project_id", "path", "name").agg(F.count("*").alias("declarations"), F.max(F.struct("ord", "line", "start")).alias("l")).where("declarations > 1").select("project_id", "path", "name", "declarations", F.col("l.line").alias("line"), F.col("l.start").alias("start"))


def unreachable(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Declarations that aren't exported and that their file never refers to."""
    refs = facts.select("project_id", "path", F.explode("refs").alias("name"))
    own = symbols.where(~F.col("exported") & (F.col("kind") != "unknown"))
    return own.join(refs, ["project_id", "path", "name"], "left_anti")


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with the first function of the file whose body contains them (null at module level): an interval join."""
    bodies = symbols.where("kind = 'function' AND body_start IS NOT NULL").select("project_id", "path", F.col("ord").alias("s_ord"), F.col("name").alias("in_symbol"), "body_start", "body_end", "returns_jsx")
    met = relops.containing(calls.select("project_id", "path", "ord", "start", "end"), bodies, ["project_id", "path"], "start", "body_start", "body_end").where("end <= body_end")
    first = met.groupBy("project_id", "path", "ord").agg(F.min(F.struct("s_ord", "in_symbol", "returns_jsx")).alias("e"))
    return calls.join(first, ["project_id", "path", "ord"], "left").select(*[calls[c] for c in calls.columns], F.col("e.in_symbol").alias("in_symbol"), F.col("e.returns_jsx").alias("in_returns_jsx"))


def call_edges(calls: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """(project_id, path, callee, to_path): calls of the file's own symbols, else of imported names that are exported.

    Of a name that two imports bind, the last counts; member calls resolve to nothing.
    """
    own = symbols.select("project_id", "path", F.col("name").alias("callee")).distinct().withColumn("own", F.lit(True))
    bound = bindings.select("project_id", F.col("from").alias("path"), "to", "ord", F.explode("names").alias("callee")).where("callee NOT IN ('default', '*')")
    bound = bound.groupBy("project_id", "path", "callee").agg(F.max_by("to", "ord").alias("to"))
    exported = exported_symbol(symbols).select("project_id", F.col("path").alias("to"), F.col("name").alias("callee"))
    imported = bound.join(exported, ["project_id", "to", "callee"])
    met = calls.select("project_id", "path", "callee", "line").join(own, ["project_id", "path", "callee"], "left").join(imported, ["project_id", "path", "callee"], "left")
    return met.select("project_id", "path", "callee", "line", F.when(F.col("own"), F.col("path")).otherwise(F.col("to")).alias("to_path")).where("to_path IS NOT NULL")


def type_cycles(symbols: DataFrame) -> DataFrame:
    """(project_id, path, component, members): interfaces of a file that extend each other in a circle, or themselves."""
    faces = symbols.where("kind = 'interface'")
    names = faces.select("project_id", "path", F.col("name").alias("parent")).distinct()
    heritage = faces.select("project_id", "path", "name", F.explode("extends").alias("parent")).distinct().join(names, ["project_id", "path", "parent"])
    own = heritage.where("name = parent").select("project_id", "path", F.col("name").alias("component"), F.array("name").alias("members"))
    key = lambda c: F.to_json(F.struct("project_id", "path", F.col(c).alias("n")))
    groups = relops.strong_components(heritage.select(key("name").alias("src"), key("parent").alias("dst")))
    part = lambda c, f: F.get_json_object(c, f"$.{f}")
    rows = groups.select(part("node", "project_id").alias("project_id"), part("node", "path").alias("path"), "component", part("node", "n").alias("name"))
    circles = rows.groupBy("project_id", "path", "component").agg(F.sort_array(F.collect_set("name")).alias("members")).withColumn("component", F.col("members")[0])
    return circles.unionByName(own.join(circles.select("project_id", "path", F.explode("members").alias("component")), ["project_id", "path", "component"], "left_anti"))


def react(symbols: DataFrame) -> DataFrame:
    """Functions with their React role: hook, component or null."""
    return symbols.where("kind = 'function'").withColumn("react_role", C.react_role(F.col("name"), F.coalesce("returns_jsx", F.lit(False))))
