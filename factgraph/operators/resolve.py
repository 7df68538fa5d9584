"""Import resolution as joins with the set of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import fixed

ALIASES = "project_id string, priority int, prefix string, suffix string, target_ord int, target string"


#: So many patterns are sent to all tasks; of more, each is dealt to SALTS parts, as very many specifiers may begin alike.
PATTERNS, SALTS = 10_000, 32


def expand_aliases(imports: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """Targets of the first pattern that matches ``specifier``; with ``project_id`` on both sides, of the own project's.

    A null suffix makes an exact pattern.  All targets of the pattern stay, in rows of their own.  Specifiers meet patterns
    in an equi join: by their whole text, and by their beginning at each of the lengths that prefixes have, which are no more
    than the longest prefix is long.  Suffixes are tested on what meets, so the number of patterns doesn't matter.
    """
    s, shared = F.col("specifier"), [c for c in ("project_id",) if c in imports.columns and c in aliases.columns]
    wild = F.col("suffix").isNotNull()
    lengths = sorted(r[0] for r in aliases.where(wild & F.col("prefix").isNotNull()).select(F.char_length("prefix")).distinct().collect())
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length(s))
    begins = F.transform(starts, lambda n: F.struct(n.alias("long"), s.substr(F.lit(1), n).alias("text")))
    whole = F.array(F.struct(F.lit(-1).alias("long"), s.alias("text")))
    asked = imports.withColumn("__b", F.explode(F.concat(whole, begins))).select("*", F.col("__b.long").alias("__long"), F.col("__b.text").alias("__begin")).drop("__b")
    patterns = aliases.select("*", F.when(wild, F.char_length("prefix")).otherwise(-1).alias("__long"), F.col("prefix").alias("__begin"))
    fits = ~wild | (s.endswith(F.col("suffix")) & (F.char_length(s) >= F.char_length("prefix") + F.char_length("suffix")))
    if patterns.count() <= PATTERNS:
        met = asked.join(F.broadcast(patterns), [*shared, "__long", "__begin"])
    else:
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
        dealt = patterns.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("__salt", salt).join(dealt, [*shared, "__long", "__begin", "__salt"]).drop("__salt")
    met = met.where(fits).drop("__long", "__begin")
    first = met.groupBy(*keys).agg(F.min("priority").alias("__first"))
    captured = F.when(F.col("suffix").isNull(), F.lit("")).otherwise(F.expr("substring(specifier, length(prefix) + 1, length(specifier) - length(prefix) - length(suffix))"))
    return met.join(first, keys).where("priority = __first").drop("__first").withColumn("target", F.when(F.col("suffix").isNull(), F.col("target")).otherwise(F.replace("target", F.lit("*"), captured)))


def imports_of(facts: DataFrame) -> DataFrame:
    """(project_id, path, language, ord, specifier, kind, names, line, start, end)."""
    rows = facts.select("project_id", "path", "language", F.posexplode("imports").alias("ord", "i"))
    return rows.select("project_id", "path", "language", "ord", "i.*")


def _probe(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """The first candidate (target_ord, candidate_ord) of each key that is a file."""
    hits = candidates.join(files.select("project_id", F.col("path").alias("candidate")), ["project_id", "candidate"])
    return hits.groupBy(*keys).agg(F.min_by("candidate", F.struct("target_ord", "candidate_ord")).alias("to"))


def resolve(facts: DataFrame, files: DataFrame, aliases: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Imports with resolution (project, external, unresolved), ``targets`` (ordered paths) and ``matched_alias``.

    ``roots``: (project_id, root_package) of projects whose root is itself a Python package.
    """
    every = imports_of(facts)
    return _resolve_js(every.where(F.col("language").isin(*fixed.ECMASCRIPT)), files, aliases).unionByName(_resolve_python(every.where("language = 'python'"), files, roots))


_KEYS = ["project_id", "path", "ord"]


def _resolve_js(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    s = F.col("specifier")
    relative = s.startswith("./") | s.startswith("../")
    own = imports.where(relative).select(*_KEYS, F.lit(0).alias("target_ord"), C.normalise(F.concat_ws("/", C.directory(F.col("path")), s)).alias("base"))
    wild = expand_aliases(imports.where(~relative).select(*_KEYS, "specifier"), aliases, _KEYS)
    aliased = wild.select(*_KEYS, "target_ord", C.normalise(F.col("target")).alias("base"))
    candidates = own.unionByName(aliased).select(*_KEYS, "target_ord", F.posexplode(C.probe_candidates(F.col("base"))).alias("candidate_ord", "candidate"))
    found = _probe(candidates, files, _KEYS)
    matched = aliased.select(*_KEYS).distinct().withColumn("matched_alias", F.lit(True))
    out = imports.join(found, _KEYS, "left").join(matched, _KEYS, "left")
    known = F.coalesce("matched_alias", F.lit(False))
    resolution = F.when(F.col("to").isNotNull(), "project").when(relative | known | s.startswith("@/") | s.startswith("~/"), "unresolved").otherwise("external")
    return out.select(*imports.columns, resolution.alias("resolution"), F.when(F.col("to").isNotNull(), F.array("to")).otherwise(F.array().cast("array<string>")).alias("targets"), known.alias("matched_alias"))


def _resolve_python(imports: DataFrame, files: DataFrame, roots: DataFrame | None) -> DataFrame:
    s = F.col("specifier")
    dots = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(s, r"^\.+", ""), F.lit("."), F.lit("/"))
    folder = F.split(C.directory(F.col("path")), "/")
    folder = F.filter(folder, lambda p: p != "")
    above = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0))), "/")
    join = lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(F.concat_ws("/", a, b))
    rows = imports.withColumn("__dots", dots).withColumn("__module", module).withColumn("__above", F.when(dots > 0, above))
    if roots is not None:
        rows = rows.join(roots, "project_id", "left")
        plain = F.regexp_replace("__module", "^[^/]+/?", "")
        rows = rows.withColumn("__module", F.when((F.col("__dots") == 0) & (F.split("__module", "/")[0] == F.col("root_package")), plain).otherwise(F.col("__module")))
    rows = rows.withColumn("__base", F.when(F.col("__dots") > 0, join(F.col("__above"), F.col("__module"))).otherwise(F.col("__module")))
    bare = (F.col("__dots") > 0) & (F.col("__module") == "")
    # each name of a bare relative import may be a module; what isn't falls back to the package
    single = rows.where(~bare).select(*_KEYS, F.lit(0).alias("name_ord"), F.posexplode(F.array(F.concat("__base", F.lit(".py")), join(F.col("__base"), F.lit("__init__.py")))).alias("candidate_ord", "candidate"))
    named = rows.where(bare).select(*_KEYS, "__base", F.posexplode("names").alias("name_ord", "name"))
    each = named.select(*_KEYS, "name_ord", F.posexplode(F.array(join(F.col("__base"), F.concat("name", F.lit(".py"))), join(join(F.col("__base"), F.col("name")), F.lit("__init__.py")), join(F.col("__base"), F.lit("__init__.py")))).alias("candidate_ord", "candidate"))
    hits = single.unionByName(each).join(files.select("project_id", F.col("path").alias("candidate")), ["project_id", "candidate"])
    best = hits.groupBy(*_KEYS, "name_ord").agg(F.min_by("candidate", "candidate_ord").alias("to"))
    targets = best.groupBy(*_KEYS).agg(F.sort_array(F.collect_set("to")).alias("targets"))
    out = rows.join(targets, _KEYS, "left")
    resolution = F.when(F.col("targets").isNotNull(), "project").when(F.col("__dots") > 0, "unresolved").otherwise("external")
    return out.select(*imports.columns, resolution.alias("resolution"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"), F.lit(False).alias("matched_alias"))


def bindings(resolved: DataFrame) -> DataFrame:
    """(project_id, from, to, names, ord): who imports what by which names; empty names mean all.

    A Python import binds only if it has one target and names that aren't ``*``.
    """
    python = F.col("language") == "python"
    names = F.when(python, F.filter("names", lambda n: n != "*")).otherwise(F.col("names"))
    kept = resolved.where("resolution = 'project'").withColumn("names", names)
    kept = kept.where(~python | ((F.size("targets") == 1) & (F.size("names") > 0) & ~F.col("specifier").rlike(r"^\.+$")))
    return kept.select("project_id", F.col("path").alias("from"), F.explode("targets").alias("to"), "names", "ord")


def edges(resolved: DataFrame) -> DataFrame:
    """(project_id, src, dst, kind): imports between files, and dependence of JavaScript files on packages."""
    inner = resolved.where("resolution = 'project'").select("project_id", F.col("path").alias("src"), F.explode("targets").alias("dst"), F.lit("imports").alias("kind"))
    outer = resolved.where("resolution = 'external' AND language <> 'python'").select("project_id", F.col("path").alias("src"), F.col("specifier").alias("dst"), F.lit("depends_on").alias("kind"))
    return inner.unionByName(outer).distinct()


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("resolution = 'unresolved'").select("project_id", "path", "specifier", "matched_alias", "line", "start")
