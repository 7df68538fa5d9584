"""The rules: each is a query over a project's tables that gives findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import fixed
from factgraph.operators import frameworks as FW
from factgraph.operators import relops, resolve, search, semantic
from factgraph.operators.shared import cut_lineage

FINDING = ("project_id", "path", "line", "start", "rule_id", "category", "severity", "confidence", "title", "message", "evidence", "target")


@dataclass
class Context:
    """A set of projects' tables, shared by all rules."""

    files: DataFrame
    facts: DataFrame
    resolved: DataFrame
    bindings: DataFrame
    edges: DataFrame
    symbols: DataFrame
    calls: DataFrame
    dependencies: DataFrame
    env: DataFrame
    frameworks: DataFrame
    next_project: DataFrame
    app_files: DataFrame


def context(files: DataFrame, facts: DataFrame, aliases: DataFrame, roots: DataFrame | None = None) -> Context:
    facts = cut_lineage(facts)
    slim = cut_lineage(files.select("project_id", "path"))
    resolved = cut_lineage(resolve.resolve(facts, slim, aliases, roots))
    symbols = semantic.symbols(facts)
    from factgraph.sources import project

    dependencies = cut_lineage(project.package_dependencies(files))
    with_package = files.where("path = 'package.json' AND from_json(content, 'struct<x: int>') IS NOT NULL").select("project_id")
    found = cut_lineage(FW.detect(dependencies, project.root_entries(slim), with_package))
    routers = cut_lineage(FW.next_project(slim))
    return Context(slim, facts, resolved, cut_lineage(resolve.bindings(resolved)), resolve.edges(resolved), symbols, semantic.calls(facts), dependencies, project.env_declarations(files), found, routers, cut_lineage(FW.app_files(slim, routers, facts)))


RULES: dict[str, Callable[[Context], DataFrame]] = {}


def rule(rule_id: str) -> Callable[[Callable[[Context], DataFrame]], Callable[[Context], DataFrame]]:
    def add(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        RULES[rule_id] = f
        return f

    return add


def finding(rows: DataFrame, rule_id: str, message: Column, evidence: Column | None = None, target: Column | None = None, line: str | None = "line", start: str | None = "start") -> DataFrame:
    category, severity, confidence, _, title, _ = fixed.RULES[rule_id]
    none = F.array().cast("array<string>")
    return rows.select(
        "project_id",
        "path",
        (F.col(line) if line else F.lit(1)).cast("int").alias("line"),
        (F.col(start) if start else F.lit(0)).cast("long").alias("start"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
        F.lit(title).alias("title"),
        message.alias("message"),
        (evidence if evidence is not None else none).alias("evidence"),
        (target if target is not None else F.lit(None).cast("string")).alias("target"),
    )


def _q(c: str) -> Column:
    return F.concat(F.lit("`"), F.col(c), F.lit("`"))


def _clients(ctx: Context) -> DataFrame:
    return ctx.facts.where(F.array_contains("directives", "use client")).select("project_id", "path")


def _next(ctx: Context) -> DataFrame:
    return ctx.frameworks.where("framework = 'next'").select("project_id")


def _es(ctx: Context) -> DataFrame:
    return ctx.facts.where(F.col("language").isin(*fixed.ECMASCRIPT))


def _exploded(ctx: Context, column: str) -> DataFrame:
    return _es(ctx).select("project_id", "path", F.explode(column).alias("x")).select("project_id", "path", "x.*")


@rule("next/private-env-in-client")
def private_env(ctx: Context) -> DataFrame:
    reads = _exploded(ctx, "env_reads").where("NOT startswith(name, 'NEXT_PUBLIC_') AND name <> 'NODE_ENV'")
    rows = reads.join(_clients(ctx), ["project_id", "path"], "left_semi").join(_next(ctx), "project_id", "left_semi")
    return finding(rows, "next/private-env-in-client", F.concat(_q("name"), F.lit(" is read in a client component, where only NEXT_PUBLIC_ variables exist")))


@rule("next/server-only-in-client")
def server_only(ctx: Context) -> DataFrame:
    node = lambda c: F.concat_ws("\u0001", "project_id", c)
    starts = _clients(ctx).join(_next(ctx), "project_id", "left_semi").select(node("path").alias("start"))
    marked = ctx.resolved.where("specifier = 'server-only' AND resolution = 'external'").select(node("path").alias("node"))
    edges = ctx.bindings.select(node("from").alias("src"), node("to").alias("dst"), "ord")
    hits = search.first_chain(edges, starts, marked)
    rows = hits.select(F.split("start", "\u0001")[0].alias("project_id"), F.split("start", "\u0001")[1].alias("path"), F.transform("chain", lambda c: F.split(c, "\u0001")[1]).alias("chain"))
    return finding(rows, "next/server-only-in-client", F.concat(F.lit("a client component reaches server-only code: "), F.array_join("chain", " -> ")), F.col("chain"), line=None, start=None)


@rule("graph/no-circular-imports")
def circular(ctx: Context) -> DataFrame:
    node = lambda c: F.concat_ws("\u0001", "project_id", c)
    groups = relops.strong_components(ctx.edges.where("kind = 'imports'").select(node("src").alias("src"), node("dst").alias("dst")))
    rows = groups.groupBy("component").agg(F.sort_array(F.collect_list(F.split("node", "\u0001")[1])).alias("members")).select(F.split("component", "\u0001")[0].alias("project_id"), F.col("members")[0].alias("path"), "members")
    return finding(rows, "graph/no-circular-imports", F.concat(F.lit("files import each other in a circle: "), F.array_join("members", ", ")), F.col("members"), line=None, start=None)


@rule("complexity/large-function")
def large_function(ctx: Context) -> DataFrame:
    rows = ctx.symbols.where((F.col("kind") == "function") & (F.col("body_lines") > fixed.LARGE_FUNCTION_LINES))
    return finding(rows, "complexity/large-function", F.concat(_q("name"), F.lit(" has "), F.col("body_lines"), F.lit(f" lines; the limit is {fixed.LARGE_FUNCTION_LINES}")))


@rule("graph/dead-file")
def dead_file(ctx: Context) -> DataFrame:
    imported = ctx.edges.where("kind = 'imports'").select("project_id", F.col("dst").alias("path"))
    rows = relops.difference(ctx.facts.select("project_id", "path").where(~C.never_imported(F.col("path"))), imported, ["project_id", "path"])
    return finding(rows, "graph/dead-file", F.concat(F.lit("no file imports "), _q("path")), line=None, start=None)


@rule("next/forced-dynamic")
def forced_dynamic(ctx: Context) -> DataFrame:
    rows = _exploded(ctx, "dynamic_calls").join(_next(ctx), "project_id", "left_semi")
    return finding(rows, "next/forced-dynamic", F.concat(_q("name"), F.lit(" makes the route render dynamically")))


@rule("security/hardcoded-secret")
def hardcoded_secret(ctx: Context) -> DataFrame:
    rows = _exploded(ctx, "secrets")
    shown = F.concat(F.lit("starts with "), _q("preview"), F.lit(", "), F.col("length"), F.lit(" characters"))
    return finding(rows, "security/hardcoded-secret", F.concat(F.lit("a literal looks like a credential ("), F.col("signal"), F.lit(")")), F.array(shown))


@rule("next/client-metadata-ignored")
def client_metadata(ctx: Context) -> DataFrame:
    rows = ctx.app_files.where("rendering = 'client' AND kind IN ('page', 'layout') AND (has_metadata OR has_generate_metadata)")
    name = F.when(F.col("has_generate_metadata"), "generateMetadata").otherwise("metadata")
    return finding(rows, "next/client-metadata-ignored", F.concat(F.lit("`"), name, F.lit("` is ignored in a client component")), line=None, start=None)


@rule("next/mixed-router")
def mixed_router(ctx: Context) -> DataFrame:
    routes = FW.pages_routes(ctx.files, ctx.next_project.where("router = 'mixed'"))
    rows = routes.groupBy("project_id").agg(F.min_by("path", C.path_key(F.col("path"))).alias("path"))
    return finding(rows, "next/mixed-router", F.lit("the project uses the App Router and the Pages Router"), line=None, start=None)


@rule("security/no-eval")
def no_eval(ctx: Context) -> DataFrame:
    return finding(_exploded(ctx, "eval_calls"), "security/no-eval", F.concat(_q("name"), F.lit(" runs code from text")))


@rule("react/async-client-component")
def async_client(ctx: Context) -> DataFrame:
    rows = semantic.react(ctx.symbols).where("react_role = 'component' AND is_async").join(_clients(ctx), ["project_id", "path"], "left_semi")
    return finding(rows, "react/async-client-component", F.concat(_q("name"), F.lit(" is an async client component")))


def _es_functions(ctx: Context) -> DataFrame:
    return semantic.react(ctx.symbols.where(F.col("language").isin(*fixed.ECMASCRIPT)))


@rule("react/component-naming")
def component_naming(ctx: Context) -> DataFrame:
    rows = _es_functions(ctx).where("returns_jsx AND react_role IS NULL")
    return finding(rows, "react/component-naming", F.concat(_q("name"), F.lit(" returns JSX but isn't named like a component")))


@rule("react/hook-in-non-component")
def hook_outside(ctx: Context) -> DataFrame:
    hooks = ctx.calls.where(F.col("language").isin(*fixed.ECMASCRIPT) & C.is_hook(F.col("callee")))
    placed = semantic.enclosing(hooks, ctx.symbols)
    rows = placed.where(F.col("in_symbol").isNull() | C.react_role(F.col("in_symbol"), F.coalesce("in_returns_jsx", F.lit(False))).isNull())
    where = F.when(F.col("in_symbol").isNull(), F.lit("outside any function")).otherwise(F.concat(F.lit("in "), _q("in_symbol"), F.lit(", which is neither a component nor a hook")))
    return finding(rows, "react/hook-in-non-component", F.concat(_q("callee"), F.lit(" is called "), where))


@rule("react/hook-returns-jsx")
def hook_jsx(ctx: Context) -> DataFrame:
    rows = _es_functions(ctx).where("react_role = 'hook' AND returns_jsx")
    return finding(rows, "react/hook-returns-jsx", F.concat(_q("name"), F.lit(" is a hook that returns JSX")))


@rule("typescript/circular-type-reference")
def circular_types(ctx: Context) -> DataFrame:
    es = ctx.symbols.where(F.col("language").isin(*fixed.ECMASCRIPT))
    cycles = semantic.type_cycles(es)
    first = es.where("kind = 'interface'").groupBy("project_id", "path", F.col("name").alias("component")).agg(F.min(F.struct("start", "line")).alias("p"))
    rows = cycles.join(first, ["project_id", "path", "component"]).select("project_id", "path", "members", F.col("p.line").alias("line"), F.col("p.start").alias("start"))
    return finding(rows, "typescript/circular-type-reference", F.concat(F.lit("interfaces extend each other in a circle: "), F.array_join("members", ", ")), F.col("members"))


@rule("typescript/duplicate-declaration")
def duplicate_declaration(ctx: Context) -> DataFrame:
    rows = semantic.duplicates(ctx.symbols.where(F.col("language").isin(*fixed.ECMASCRIPT)))
    return finding(rows, "typescript/duplicate-declaration", F.concat(_q("name"), F.lit(" is declared "), F.col("declarations"), F.lit(" times")))


@rule("typescript/unreachable-symbol")
def unreachable_symbol(ctx: Context) -> DataFrame:
    rows = semantic.unreachable(ctx.symbols.where(F.col("language").isin(*fixed.ECMASCRIPT) & ~C.never_imported(F.col("path"))), ctx.facts)
    return finding(rows, "typescript/unreachable-symbol", F.concat(_q("name"), F.lit(" is neither exported nor used")))


def _unused(ctx: Context, exports: DataFrame) -> DataFrame:
    """Exports of imported files that no binding names; a binding without names, or with a star, names all."""
    star = (F.size("names") == 0) | F.array_contains("names", "*")
    uses = ctx.bindings.groupBy("project_id", F.col("to").alias("path")).agg(F.bool_or(star).alias("star"), F.count("*").alias("importers"))
    named = ctx.bindings.select("project_id", F.col("to").alias("path"), F.explode("names").alias("name")).distinct()
    return exports.where(~C.never_imported(F.col("path"))).join(uses.where(~F.col("star")), ["project_id", "path"]).join(named, ["project_id", "path", "name"], "left_anti")


@rule("typescript/unused-export")
def unused_symbol(ctx: Context) -> DataFrame:
    own = ctx.symbols.where(F.col("exported") & F.col("language").isin(*fixed.ECMASCRIPT)).select("project_id", "path", "name", "line", "start")
    return finding(_unused(ctx, own), "typescript/unused-export", F.concat(F.lit("exported "), _q("name"), F.lit(" isn't imported anywhere")))


@rule("imports/broken-path-alias")
def broken_alias(ctx: Context) -> DataFrame:
    rows = resolve.unresolved(ctx.resolved).where("matched_alias")
    return finding(rows, "imports/broken-path-alias", F.concat(_q("specifier"), F.lit(" matches a path alias but no file")))


@rule("imports/unresolved-import")
def unresolved_import(ctx: Context) -> DataFrame:
    rows = resolve.unresolved(ctx.resolved).where("startswith(specifier, '.')")
    return finding(rows, "imports/unresolved-import", F.concat(F.lit("no file answers "), _q("specifier")))


@rule("deps/unused-dependency")
def unused_dependency(ctx: Context) -> DataFrame:
    used = ctx.resolved.where(F.col("language").isin(*fixed.ECMASCRIPT) & (F.col("resolution") == "external")).select("project_id", C.package_name(F.col("specifier")).alias("name"))
    rows = ctx.dependencies.where("section = 'dependencies' AND NOT startswith(name, '@types/')").withColumn("path", F.lit("package.json"))
    rows = relops.difference(relops.difference(rows, FW.owned_packages(ctx.frameworks), ["project_id", "name"]), used, ["project_id", "name"])
    return finding(rows, "deps/unused-dependency", F.concat(_q("name"), F.lit(" is a dependency that no file imports")), target=F.col("name"), line=None, start=None)


@rule("env/unused-env-var")
def unused_env(ctx: Context) -> DataFrame:
    reads = ctx.facts.select("project_id", F.explode("env_reads").alias("x")).select("project_id", "x.name")
    rows = ctx.env.where(~F.col("name").isin(*fixed.ENV_SKIPPED) & ~C.any_of(F.col("name").startswith(p) for p in fixed.ENV_SKIPPED_PREFIXES))
    rows = relops.difference(rows, reads, ["project_id", "name"])
    return finding(rows, "env/unused-env-var", F.concat(_q("name"), F.lit(" is declared but never read")), target=F.col("name"), start=None)


@rule("exports/unused-export")
def unused_export(ctx: Context) -> DataFrame:
    rows = _unused(ctx, _exploded(ctx, "exports"))
    return finding(rows, "exports/unused-export", F.concat(F.lit("exported "), _q("name"), F.lit(" isn't imported by any of the file's importers")), F.array(F.concat(F.col("importers"), F.lit(" importing bindings"))))


def run_all(ctx: Context, only: tuple[str, ...] = ()) -> DataFrame:
    """The union of all rules' findings, as far as :func:`admitted`."""
    out = None
    for rule_id, query in RULES.items():
        if only and rule_id not in only:
            continue
        rows = query(ctx)
        out = rows if out is None else out.unionByName(rows)
    return admitted(out)


def admitted(findings: DataFrame) -> DataFrame:
    """Findings whose rule is for the file's language, and whose rule's stage the language's frontend reaches.

    Files that aren't parsed (manifests, environment files) have no such language and pass.
    """
    spark = findings.sparkSession
    catalogue = [(r, row[5], fixed.STAGES.index(fixed.RULE_STAGE)) for r, row in fixed.RULES.items()]
    languages = [(n, "ecmascript" if n in fixed.ECMASCRIPT else n, fixed.STAGES.index(stage)) for n, stage in fixed.LANGUAGE_STAGES.items()]
    return admit(findings.withColumn("language", C.language(F.col("path"))), spark.createDataFrame(catalogue, "rule_id string, languages string, stage int"), spark.createDataFrame(languages, "language string, family string, reach int")).drop("language")


def admit(findings: DataFrame, catalogue: DataFrame, languages: DataFrame) -> DataFrame:
    """``findings`` (rule_id, language) by two small tables: (rule_id, languages, stage) and (language, family, reach)."""
    met = findings.join(F.broadcast(catalogue), "rule_id").join(F.broadcast(languages), "language", "left")
    fits = (F.col("languages") == "any") | (F.col("languages") == F.col("family"))
    return met.where(F.col("family").isNull() | (fits & (F.col("reach") >= F.col("stage")))).select(*findings.columns)
