"""Family B: small projects written for this suite, their analysis as queries, and the expected rows by hand."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import cache, engine, fixes, frameworks, graph, report, resolve, rules, semantic
from factgraph.sources import project
from factgraph.streaming import watch

FILES: dict[tuple[str, str], str] = {
    ("cycle", "src/a.ts"): 'import { b } from "./b";\nexport const a = () => b;\n',
    ("cycle", "src/b.ts"): 'import { a } from "./a";\nexport const b = () => a;\n',
    ("cycle", "src/clean.ts"): "export const lonely = 1;\n",
    ("clean", "main.ts"): 'import { helper } from "./util";\nhelper();\n',
    ("clean", "util.ts"): "export function helper() { return 1; }\n",
    ("forms", "index.js"): 'import def, { x as y, z } from "./m.js";\nimport * as all from "lib/sub";\nimport "./side";\nexport { q } from "./q";\nexport * from "@scope/pkg/deep";\nconst r = require("fs");\nconst lazy = () => import("./lazy");\n// import "./comment"\nconst s = "import \'./string\'";\nconst re = /import "x"/;\n',
    ("forms", "m.ts"): "export default class M {}\nexport const x = 1, z = 2;\nexport { x as renamed };\n",
    ("forms", "q/index.ts"): "export function q() {}\nexport interface Q {}\nexport type T = Q;\nexport enum E { A }\n",
    ("forms", "lazy.js"): "module.exports = {};\n",
    ("py", "pkg/__init__.py"): "from .core import run\nfrom . import util, missing_name\n",
    ("py", "pkg/core.py"): "import os\nfrom ..outside import x\nfrom .gone import y\nfrom pkg import util\n__all__ = ['run']\n\ndef run():\n    return helper()\n\ndef helper():\n    return os.getcwd()\n",
    ("py", "pkg/util.py"): "from .core import *\n_private = 1\npublic = 2\n\nclass K:\n    pass\n",
    ("py", "pkg/broken.py"): "def (:\n",
    ("next", "package.json"): '{"dependencies": {"next": "14.0.0", "react": "18.0.0", "lodash": "4.0.0", "zod": "3.0.0", "@types/node": "20"}, "devDependencies": {"vitest": "1"}}',
    ("next", ".env"): "# comment\nexport USED_KEY=1\nGHOST_TOKEN=2\nPORT=3\n",
    ("next", "app/page.tsx"): '"use client";\nimport { metadata as m } from "./meta";\nimport { load } from "@/lib/data";\nexport const metadata = { title: m };\nexport default function Page() { const k = process.env.SECRET_API_URL + process.env.NEXT_PUBLIC_URL + process.env.USED_KEY; return <main>Don\'t {load(k)}</main>; }\n',
    ("next", "app/meta.ts"): 'export const metadata = "x";\nexport const unused = 1;\n',
    ("next", "app/blog/[slug]/page.tsx"): "import { cookies } from 'next/headers';\nexport async function generateStaticParams() { cookies(); return []; }\nexport default function Post() { return (<p>hi</p>); }\n",
    ("next", "app/(shop)/@modal/api/route.ts"): "export async function POST() {}\nexport async function GET() {}\n",
    ("next", "pages/old/[id].tsx"): "export default function Old() { return null; }\n",
    ("next", "pages/api/ping.ts"): "export default function handler() {}\n",
    ("next", "lib/data.ts"): 'import { query } from "./db";\nimport _ from "lodash/fp";\nexport const load = (k) => query(_, k);\n',
    ("next", "lib/db.ts"): 'import "server-only";\nimport { nothing } from "@/gone";\nconst apiToken = "sk_live_abcdef1234567890";\nconst password = "hunter2hunter2";\nexport function query(...args) { return eval(args[0]) + new Function("x")() + apiToken + password; }\n',
    ("next", "tsconfig.json"): '{\n  // aliases\n  "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["./*"], },},\n}',
    ("react", "src/widget.tsx"): '"use client";\nimport { useState } from "react";\nexport async function Widget() { const [a] = useState(0); return <b>{a}</b>; }\n',
    ("react", "src/row.tsx"): "export const row = () => <li>row</li>;\n",
    ("react", "src/card.tsx"): "export function useCard() { return <div/>; }\nexport function useValue() { const x = 1; return x; }\n",
    ("react", "src/setup.ts"): 'import { useEffect } from "react";\nexport function setup() { useEffect(() => {}); }\nfunction unusedHelper() { return 1; }\nexport const twice = 1;\nvar dup = 1;\nvar dup = 2;\nuse(dup);\n',
    ("react", "src/top.ts"): 'import React, { useMemo } from "react";\nconst early = useMemo(() => 1);\nexport function Widgets() { return early; }\nexport const helper = () => React.useMemo(() => 2);\n',
    ("mono", "tsconfig.json"): '{ "extends": "./config/ts/deep/er/base.json", "compilerOptions": { "paths": { "@/*": ["src/*", "lib/*"], "both": ["src/none.ts", "lib/x.ts"] } } }',
    ("mono", "config/ts/deep/er/base.json"): '{ "compilerOptions": { "baseUrl": "../../../..", "paths": { "~/*": ["shared/*"], "@/*": ["old/*"] } } }',
    ("mono", "src/main.ts"): 'import { a } from "@/x";\nimport { b } from "@/y";\nimport { c } from "both";\nimport { d } from "~/z";\nimport { e } from "@/nowhere";\na; b; c; d; e;\n',
    ("mono", "src/x/index.ts"): "export const a = 1;\n",
    ("mono", "lib/x.ts"): "export const a = 2, c = 3, extra = 4;\n",
    ("mono", "lib/y.ts"): "export const b = 2;\n",
    ("mono", "shared/z.ts"): "export const d = 4;\n",
    ("syntax", "a.ts"): 'export const { a, b } = o;\nconst [c, d] = p, e = 1;\nfoo<string>("a");\nif (x) /re"/.test(y);\nconst m = new Map<string, number>(), n = 2;\nclass K { run(): void { go(); } x = make(); }\ninterface I { call(): void }\nexport function last<T>(v: T) { return bar.baz<T>(v, 1); }\n',
    ("long", "big.ts"): "export function big() {\n" + "  step();\n" * 60 + "}\nexport function small() {\n}\n",
    ("node", "package.json"): '{"dependencies": {"left-pad": "1"}}',
    ("laravel", "artisan"): "",
    ("laravel", "composer.json"): "{}",
    ("half", "artisan"): "",
    ("rootpy", "__init__.py"): "from rootpy.inner import thing\n",
    ("rootpy", "inner.py"): "class Base:\n    pass\n\n@register\ndef thing(a, *rest):\n    helper(a)\n    return Base()\n\ndef helper(x):\n    return len(x)\n",
    ("types", "src/t.ts"): "interface A extends B {}\ninterface B extends C<string> {}\ninterface C extends A {}\ninterface Self extends Self {}\ninterface Fine extends A {}\nexport type X = Fine | Self;\n",
}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, path, text) for (p, path), text in FILES.items()], project.FILES)


@functools.lru_cache(1)
def _context(spark: SparkSession) -> rules.Context:
    """The fixtures' tables, once for each session: they never change."""
    f = files(spark)
    roots = spark.createDataFrame([("rootpy", "rootpy")], "project_id string, root_package string")
    return rules.context(f, project.parse(f), engine.aliases_of(spark, f), roots)


def _facts(spark: SparkSession) -> DataFrame:
    return _context(spark).facts


def _resolved(spark: SparkSession) -> DataFrame:
    return _context(spark).resolved


def _findings(spark: SparkSession, *wanted: str) -> DataFrame:
    return rules.run_all(_context(spark), wanted)


def fx_imports(spark, sf_dir):
    return resolve.imports_of(_facts(spark)).where("project_id = 'forms'").select("path", "specifier", "kind", F.array_join("names", ",").alias("names"), "line")


def fx_exports(spark, sf_dir):
    return _facts(spark).where("project_id IN ('forms', 'py')").select("path", F.explode("exports").alias("e")).select("path", F.col("e.name").alias("name"))


def fx_resolve_js(spark, sf_dir):
    return _resolved(spark).where("project_id IN ('forms', 'next', 'mono') AND language <> 'python'").select("path", "specifier", "resolution", F.array_join("targets", ",").alias("targets"), "matched_alias")


def fx_resolve_py(spark, sf_dir):
    return _resolved(spark).where("project_id = 'py'").select("path", "specifier", "resolution", F.array_join("targets", ",").alias("targets"))


def fx_failures(spark, sf_dir):
    return _facts(spark).where("failure IS NOT NULL").select("project_id", "path")


def fx_cycles(spark, sf_dir):
    return _findings(spark, "graph/no-circular-imports").select("project_id", "path", F.array_join("evidence", ",").alias("members"))


def fx_dead_files(spark, sf_dir):
    return _findings(spark, "graph/dead-file").where("project_id NOT IN ('syntax', 'long', 'mono', 'rootpy')").select("project_id", "path")


def fx_react_rules(spark, sf_dir):
    wanted = [r for r in rules.RULES if r.startswith("react/")]
    return _findings(spark, *wanted).select("rule_id", "path", "line")


def fx_typescript_rules(spark, sf_dir):
    wanted = [r for r in rules.RULES if r.startswith("typescript/")]
    return _findings(spark, *wanted).where("project_id IN ('react', 'types')").select("rule_id", "path", "line")


def fx_next_rules(spark, sf_dir):
    wanted = [r for r in rules.RULES if r.startswith("next/")]
    return _findings(spark, *wanted).select("rule_id", "path", F.array_join("evidence", ">").alias("evidence"))


def fx_security(spark, sf_dir):
    return _findings(spark, "security/no-eval", "security/hardcoded-secret").select("rule_id", "path", "line", F.array_join("evidence", ",").alias("evidence"))


def fx_unused_deps(spark, sf_dir):
    return _findings(spark, "deps/unused-dependency").select("project_id", "target")


def fx_env(spark, sf_dir):
    return _findings(spark, "env/unused-env-var").select("project_id", "path", "line", "target")


def fx_unused_exports(spark, sf_dir):
    return _findings(spark, "exports/unused-export").select("project_id", "path", "message")


def fx_import_rules(spark, sf_dir):
    return _findings(spark, "imports/broken-path-alias", "imports/unresolved-import").select("rule_id", "project_id", "path", "line")


def fx_type_cycles(spark, sf_dir):
    return semantic.type_cycles(semantic.symbols(_facts(spark))).select("path", F.array_join("members", ",").alias("members"))


def fx_call_edges(spark, sf_dir):
    facts, resolved = _facts(spark), _resolved(spark)
    found = semantic.call_edges(semantic.calls(facts), semantic.symbols(facts), resolve.bindings(resolved))
    return found.select("project_id", "path", "callee", "to_path")


def fx_frameworks(spark, sf_dir):
    f = files(spark)
    found = frameworks.detect(project.package_dependencies(f), project.root_entries(f), f.where("path = 'package.json'").select("project_id"))
    return found.withColumn("evidence", F.array_join("evidence", ", "))


def fx_next_model(spark, sf_dir):
    f = files(spark)
    model = frameworks.next_project(f.where("project_id = 'next'"))
    app = frameworks.app_files(f, model, _facts(spark))
    return app.select("path", "kind", "rendering", "has_metadata", "has_generate_static_params", F.array_join("http_methods", ",").alias("http_methods"))


def fx_next_segments(spark, sf_dir):
    f = files(spark)
    model = frameworks.next_project(f.where("project_id = 'next'"))
    routes = frameworks.app_routes(frameworks.app_files(f, model, _facts(spark)), model)
    return routes.select("dir", F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["kind"], s["name"])), "/").alias("segments"))


def fx_pages_routes(spark, sf_dir):
    f = files(spark)
    return frameworks.pages_routes(f, frameworks.next_project(f)).select("path", "is_api", "is_dynamic")


def fx_report(spark, sf_dir):
    """Findings by rule over all fixture projects."""
    return _findings(spark).groupBy("rule_id").agg(F.count("*").cast("int").alias("n"))


def fx_symbols(spark, sf_dir):
    return _context(spark).symbols.where("project_id IN ('syntax', 'rootpy')").select("path", "name", "kind", "exported", F.array_join("params", ",").alias("params"))


def fx_calls(spark, sf_dir):
    return _context(spark).calls.where("project_id IN ('syntax', 'rootpy')").select("path", "callee", "args", "line")


def fx_refs(spark, sf_dir):
    """References of a Python file; of TypeScript ones those that are declared somewhere."""
    names = _context(spark).symbols.select("name").distinct()
    return _facts(spark).where("project_id IN ('rootpy', 'mono')").select("path", F.explode("refs").alias("name")).join(names, "name", "left_semi").select("path", "name")


def fx_large_functions(spark, sf_dir):
    return _findings(spark, "complexity/large-function").select("path", "line", "message")


def fx_unused_symbols(spark, sf_dir):
    return _findings(spark, "typescript/unused-export").select("project_id", "path", "message")


def fx_root_package(spark, sf_dir):
    return _resolved(spark).where("project_id = 'rootpy'").select("path", "specifier", "resolution", F.array_join("targets", ",").alias("targets"))


def _graph_of(spark, project_id: str):
    ctx, own = _context(spark), F.col("project_id") == project_id
    return graph.nodes(ctx.files.where(own), ctx.resolved.where(own)), ctx.edges.where(own)


def fx_graph_nodes(spark, sf_dir):
    return _graph_of(spark, "forms")[0].select("label", "kind", F.col("node_id").cast("int").alias("node_id"))


def fx_graph_find(spark, sf_dir):
    """A node by label and one by id, and all of a kind."""
    nodes, _ = _graph_of(spark, "forms")
    label, number, kind = graph.by_label(nodes, "forms", "m.ts"), graph.by_id(nodes, "forms", 4), graph.of_kind(nodes, "package")
    return label.select(F.lit("label").alias("way"), "label").unionByName(number.select(F.lit("id").alias("way"), "label")).unionByName(kind.select(F.lit("kind").alias("way"), "label"))


def fx_graph_roots(spark, sf_dir):
    return graph.roots(*_graph_of(spark, "next")).where("kind = 'file'").select("label")


def fx_graph_order(spark, sf_dir):
    """Topological places; a project with a circle has none."""
    edges = _context(spark).edges.where("kind = 'imports'")
    places = [graph.topological_order(edges.where(F.col("project_id") == p)) for p in ("mono", "cycle")]
    return places[0].unionByName(places[1]).select("label", F.col("place").cast("int").alias("place"))


def fx_graph_dot(spark, sf_dir):
    return report.dot_lines(*_graph_of(spark, "clean")).select("line")


def fx_symbol_graph(spark, sf_dir):
    ctx = _context(spark)
    _, edges = graph.symbol_graph(ctx.symbols, ctx.calls, ctx.bindings)
    return edges.where("project_id IN ('clean', 'next') AND kind IN ('calls', 'exports')").select("src", "dst", "kind")


def fx_last_write(spark, sf_dir):
    """Facts written twice: of each file the later."""
    f = spark.createDataFrame([("m", "a.ts", "export const old = 1;", 1), ("m", "a.ts", "export const fresh = 1;", 2), ("m", "b.ts", "export const b = 1;", 1)], "project_id string, path string, content string, seq int")
    kept = semantic.last_write(f, "seq")
    return semantic.symbols(project.parse(kept)).select("path", "name")


def fx_exported_symbol(spark, sf_dir):
    """The first exported symbol of a name."""
    return semantic.exported_symbol(_context(spark).symbols).where("project_id = 'forms'").select("path", "name", "kind")


def fx_admitted(spark, sf_dir):
    """Findings by the languages and stages of their rules."""
    found = spark.createDataFrame([(r, l) for r in ("es", "any", "py", "deep") for l in ("typescript", "python", None)], "rule_id string, language string")
    catalogue = spark.createDataFrame([("es", "ecmascript", 1), ("any", "any", 1), ("py", "python", 1), ("deep", "any", 3)], "rule_id string, languages string, stage int")
    languages = spark.createDataFrame([("typescript", "ecmascript", 6), ("python", "python", 1)], "language string, family string, reach int")
    return rules.admit(found, catalogue, languages).select("rule_id", "language")


def _next_report(spark):
    return report.report(_findings(spark).where("project_id = 'cycle'"))


def _lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"), 1)), "line int, text string")


def fx_report_json(spark, sf_dir):
    """The JSON report read back as rows."""
    return report.read_json(spark, report.to_json(_next_report(spark))).select("rule_id", "path", "severity")


def fx_report_sarif(spark, sf_dir):
    run = json.loads(report.to_sarif(_next_report(spark)))["runs"][0]
    rows = [(r["ruleId"], r["level"], r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in run["results"]]
    return spark.createDataFrame(rows, "rule_id string, level string, uri string, line int")


def fx_report_markdown(spark, sf_dir):
    return _lines(spark, report.to_markdown(_next_report(spark))).where("text LIKE '- %' OR text LIKE 'Health%'").select("text")


def fx_report_html(spark, sf_dir):
    return spark.createDataFrame([(m,) for m in re.findall("<tr class=([a-z]+)><td>", report.to_html(_next_report(spark)))], "severity string")


def fx_report_terminal(spark, sf_dir):
    return _lines(spark, report.to_terminal(_next_report(spark))).select("text")


def fx_route_model(spark, sf_dir):
    """The route model's JSON, a row for each route."""
    f = files(spark)
    data = frameworks.model(f, _facts(spark), "next")
    rows = [("router", data["router"])] + [("app", r["path"]) for r in data["app"]] + [("pages", r["path"]) for r in data["pages"]]
    return spark.createDataFrame(rows, "part string, value string")


def fx_rule_docs(spark, sf_dir):
    rows = [(r, d["category"], d["severity"], d["maturity"]) for r in rules.RULES if r.startswith("security/") for d in [report.explain(r)]]
    return spark.createDataFrame(rows, "rule_id string, category string, severity string, maturity string")


def fx_config(spark, sf_dir):
    """The settings that the template of a configuration file stands for."""
    c = report.load_config(report.TEMPLATE)
    return spark.createDataFrame([(c.min_severity, c.min_confidence, len(c.enable), len(c.disable))], "min_severity string, min_confidence string, enabled int, disabled int")


def fx_jsonc(spark, sf_dir):
    texts = ['{"a": "// no", /* x */ "b": [1, 2,], }', '{ // c\n "k": "/* s */" }']
    return spark.createDataFrame([(i, json.dumps(json.loads(project.jsonc(t)))) for i, t in enumerate(texts)], "id int, json string")


def fx_fix_plan(spark, sf_dir):
    return fixes.plan(_findings(spark).where("project_id = 'next'")).select("path", "target", "line", "edit")


def fx_fix_scope(spark, sf_dir):
    return fixes.plan(_findings(spark).where("project_id = 'next'"), ("env/unused-env-var",), (".env",)).select("path", "target")


def fx_fix_apply(spark, sf_dir):
    done = fixes.apply_all(files(spark), fixes.plan(_findings(spark).where("project_id = 'next'")))
    return done.select("path", "applied", F.size("skipped").alias("skipped"), F.contains("content", F.lit("zod")).alias("has_zod"), F.contains("content", F.lit("GHOST")).alias("has_ghost"))


def fx_fingerprint(spark, sf_dir):
    return cache.fingerprint(files(spark).where("project_id = 'clean'")).select("path", "content_hash")


def fx_editor(spark, sf_dir):
    """What an editor shows after a change: a file with findings, and one to clear."""
    found = _findings(spark).where("project_id = 'cycle'")
    other = found.where("path = 'src/clean.ts'").withColumn("path", F.lit("src/gone.ts"))
    return watch.by_file(found, other).select("path", F.size("findings").alias("n"))


def _values(names: str, *rows: tuple) -> str:
    sql = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) + "::INT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) AS t({names})"


GOLDEN = {
    "fx_imports": _values(
        "path, specifier, kind, names, line",
        ("index.js", "./m.js", "static", "default,x,z", 1), ("index.js", "lib/sub", "static", "*", 2), ("index.js", "./side", "static", "", 3), ("index.js", "./q", "re_export", "q", 4),
        ("index.js", "@scope/pkg/deep", "re_export", "*", 5), ("index.js", "fs", "require", "", 6), ("index.js", "./lazy", "dynamic", "", 7),
    ),
    "fx_exports": _values(
        "path, name",
        ("m.ts", "default"), ("m.ts", "x"), ("m.ts", "z"), ("m.ts", "renamed"), ("q/index.ts", "q"), ("q/index.ts", "Q"), ("q/index.ts", "T"), ("q/index.ts", "E"),
        ("pkg/core.py", "run"), ("pkg/util.py", "public"), ("pkg/util.py", "K"),
    ),
    "fx_resolve_js": _values(
        "path, specifier, resolution, targets, matched_alias",
        ("index.js", "./m.js", "project", "m.ts", False), ("index.js", "lib/sub", "external", "", False), ("index.js", "./side", "unresolved", "", False), ("index.js", "./q", "project", "q/index.ts", False),
        ("index.js", "@scope/pkg/deep", "external", "", False), ("index.js", "fs", "external", "", False), ("index.js", "./lazy", "project", "lazy.js", False),
        ("app/page.tsx", "./meta", "project", "app/meta.ts", False), ("app/page.tsx", "@/lib/data", "project", "lib/data.ts", True), ("app/blog/[slug]/page.tsx", "next/headers", "external", "", False),
        ("lib/data.ts", "./db", "project", "lib/db.ts", False), ("lib/data.ts", "lodash/fp", "external", "", False), ("lib/db.ts", "server-only", "external", "", False), ("lib/db.ts", "@/gone", "unresolved", "", True),
        ("src/main.ts", "@/x", "project", "src/x/index.ts", True), ("src/main.ts", "@/y", "project", "lib/y.ts", True), ("src/main.ts", "both", "project", "lib/x.ts", True),
        ("src/main.ts", "~/z", "project", "shared/z.ts", True), ("src/main.ts", "@/nowhere", "unresolved", "", True),
    ),
    "fx_resolve_py": _values(
        "path, specifier, resolution, targets",
        ("pkg/__init__.py", ".core", "project", "pkg/core.py"), ("pkg/__init__.py", ".", "project", "pkg/__init__.py,pkg/util.py"), ("pkg/core.py", "os", "external", ""),
        ("pkg/core.py", "..outside", "unresolved", ""), ("pkg/core.py", ".gone", "unresolved", ""), ("pkg/core.py", "pkg", "project", "pkg/__init__.py"), ("pkg/util.py", ".core", "project", "pkg/core.py"),
    ),
    "fx_failures": _values("project_id, path", ("py", "pkg/broken.py")),
    "fx_cycles": _values("project_id, path, members", ("cycle", "src/a.ts", "src/a.ts,src/b.ts"), ("py", "pkg/__init__.py", "pkg/__init__.py,pkg/core.py,pkg/util.py")),
    "fx_dead_files": _values(
        "project_id, path",
        ("cycle", "src/clean.ts"), ("py", "pkg/broken.py"), ("react", "src/widget.tsx"), ("react", "src/row.tsx"), ("react", "src/card.tsx"), ("react", "src/setup.ts"), ("react", "src/top.ts"), ("types", "src/t.ts"),
    ),
    "fx_react_rules": _values(
        "rule_id, path, line",
        ("react/async-client-component", "src/widget.tsx", 3), ("react/component-naming", "src/row.tsx", 1), ("react/hook-returns-jsx", "src/card.tsx", 1), ("react/hook-in-non-component", "src/setup.ts", 2), ("react/hook-in-non-component", "src/top.ts", 2),
    ),
    "fx_typescript_rules": _values(
        "rule_id, path, line",
        ("typescript/duplicate-declaration", "src/setup.ts", 6), ("typescript/unreachable-symbol", "src/setup.ts", 3), ("typescript/circular-type-reference", "src/t.ts", 1), ("typescript/circular-type-reference", "src/t.ts", 4),
    ),
    "fx_next_rules": _values(
        "rule_id, path, evidence",
        ("next/private-env-in-client", "app/page.tsx", ""), ("next/private-env-in-client", "app/page.tsx", ""), ("next/server-only-in-client", "app/page.tsx", "app/page.tsx>lib/data.ts>lib/db.ts"),
        ("next/forced-dynamic", "app/blog/[slug]/page.tsx", ""), ("next/client-metadata-ignored", "app/page.tsx", ""), ("next/mixed-router", "pages/api/ping.ts", ""),
    ),
    "fx_security": _values(
        "rule_id, path, line, evidence",
        ("security/no-eval", "lib/db.ts", 5, ""), ("security/no-eval", "lib/db.ts", 5, ""), ("security/hardcoded-secret", "lib/db.ts", 3, "starts with `sk_l`, 24 characters"), ("security/hardcoded-secret", "lib/db.ts", 4, "starts with `hunt`, 14 characters"),
    ),
    "fx_unused_deps": _values("project_id, target", ("next", "zod"), ("node", "left-pad")),
    "fx_env": _values("project_id, path, line, target", ("next", ".env", 3, "GHOST_TOKEN")),
    "fx_unused_exports": _values("project_id, path, message", ("forms", "m.ts", "exported `renamed` isn't imported by any of the file's importers"), ("mono", "lib/x.ts", "exported `a` isn't imported by any of the file's importers"), ("mono", "lib/x.ts", "exported `extra` isn't imported by any of the file's importers")),
    "fx_import_rules": _values(
        "rule_id, project_id, path, line",
        ("imports/broken-path-alias", "next", "lib/db.ts", 2), ("imports/broken-path-alias", "mono", "src/main.ts", 5), ("imports/unresolved-import", "forms", "index.js", 3), ("imports/unresolved-import", "py", "pkg/core.py", 2), ("imports/unresolved-import", "py", "pkg/core.py", 3),
    ),
    "fx_type_cycles": _values("path, members", ("src/t.ts", "A,B,C"), ("src/t.ts", "Self")),
    "fx_call_edges": _values(
        "project_id, path, callee, to_path",
        ("clean", "main.ts", "helper", "util.ts"), ("py", "pkg/core.py", "helper", "pkg/core.py"), ("next", "app/page.tsx", "load", "lib/data.ts"), ("next", "lib/data.ts", "query", "lib/db.ts"),
        ("rootpy", "inner.py", "Base", "inner.py"), ("rootpy", "inner.py", "helper", "inner.py"),
    ),
    "fx_frameworks": _values(
        "project_id, framework, confidence, version, evidence",
        ("next", "next", "certain", "14.0.0", "depends on next 14.0.0, has app, has pages"), ("next", "react", "likely", "18.0.0", "depends on react 18.0.0"), ("node", "node", "likely", None, "has package.json"),
        ("laravel", "laravel", "possible", None, "has artisan, has composer.json"),
    ),
    "fx_symbols": _values(
        "path, name, kind, exported, params",
        ("a.ts", "e", "const", False, None), ("a.ts", "m", "const", False, None), ("a.ts", "n", "const", False, None), ("a.ts", "K", "class", False, None), ("a.ts", "I", "interface", False, None),
        ("a.ts", "last", "function", True, "v"), ("inner.py", "Base", "class", True, None), ("inner.py", "thing", "function", True, "a,*rest"), ("inner.py", "helper", "function", True, "x"),
    ),
    "fx_calls": _values(
        "path, callee, args, line",
        ("a.ts", "foo", 1, 3), ("a.ts", '/re"/.test', 1, 4), ("a.ts", "go", 0, 6), ("a.ts", "make", 0, 6), ("a.ts", "bar.baz", 2, 8), ("inner.py", "helper", 1, 6), ("inner.py", "Base", 0, 7), ("inner.py", "len", 1, 10),
    ),
    "fx_refs": _values("path, name", ("src/main.ts", "a"), ("src/main.ts", "b"), ("src/main.ts", "c"), ("src/main.ts", "d"), ("src/main.ts", "e"), ("inner.py", "a"), ("inner.py", "helper"), ("inner.py", "Base"), ("inner.py", "x")),
    "fx_large_functions": _values("path, line, message", ("big.ts", 1, "`big` has 62 lines; the limit is 50")),
    "fx_unused_symbols": _values("project_id, path, message", ("mono", "lib/x.ts", "exported `a` isn't imported anywhere"), ("mono", "lib/x.ts", "exported `extra` isn't imported anywhere")),
    "fx_root_package": _values("path, specifier, resolution, targets", ("__init__.py", "rootpy.inner", "project", "inner.py")),
    "fx_graph_nodes": _values("label, kind, node_id", ("index.js", "file", 0), ("m.ts", "file", 1), ("lib/sub", "package", 2), ("q/index.ts", "file", 3), ("@scope/pkg/deep", "package", 4), ("fs", "package", 5), ("lazy.js", "file", 6)),
    "fx_graph_roots": _values("label", (".env",), ("app/(shop)/@modal/api/route.ts",), ("app/blog/[slug]/page.tsx",), ("app/page.tsx",), ("package.json",), ("pages/api/ping.ts",), ("pages/old/[id].tsx",), ("tsconfig.json",)),
    "fx_graph_order": _values("label, place", ("src/main.ts", 0), ("lib/x.ts", 1), ("lib/y.ts", 2), ("shared/z.ts", 3), ("src/x/index.ts", 4)),
    "fx_graph_dot": _values("line", ("digraph factgraph {",), ('  "main.ts" [kind=file];',), ('  "util.ts" [kind=file];',), ('  "main.ts" -> "util.ts" [label="imports"];',), ("}",)),
    "fx_symbol_graph": _values(
        "src, dst, kind",
        ("app/(shop)/@modal/api/route.ts", "app/(shop)/@modal/api/route.ts#function#GET", "exports"), ("app/(shop)/@modal/api/route.ts", "app/(shop)/@modal/api/route.ts#function#POST", "exports"),
        ("app/blog/[slug]/page.tsx", "app/blog/[slug]/page.tsx#function#default", "exports"), ("app/blog/[slug]/page.tsx", "app/blog/[slug]/page.tsx#function#generateStaticParams", "exports"),
        ("app/meta.ts", "app/meta.ts#const#metadata", "exports"), ("app/meta.ts", "app/meta.ts#const#unused", "exports"), ("app/page.tsx", "app/page.tsx#const#metadata", "exports"),
        ("app/page.tsx", "app/page.tsx#function#default", "exports"), ("lib/data.ts", "lib/data.ts#function#load", "exports"), ("lib/db.ts", "lib/db.ts#function#query", "exports"),
        ("pages/api/ping.ts", "pages/api/ping.ts#function#default", "exports"), ("pages/old/[id].tsx", "pages/old/[id].tsx#function#default", "exports"), ("util.ts", "util.ts#function#helper", "exports"),
        ("app/page.tsx#function#default", "lib/data.ts#function#load", "calls"), ("lib/data.ts#function#load", "lib/db.ts#function#query", "calls"),
    ),
    "fx_last_write": _values("path, name", ("a.ts", "fresh"), ("b.ts", "b")),
    "fx_exported_symbol": _values("path, name, kind", ("m.ts", "default", "class"), ("m.ts", "x", "const"), ("m.ts", "z", "const"), ("q/index.ts", "q", "function"), ("q/index.ts", "Q", "interface"), ("q/index.ts", "T", "type"), ("q/index.ts", "E", "enum")),
    "fx_admitted": _values(
        "rule_id, language", ("es", "typescript"), ("es", None), ("any", "typescript"), ("any", "python"), ("any", None), ("py", "python"), ("py", None), ("deep", "typescript"), ("deep", None),
    ),
    "fx_report_json": _values("rule_id, path, severity", ("graph/no-circular-imports", "src/a.ts", "high"), ("graph/dead-file", "src/clean.ts", "low")),
    "fx_report_sarif": _values("rule_id, level, uri, line", ("graph/no-circular-imports", "error", "src/a.ts", 1), ("graph/dead-file", "note", "src/clean.ts", 1)),
    "fx_report_markdown": _values(
        "text", ("Health: **97** / 100, findings: 2",), ("- **high** (certain) `graph/no-circular-imports` src/a.ts:1: files import each other in a circle: src/a.ts, src/b.ts",),
        ("- **low** (possible) `graph/dead-file` src/clean.ts:1: no file imports `src/clean.ts`",),
    ),
    "fx_report_html": _values("severity", ("high",), ("low",)),
    "fx_report_terminal": _values(
        "text", ("HIGH     src/a.ts:1 graph/no-circular-imports: files import each other in a circle: src/a.ts, src/b.ts",), ("LOW      src/clean.ts:1 graph/dead-file: no file imports `src/clean.ts`",),
        ("2 findings (1 high, 1 low), health 97",),
    ),
    "fx_route_model": _values(
        "part, value", ("router", "mixed"), ("app", "app/page.tsx"), ("app", "app/blog/[slug]/page.tsx"), ("app", "app/(shop)/@modal/api/route.ts"), ("pages", "pages/old/[id].tsx"), ("pages", "pages/api/ping.ts"),
    ),
    "fx_rule_docs": _values("rule_id, category, severity, maturity", ("security/hardcoded-secret", "security", "high", "preview"), ("security/no-eval", "security", "high", "stable")),
    "fx_config": _values("min_severity, min_confidence, enabled, disabled", ("info", "unknown", 0, 0)),
    "fx_jsonc": _values("id, json", (0, '{"a": "// no", "b": [1, 2]}'), (1, '{"k": "/* s */"}')),
    "fx_fix_plan": _values("path, target, line, edit", (".env", "GHOST_TOKEN", 3, "delete_line"), ("package.json", "zod", 1, "remove_dependency")),
    "fx_fix_scope": _values("path, target", (".env", "GHOST_TOKEN")),
    "fx_fix_apply": _values("path, applied, skipped, has_zod, has_ghost", (".env", 1, 0, False, False), ("package.json", 1, 0, False, False)),
    "fx_fingerprint": "SELECT path, sha256(content) AS content_hash FROM (VALUES " + ", ".join("('%s', '%s')" % (path, text.replace("'", "''")) for (p, path), text in FILES.items() if p == "clean") + ") AS t(path, content)",
    "fx_editor": _values("path, n", ("src/a.ts", 1), ("src/clean.ts", 1), ("src/gone.ts", 0)),
    "fx_report": _values(
        "rule_id, n",
        *[(r, 1) for r in ("complexity/large-function", "env/unused-env-var", "next/client-metadata-ignored", "next/forced-dynamic", "next/mixed-router", "next/server-only-in-client", "react/async-client-component", "react/component-naming", "react/hook-returns-jsx", "typescript/duplicate-declaration")],
        *[(r, 2) for r in ("deps/unused-dependency", "graph/no-circular-imports", "imports/broken-path-alias", "next/private-env-in-client", "react/hook-in-non-component", "security/hardcoded-secret", "security/no-eval", "typescript/circular-type-reference", "typescript/unused-export")],
        ("exports/unused-export", 3), ("imports/unresolved-import", 3), ("typescript/unreachable-symbol", 6), ("graph/dead-file", 10),
    ),
    "fx_graph_find": _values("way, label", ("label", "m.ts"), ("id", "@scope/pkg/deep"), ("kind", "lib/sub"), ("kind", "@scope/pkg/deep"), ("kind", "fs")),
    "fx_next_model": _values(
        "path, kind, rendering, has_metadata, has_generate_static_params, http_methods",
        ("app/page.tsx", "page", "client", True, False, ""), ("app/blog/[slug]/page.tsx", "page", "server", False, True, ""), ("app/(shop)/@modal/api/route.ts", "route", "server", False, False, "GET,POST"),
    ),
    "fx_next_segments": _values("dir, segments", ("app", ""), ("app/blog/[slug]", "static:blog/dynamic:slug"), ("app/(shop)/@modal/api", "route_group:shop/parallel_slot:modal/static:api")),
    "fx_pages_routes": _values("path, is_api, is_dynamic", ("pages/old/[id].tsx", False, True), ("pages/api/ping.ts", True, False)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("fx_")}


def oracle_sql() -> dict[str, str]:
    return GOLDEN
