"""Commands: analyze, graph, model, explain, fix, init."""

from __future__ import annotations

import argparse
import json
import os
import sys

CONFIG = "factgraph.toml"


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("factgraph").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def _config(root: str):
    from factgraph.operators.report import load_config

    path = os.path.join(root, CONFIG)
    if not os.path.exists(path):
        return load_config(None)
    with open(path, encoding="utf-8") as f:
        return load_config(f.read())


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 2 findings of high severity with --ci, 1 errors."""
    parser = argparse.ArgumentParser(prog="factgraph")
    sub = parser.add_subparsers(dest="command", required=True)
    analyze = sub.add_parser("analyze")
    analyze.add_argument("root", nargs="?", default=".")
    analyze.add_argument("--format", choices=("terminal", "json", "sarif", "markdown", "html"), default="terminal")
    analyze.add_argument("--ci", action="store_true")
    analyze.add_argument("--cache")
    for name in ("graph", "model"):
        sub.add_parser(name).add_argument("root", nargs="?", default=".")
    sub.add_parser("explain").add_argument("rule")
    fix = sub.add_parser("fix")
    fix.add_argument("root", nargs="?", default=".")
    fix.add_argument("--rule", action="append", default=[])
    fix.add_argument("--file", action="append", default=[])
    fix.add_argument("--dry-run", action="store_true")
    init = sub.add_parser("init")
    init.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)

    from factgraph.operators import engine, fixes, frameworks, graph, report, resolve
    from factgraph.operators.shared import cut_lineage
    from factgraph.sources import project

    if args.command == "explain":
        try:
            print(json.dumps(report.explain(args.rule), indent=2))
        except KeyError as e:
            print(e.args[0], file=sys.stderr)
            return 1
        return 0
    if args.command == "init":
        if os.path.exists(CONFIG) and not args.force:
            print(f"{CONFIG} exists; --force overwrites it", file=sys.stderr)
            return 1
        with open(CONFIG, "w", encoding="utf-8") as f:
            f.write(report.TEMPLATE)
        return 0
    spark, roots = _session(), {"project": args.root}
    files = project.scan(spark, roots)
    if args.command == "graph":
        resolved = resolve.resolve(project.parse(files), files, engine.aliases_of(spark, files), engine.root_packages(spark, roots))
        print(report.to_dot(graph.nodes(files, resolved), resolve.edges(resolved)), end="")
        return 0
    if args.command == "model":
        print(json.dumps(frameworks.model(files, project.parse(files), "project"), indent=2))
        return 0
    findings = engine.analyze_folders(spark, roots, _config(args.root), getattr(args, "cache", None))
    if args.command == "fix":
        done = fixes.apply_all(files, fixes.plan(findings, tuple(args.rule), tuple(args.file))).collect()
        for r in done:
            print(f"{r['path']}: {r['applied']} applied{'' if not r['skipped'] else ', skipped: ' + '; '.join(r['skipped'])}")
        if not args.dry_run:
            fixes.write(args.root, {r["path"]: r["content"] for r in done if r["applied"]})
        return 0
    findings = cut_lineage(findings)
    fails = args.ci and report.gate(findings, "high").first()["fails"]
    data = report.report(findings)
    print(getattr(report, f"to_{args.format}")(data), end="")
    return 2 if fails else 0


if __name__ == "__main__":
    sys.exit(main())
