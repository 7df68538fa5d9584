"""Graph algorithms against brute force; reports, fixes, cache and watching."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from factgraph.operators import cache, engine, fixes, graph, relops, report, search, walks
from factgraph.plans import fixtures
from factgraph.sources import project
from factgraph.streaming import watch


def closure(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.mark.parametrize("seed", range(3))
def test_reachability_and_components(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(18 + 3 * seed)}
    df = spark.createDataFrame(list(edges), "src long, dst long")
    reach = closure(edges)
    found = relops.reachable(df, df.selectExpr("src AS start")).collect()
    assert {(r.start, r.node) for r in found} == reach
    expected = {}
    for n in {x for e in edges for x in e}:
        group = {m for m in {x for e in edges for x in e} if m == n or (n, m) in reach and (m, n) in reach}
        if len(group) > 1:
            expected[n] = min(group)
    assert {r.node: r.component for r in relops.strong_components(df).collect()} == expected


def test_topological_levels(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], "src string, dst string")
    assert {r.node: r.level for r in walks.topological_levels(df).collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        walks.topological_levels(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


@pytest.mark.parametrize("seed", range(2))
def test_first_chain_is_the_queues(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in itertools.product(range(9), range(9)) if a != b and rng.random() < 0.25]
    rng.shuffle(edges)
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    marked, expected = {7, 8}, {}
    for start in (0, 1, 7):
        queue, seen = [[start]], {start}
        while queue:
            chain = queue.pop(0)
            if chain[-1] in marked:
                expected[start] = chain
                break
            for b in after.get(chain[-1], []):
                if b not in seen:
                    seen.add(b)
                    queue.append([*chain, b])
    rows = [(a, b, i) for a, own in after.items() for i, b in enumerate(own)]
    found = search.first_chain(spark.createDataFrame(rows, "src int, dst int, ord int"), spark.createDataFrame([(0,), (1,), (7,)], "start int"), spark.createDataFrame([(7,), (8,)], "node int"))
    assert {r.start: r.chain for r in found.collect()} == expected


def test_scorecard(spark):
    rows = [("r/a", "security", "high", "certain", "f"), ("r/b", "security", "low", "possible", "f"), ("r/c", "react", "critical", "certain", "f")] + [("r/d", "imports", "critical", "certain", "f")] * 5
    findings = spark.createDataFrame(rows, "rule_id string, category string, severity string, confidence string, path string")
    scores = {r.category: r.score for r in relops.category_scores(findings).collect()}
    assert scores == {"architecture": 100, "dependencies": 100, "environment": 100, "imports": 0, "performance": 100, "security": 84, "react": 75}
    assert relops.overall(relops.category_scores(findings)).first().overall == 80


def test_config():
    config = report.load_config('[analysis]\nmin_severity = "medium"\n[rules]\nenable = ["graph/*"]\n')
    assert config.min_severity == "medium" and config.enable == ("graph/*",) and report.load_config(None) == report.Config()
    for bad in ("[rules]\nother = 1", "[nope]\n", '[analysis]\nmin_severity = "awful"'):
        with pytest.raises(ValueError):
            report.load_config(bad)


@pytest.fixture(scope="module")
def findings(spark):
    return relops.cut_lineage(engine.analyze(spark, fixtures.files(spark)))


def test_report_is_the_same_however_it_is_cut(spark, findings):
    data = report.report(findings)
    again = report.report(findings.repartition(7))
    assert report.to_json(data) == report.to_json(again) and report.from_json(report.to_json(data)) == data
    assert data["summary"]["total"] == findings.count() == sum(data["summary"]["by_severity"].values())
    sarif = json.loads(report.to_sarif(data))["runs"][0]
    assert len(sarif["results"]) == data["summary"]["total"] and {r["id"] for r in sarif["tool"]["driver"]["rules"]} == {d["rule_id"] for d in data["diagnostics"]}
    assert "<script" not in report.to_html(data) and report.to_markdown(data).startswith("# Report") and "health" in report.to_terminal(data)
    assert "hunter2" not in report.to_json(data)
    assert report.read_json(spark, report.to_json(data)).count() == data["summary"]["total"]
    for bad in ("[]", "{}", '{"diagnostics": [{}], "summary": {}, "scorecard": {}}', '{"diagnostics": 1, "summary": {}, "scorecard": {}}'):
        with pytest.raises(ValueError):
            report.from_json(bad)


def test_reports_of_many_projects(spark, findings, tmp_path):
    report.write_reports(findings, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == findings.count() and {r.project_id for r in back.select("project_id").distinct().collect()} == {r.project_id for r in findings.select("project_id").distinct().collect()}
    for name in ("cycle", "next"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(report.to_json(report.report(findings, name)))
    assert report.read_reports(spark, str(tmp_path / "in")).count() == findings.where("project_id IN ('cycle', 'next')").count()


def test_numbering_by_ranges(spark):
    rows = spark.createDataFrame([(k, (i * 7919) % 101) for k in ("a", "b", None) for i in range(60)], "k string, v int").repartition(5)
    found = graph.numbered(rows, ["k"], ["v"], "place").collect()
    for k in ("a", "b", None):
        own = sorted((r.v, r.place) for r in found if r.k == k)
        assert [p for _, p in own] == list(range(60))
    assert graph.numbered(rows.limit(0), ["k"], ["v"], "place").count() == 0


def test_writes_are_all_or_none(tmp_path, monkeypatch):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    fixes.write(str(tmp_path), {"a": "A", "b": "B"})
    assert [(tmp_path / n).read_text() for n in "abc"] == ["A", "B", "c"]
    with pytest.raises(OSError):
        fixes.write(str(tmp_path), {"a": "x", "b": "y", "missing": "z"})
    assert sorted((p.name, p.read_text()) for p in tmp_path.iterdir()) == [("a", "A"), ("b", "B"), ("c", "c")]


def test_config_filter(spark, findings):
    kept = report.apply_config(findings, report.Config(min_severity="high", enable=("graph/dead-file",), disable=("security/*",)))
    assert {r.rule_id for r in kept.select("rule_id").distinct().collect()} & {"security/no-eval", "deps/unused-dependency"} == set()
    assert kept.where("rule_id = 'graph/dead-file'").count() > 0
    assert report.apply_config(findings, report.Config(exclude=("src",))).where("path LIKE 'src/%'").count() == 0


def test_every_rule_is_known():
    from factgraph.functions import fixed
    from factgraph.operators import rules

    assert set(rules.RULES) == set(fixed.RULES) and len(fixed.RULES) == 23
    assert report.explain("security/no-eval")["severity"] == "high"
    with pytest.raises(KeyError, match="known"):
        report.explain("no/such")


def test_fixes_are_guarded_and_final(spark, findings):
    files = fixtures.files(spark)
    done = {r.path: r for r in fixes.apply_all(files, fixes.plan(findings.where("project_id = 'next'"))).collect()}
    package = json.loads(done["package.json"].content)
    assert "zod" not in package["dependencies"] and "lodash" in package["dependencies"] and package["devDependencies"] == {"vitest": "1"}
    assert done[".env"].content == "# comment\nexport USED_KEY=1\nPORT=3\n" and done[".env"].applied == 1
    again = fixes.apply(done[".env"].content, [("delete_line", "GHOST_TOKEN", 3)])
    assert again.applied == 0 and again.skipped
    text = '{\n  "dependencies": {\n    "a": "1",\n    "b": "2"\n  }\n}\n'
    assert fixes.remove_dependency(text, "b") == '{\n  "dependencies": {\n    "a": "1"\n  }\n}\n'
    assert fixes.remove_dependency(text, "a") == '{\n  "dependencies": {\n    "b": "2"\n  }\n}\n'


def test_cache_warm_equals_cold(spark, tmp_path):
    folder, files = str(tmp_path / "cache"), fixtures.files(spark).where("project_id IN ('cycle', 'py')")
    plain = sorted(map(str, project.parse(files).collect()))
    cold, warm = (sorted(map(str, cache.parse_cached(spark, files, folder).select(*project.parse(files).columns).collect())) for _ in range(2))
    assert plain == cold == warm
    changed = spark.createDataFrame([("cycle", "src/a.ts", "export const z = 1;")], project.FILES)
    now = files.where("path <> 'src/a.ts' AND path <> 'src/b.ts'").unionByName(changed)
    rows = {r.path: r for r in cache.parse_cached(spark, now, folder).collect()}
    assert "src/b.ts" not in rows and rows["src/a.ts"].exports[0].name == "z"
    assert spark.read.parquet(folder).count() == len(rows)


def test_graph_nodes_and_symbols(spark):
    ctx = fixtures._context(spark)
    nodes = graph.nodes(ctx.files.where("project_id = 'forms'"), ctx.resolved.where("project_id = 'forms'"))
    rows = nodes.orderBy("node_id").collect()
    assert [r.label for r in rows] == ["index.js", "m.ts", "lib/sub", "q/index.ts", "@scope/pkg/deep", "fs", "lazy.js"] and [r.node_id for r in rows] == list(range(7))
    assert {r.label for r in graph.dependents(ctx.edges, "next", "lib/db.ts").collect()} == {"lib/data.ts", "app/page.tsx"}
    own, edges = graph.symbol_graph(ctx.symbols, ctx.calls, ctx.bindings)
    found = {(r.src, r.dst) for r in edges.where("project_id = 'next' AND kind = 'calls'").collect()}
    assert ("app/page.tsx#function#default", "lib/data.ts#function#load") in found and ("lib/data.ts#function#load", "lib/db.ts#function#query") in found
    assert {r.label for r in graph.roots(nodes, ctx.edges).where("kind = 'file'").collect()} == {"index.js"}
    assert "digraph" in report.to_dot(nodes, ctx.edges.where("project_id = 'forms'"))


def test_watch(spark, tmp_path):
    versions = [[("p", "a.ts", 1, "r/x", "T")], [("p", "a.ts", 1, "r/x", "T"), ("p", "b.ts", 2, "r/y", "T")], [("p", "b.ts", 2, "r/y", "T")]]
    seen, at = [], {"n": 0}

    def analyse():
        at["n"] += 1
        return spark.createDataFrame(versions[at["n"] - 1], "project_id string, path string, line int, rule_id string, title string")

    def note(_, new, gone):
        seen.append((sorted(r.path for r in new.collect()), sorted(r.path for r in gone.collect())))

    events = tmp_path / "events"
    events.mkdir()
    changes = spark.readStream.schema("path string").json(str(events))
    query = watch.watch(spark, changes, analyse, str(tmp_path / "state"), note, str(tmp_path / "checkpoint"), "0 seconds")
    try:
        for i in range(3):
            (events / f"{i}.tmp").write_text('{"path": "x"}\n')
            (events / f"{i}.tmp").rename(events / f"{i}.json")
            query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [(["a.ts"], []), (["b.ts"], []), ([], ["a.ts"])]


def test_watch_with_an_empty_batch_between(spark, tmp_path):
    """Batches without events leave the state as it is; a batch that is run again finds the one before it."""
    versions = [["a.ts"], ["a.ts", "b.ts"], ["b.ts", "c.ts"]]
    seen, at, steps = [], {"n": 0}, []

    def analyse():
        at["n"] += 1
        return spark.createDataFrame([("p", x, 1, "r/x", "T") for x in versions[at["n"] - 1]], "project_id string, path string, line int, rule_id string, title string")

    class Stream:
        """Takes the function for batches and calls it with batches of our own."""

        def __getattr__(self, name):
            return lambda *a, **k: steps.extend(a) or self if name == "foreachBatch" else self

    class Changes:
        writeStream = Stream()

    watch.watch(spark, Changes(), analyse, str(tmp_path / "s"), lambda b, new, gone: seen.append((b, sorted(r.path for r in new.collect()), sorted(r.path for r in gone.collect()))), "c")
    events = spark.createDataFrame([("x",)], "path string")
    steps[0](events, 0)
    steps[0](events.limit(0), 1)
    steps[0](events, 2)
    at["n"] = 1
    steps[0](events, 2)
    steps[0](events.limit(0), 3)
    steps[0](events, 4)
    assert seen == [(0, ["a.ts"], []), (2, ["b.ts"], []), (2, ["b.ts"], []), (4, ["c.ts"], ["a.ts"])]
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["batch=2", "batch=4"]


@pytest.mark.parametrize("n, m, seed", [(12, 8, 1), (30, 40, 2), (15, 60, 3), (40, 0, 4), (25, 25, 5)])
def test_closure_and_components_of_random_graphs(spark, n, m, seed):
    """Against plain search; m = 0: a long chain with a circle at its end."""
    import random

    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} if m else {*((i, i + 1) for i in range(n - 1)), (n - 1, n - 4)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    depth = {}
    for start in range(n):
        level, seen = {d for s, d in pairs if s == start}, {}
        for k in range(1, n + 2):
            seen |= {x: k for x in level if x not in seen}
            level = {d for s, d in pairs if s in level}
        depth |= {(start, x): k for x, k in seen.items()}
    found = relops.reachable(edges, edges.select(F.col("src").alias("start")))
    assert {(r.start, r.node): r.depth for r in found.collect()} == depth
    own = {a: min(b for b in range(n) if (a, b) in depth and (b, a) in depth or a == b) for a in range(n)}
    assert {r.node: r.component for r in relops.strong_components(edges).collect()} == {a: c for a, c in own.items() if sum(x == c for x in own.values()) > 1}
