"""Facts of source files, and where files come from."""

import pytest

from factgraph.sources import javascript, project, python


def js(source, language="tsx"):
    return javascript.facts(source, language)


def names(rows, key="name"):
    return [r[key] for r in rows]


def test_imports_in_source_order():
    found = js('import a, { b as c } from "x";\nimport type { T } from "./t";\nexport * as ns from "y";\nif (q) { require("z") }\nrequire(dynamic);\nimport("");\nimport("w");\n')["imports"]
    assert [(i["specifier"], i["kind"], i["names"], i["line"]) for i in found] == [("x", "static", ["default", "b"], 1), ("./t", "static", ["T"], 2), ("y", "re_export", ["*"], 3), ("z", "require", [], 4), ("w", "dynamic", [], 7)]


def test_directives_stop_at_the_first_statement():
    assert js('"use client";\n"use strict";\n"use server";\nf();\n"use client";')["directives"] == ["use client", "use server"]


def test_exports_and_inner_names():
    f = js("const a = 1;\nexport { a as b };\nexport const { c } = x, d = 2;\nexport default () => <p/>;\nexport abstract class K {}\nexport type T = { a: string };\n")
    assert names(f["exports"]) == ["b", "d", "default", "K", "T"]
    assert {s["name"]: s["exported"] for s in f["symbols"]} == {"a": True, "d": True, "default": True, "K": True, "T": True}
    assert next(s for s in f["symbols"] if s["name"] == "default")["returns_jsx"]


def test_functions():
    f = js("async function f({ a }, [b], ...c) {\n  const g = () => { return <p/>; };\n  return g;\n}\nconst h = async (x: number): Promise<void> => {\n  return x ? <b>{x}</b> : null;\n};\n", "tsx")
    a, b = f["symbols"]
    assert (a["params"], a["is_async"], a["returns_jsx"], a["body_lines"]) == (["{}", "[]", "..."], True, False, 4)
    assert (b["name"], b["kind"], b["params"], b["is_async"], b["returns_jsx"]) == ("h", "function", ["x"], True, True)


def test_literals_regexes_and_jsx_text_hide_nothing():
    f = js("const a = /[\"'/]eval(/; const t = `${eval(1)} it's`; const e = <p title='x'>Don't {eval(2)} <Foo.Bar/></p>; eval(3);\n")
    assert len(f["eval_calls"]) == 3 and "Foo" in f["refs"]


def test_environment_eval_and_dynamic_apis():
    f = js('import { cookies, other } from "next/headers";\nprocess.env.A; process.env["B"]; x.process.env.C;\nnew Function("a"); window.eval(b); my.eval(c); cookies(); headers();\n')
    assert names(f["env_reads"]) == ["A", "B"] and sorted(names(f["eval_calls"])) == ["new Function", "window.eval"] and names(f["dynamic_calls"]) == ["cookies"]


def test_secrets_show_a_preview_only():
    f = js('const apiToken: string = "abcdefgh1";\nconst k = { password: "longenough", note: "longenough" };\nconst x = "ghp_0123456789abcdef";\nconst token = "your-token-here";\nobj.secret = "s3cr3tvalue";\n')
    assert [(s["binding"], s["preview"], s["signal"]) for s in f["secrets"]] == [("apiToken", "abcd", "suspicious_name"), ("password", "long", "suspicious_name"), ("x", "ghp_", "known_prefix"), ("obj.secret", "s3cr", "suspicious_name")]


def test_spans_count_bytes():
    f = js("// é\nconst a = f(1);\n")
    assert f["calls"][0] == {"callee": "f", "args": 1, "line": 2, "start": 16, "end": 20}


def test_interfaces_and_classes():
    f = js("export interface A<T> extends B<T>, C { x: D; }\nclass E extends F implements G { y: H; m() { return 1; } }\n", "typescript")
    assert [(s["name"], s["kind"], s["extends"], s["type_refs"]) for s in f["symbols"]] == [("A", "interface", ["B", "C"], ["D"]), ("E", "class", ["F", "G"], ["H"])]


def test_broken_javascript_gives_what_it_can():
    for source in ("import {", "export", "const", "function f(", "class", "<", "`${", "a(", "export {", "({", "import x from", "const a = <p"):
        js(source)


def test_python_facts():
    f = python.facts("from __future__ import annotations\nimport a.b as c\nfrom ..m import x as y\n\n@deco\nasync def f(a, *b, k=1):\n    '''doc'''\n    return g(a)\n\n_p, q = 1, 2\nr = 3\nclass K(Base):\n    pass\n")
    assert [(i["specifier"], i["names"]) for i in f["imports"]] == [("a.b", ["*"]), ("..m", ["x"])]
    assert [(s["name"], s["kind"], s["exported"]) for s in f["symbols"]] == [("f", "function", True), ("r", "var", True), ("K", "class", True)]
    assert f["symbols"][0]["is_async"] and f["symbols"][0]["body_lines"] == 2 and f["calls"][0]["callee"] == "g" and "deco" in f["refs"]
    assert names(python.facts("__all__ = ['a']\ndef a(): pass\ndef b(): pass\n")["exports"]) == ["a"]
    assert python.facts("__all__ = x()\ndef a(): pass\n")["exports"] == []
    with pytest.raises(SyntaxError):
        python.facts("def (:")


def test_jsonc_and_aliases():
    text = '{ // c\n "extends": "./base", "compilerOptions": { "paths": { "@/*": ["./src/*"], "exact": ["./e.ts"], "@/lib/*": ["l/*"], } } /* x */ }'
    base = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["old/*"], "~/*": ["root/*"]}}}'
    assert project.jsonc('{"a": "// no", }') == '{"a": "// no" }'
    assert project.aliases({"tsconfig.json": text, "base.json": base}) == [(0, "exact", None, 0, "e.ts"), (1, "@/lib/", "", 0, "l/*"), (2, "@/", "", 0, "src/*"), (3, "~/", "", 0, "root/*")]
    assert project.aliases({}) == [] and project.aliases({"tsconfig.json": "nonsense"}) == []
    many = {"tsconfig.json": '{"extends": "./a/b/c/d/e/f", "compilerOptions": {"paths": {"@/*": ["x/*", "y/*"]}}}', "a/b/c/d/e/f.json": '{"compilerOptions": {"baseUrl": "../..", "paths": {"~/*": ["z/*"], "@/*": ["w/*"]}}}'}
    assert project.aliases(many) == [(0, "@/", "", 0, "x/*"), (0, "@/", "", 1, "y/*"), (1, "~/", "", 0, "a/b/c/z/*")]
    assert project.parent_config('{"extends": "@tsconfig/node"}') is None and project.parent_config("[]") is None


def test_patterns_declare_no_names():
    f = js("export const { a, b: { c } = {}, ...d } = o;\nconst [e, f = 1] = p, g = 2;\nlet h;\n", "typescript")
    assert names(f["symbols"]) == ["g", "h"] and f["exports"] == []


def test_generic_calls_and_what_is_none():
    calls = lambda source, language="typescript": [(c["callee"], c["args"]) for c in js(source, language)["calls"]]
    assert calls('foo<string>("a"); b.c<{ x: number }, [y, z]>(1, 2); new Map<string, number>(); f(new Set<a, b>(), 1);') == [("foo", 1), ("b.c", 2), ("f", 2)]
    assert calls("g(a < b, c > d); if (a < b && c > (d)) {}") == [("g", 2)]
    assert calls("g(a<b>(c));", "javascript") == [("g", 1)]
    assert calls("class A extends B {\n  constructor(a) { super(a); }\n  run(): void { go(); }\n  get v() { return q(); }\n  over(a: string);\n  w = make();\n  @dec() y = 1;\n}\n") == [("super", 1), ("go", 0), ("q", 0), ("make", 0), ("dec", 0)]
    assert calls("interface I { m(a: string): void; n(): I }\ntype F = { p(): void };\nconst o = { meth(a) { inner(); }, v: outer() };\nc ? yes() : no();\n") == [("inner", 0), ("outer", 0), ("yes", 0), ("no", 0)]
    assert calls("function a() {} function* b() {} async function c() {} switch (k()) { case one(): two(); }") == [("k", 0), ("one", 0), ("two", 0)]


def test_patterns_after_conditions_and_blocks():
    f = js("if (x) /re\"/.test(y);\nconst k = 1;\nwhile (z) /a'/.exec(z);\nconst l = (a) / b / c;\nfunction f() {}\n/x\"/.test(f);\nexport const q = { a: 1 } / 2;\n", "javascript")
    assert names(f["symbols"]) == ["k", "l", "f", "q"]


@pytest.mark.parametrize(
    "line, path, is_dir, hit",
    [
        ("src/*.js", "src/a.js", False, True), ("src/*.js", "src/a/b.js", False, False), ("**/gen/x.ts", "gen/x.ts", False, True), ("**/gen/x.ts", "a/b/gen/x.ts", False, True),
        ("a/**/z.ts", "a/z.ts", False, True), ("a/**/z.ts", "a/b/c/z.ts", False, True), ("a/**/z.ts", "b/a/z.ts", False, False), ("/top", "top", False, True), ("/top", "x/top", False, False),
        ("any", "x/any", True, True), ("dir/", "dir", False, False), ("dir/", "x/dir", True, True), ("out/**", "out/a/b", False, True), ("out/**", "out", True, False), ("f?.ts", "fa.ts", False, True),
        ("f?.ts", "f/.ts", False, False), ("[ab]c", "bc", False, True), ("[!ab]c", "bc", False, False), ("\\#x", "#x", False, True), ("# c", "# c", False, False), ("x  ", "x", False, True), ("a.b", "aXb", False, False),
    ],
)
def test_ignore_patterns(line, path, is_dir, hit):
    found = project.ignore_pattern(line)
    assert (found is not None and project._ignored([("", found)], path, is_dir)) == hit


def test_scan(spark, tmp_path):
    for path, text in {"a/__init__.py": "", ".env": "A=1", ".hidden": "", "_b.ts": "x", "node_modules/x.js": "", "dist/y.js": "", "skip/z.ts": "", "log.tmp": "", "keep.tmp": "", ".gitignore": "skip/\n*.tmp\n!keep.tmp\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = {r.path: r.content for r in project.scan(spark, {"p": str(tmp_path)}).collect()}
    assert found == {".env": "A=1", "_b.ts": "x", "a/__init__.py": "", "keep.tmp": ""}
    (tmp_path / "a/.gitignore").write_text("/own.ts\n!*.tmp\n")
    (tmp_path / ".ignore").write_text("keep.tmp\n")
    for path in ("a/own.ts", "a/b/own.ts", "a/c.tmp"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text("")
    assert list(project.walk(str(tmp_path))) == [".env", "_b.ts", "a/__init__.py", "a/c.tmp", "a/b/own.ts"]


def test_warm_run_reads_only_what_changed(spark, tmp_path, monkeypatch):
    from factgraph.operators import cache, engine

    root, folder = tmp_path / "p", str(tmp_path / "cache")
    root.mkdir()
    (root / "a.ts").write_text('import { b } from "./b";\nb();\n')
    (root / "b.ts").write_text("export const b = 1;\n")
    (root / "c.ts").write_text("export const c = 1;\n")
    listed = lambda: project.listing(spark, {"p": str(root)})
    columns = ["project_id", "path", "exports", "imports"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    cold = rows(cache.parse_listed(spark, listed(), folder))
    assert cold == rows(project.parse(project.scan(spark, {"p": str(root)})))
    read = []
    plain = project.read
    monkeypatch.setattr(project, "read", lambda df: read.append(sorted(r.path for r in df.collect())) or plain(df))
    assert rows(cache.parse_listed(spark, listed(), folder)) == cold and read.pop() == []
    (root / "b.ts").write_text("export const b = 2, more = 3;\n")
    (root / "c.ts").unlink()
    import os

    os.utime(root / "a.ts", (1, 1))  # a new time, the same content
    now = {r.path: r for r in cache.parse_listed(spark, listed(), folder).collect()}
    assert read.pop() == ["a.ts", "b.ts"] and sorted(now) == ["a.ts", "b.ts"] and len(now["b.ts"].exports) == 2
    cache.parse_listed(spark, listed(), folder).count()
    assert read.pop() == []
    monkeypatch.undo()
    found = sorted((r.rule_id, r.path) for r in engine.analyze_folders(spark, {"p": str(root)}, cached=folder).collect())
    assert found == sorted((r.rule_id, r.path) for r in engine.analyze_folders(spark, {"p": str(root)}).collect()) and found


def test_data_source_and_table_function(spark, tmp_path):
    from factgraph.sources import datasource

    datasource.register(spark)
    (tmp_path / "_b.ts").write_text('import { x } from "./c";')
    rows = spark.read.format("project").option("project_id", "p").load(str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("p", "_b.ts", 'import { x } from "./c";')]
    found = spark.sql("""SELECT * FROM extract_imports('import { x } from "./c"; import y from "z";', 'typescript')""").collect()
    assert [(r.specifier, r.names) for r in found] == [("./c", ["x"]), ("z", ["default"])]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    from factgraph.__main__ import main

    monkeypatch.chdir(tmp_path)
    assert main(["explain", "security/no-eval"]) == 0 and main(["explain", "nothing"]) == 1
    assert main(["init"]) == 0 and main(["init"]) == 1 and main(["init", "--force"]) == 0
    (tmp_path / "evil.ts").write_text("eval(input);\n")
    (tmp_path / "package.json").write_text('{\n  "dependencies": {\n    "lodash": "4"\n  }\n}\n')
    capsys.readouterr()
    assert main(["analyze", str(tmp_path), "--format", "markdown", "--ci"]) == 2
    assert "security/no-eval" in capsys.readouterr().out
    assert main(["fix", str(tmp_path)]) == 0 and "lodash" not in (tmp_path / "package.json").read_text()
    assert main(["graph", str(tmp_path)]) == 0 and "evil.ts" in capsys.readouterr().out
    assert main(["model", str(tmp_path)]) == 0
