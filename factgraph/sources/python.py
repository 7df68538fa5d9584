"""Facts of Python files, from the standard library's syntax tree."""

from __future__ import annotations

import ast


def facts(source: str, language: str = "python") -> dict:
    """Raises SyntaxError for files that don't parse."""
    tree = ast.parse(source)
    lines = [0]
    for line in source.encode().splitlines(keepends=True):
        lines.append(lines[-1] + len(line))

    def span(first: ast.AST, last: ast.AST | None = None) -> dict:
        last = last or first
        return {"line": first.lineno, "start": lines[first.lineno - 1] + first.col_offset, "end": lines[last.end_lineno - 1] + last.end_col_offset}

    imports, symbols = [], []
    public = _listed(tree)
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports += [{"specifier": a.name, "kind": "static", "names": ["*"], **span(node)} for a in node.names]
        elif isinstance(node, ast.ImportFrom) and not (node.module == "__future__" and not node.level):
            imports.append({"specifier": "." * node.level + (node.module or ""), "kind": "static", "names": [a.name for a in node.names], **span(node)})
        for name, kind, payload in _declared(node):
            exported = name in public if public is not None else not name.startswith("_")
            symbols.append({"name": name, "kind": kind, "exported": exported, "params": None, "is_async": None, "returns_jsx": None, "body_start": None, "body_end": None, "body_lines": None, "extends": None, "type_refs": None, **span(node), **payload(span)})
    calls, refs = [], set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            calls.append({"callee": ast.get_source_segment(source, node.func) or "", "args": len(node.args) + len(node.keywords), **span(node)})
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            refs.add(node.id)
    calls.sort(key=lambda c: (c["start"], -c["end"]))
    exports = [{"name": s["name"], "line": s["line"], "start": s["start"], "end": s["end"]} for s in symbols if s["exported"]]
    return {"imports": imports, "exports": exports, "symbols": symbols, "calls": calls, "env_reads": [], "eval_calls": [], "dynamic_calls": [], "refs": sorted(refs), "secrets": [], "directives": []}


def _listed(tree: ast.Module) -> set[str] | None:
    """Names of ``__all__``; empty if it is computed, None if there is none."""
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets):
            items = node.value.elts if isinstance(node.value, (ast.List, ast.Tuple, ast.Set)) else []
            return {e.value for e in items if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return None


def _declared(node: ast.stmt):
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        a = node.args
        params = [*(x.arg for x in (*a.posonlyargs, *a.args)), *([f"*{a.vararg.arg}"] if a.vararg else []), *(x.arg for x in a.kwonlyargs), *([f"**{a.kwarg.arg}"] if a.kwarg else [])]

        def payload(span) -> dict:
            body = span(node.body[0], node.body[-1])
            return {"params": params, "is_async": isinstance(node, ast.AsyncFunctionDef), "returns_jsx": False, "body_start": body["start"], "body_end": body["end"], "body_lines": node.body[-1].end_lineno - node.body[0].lineno + 1}

        yield node.name, "function", payload
    elif isinstance(node, ast.ClassDef):
        bases = [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        yield node.name, "class", lambda span: {"extends": bases, "type_refs": []}
    elif isinstance(node, (ast.Assign, ast.AnnAssign)):
        for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
            if isinstance(t, ast.Name):
                yield t.id, "var", lambda span: {}
