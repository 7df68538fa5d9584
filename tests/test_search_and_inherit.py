"""Breadth-first ways, inherited settings and aliases against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from factgraph.operators import inherit, resolve, search


def plain_chains(after, starts, marked):
    out = {}
    for start in starts:
        queue, seen = [[start]], {start}
        while queue:
            way = queue.pop(0)
            if way[-1] in marked:
                out[start] = (way[-1], len(way) - 1, way)
                break
            for node in after.get(way[-1], []):
                if node not in seen:
                    seen.add(node)
                    queue.append([*way, node])
    return out


@pytest.mark.parametrize("farthest", [1 << 62, 200])
def test_ways_are_the_queues(spark, monkeypatch, farthest):
    """Also where places have to be numbered anew; a long chain, circles, repeated edges' ends, starts without a hit."""
    monkeypatch.setattr(search, "FARTHEST", farthest)
    rng = random.Random(5)
    after = {a: rng.sample(range(40), rng.randrange(1, 4)) for a in range(40)} | {100 + i: [101 + i] for i in range(9)} | {200: [201], 201: [200]}
    rows = [(a, b, i) for a, own in after.items() for i, b in enumerate(own)]
    starts, marked = [*range(0, 40, 3), 100, 200, 999], {7, 23, 109}
    found = search.first_chain(spark.createDataFrame(rows, "src int, dst int, ord int"), spark.createDataFrame([(s,) for s in starts], "start int"), spark.createDataFrame([(m,) for m in marked], "node int"))
    assert {r.start: (r.hit, r.depth, r.chain) for r in found.collect()} == plain_chains(after, starts, marked)


def test_ways_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string, ord int")
    one = spark.createDataFrame([("a",)], "start string")
    assert search.first_chain(none, one, spark.createDataFrame([], "node string")).count() == 0
    assert [tuple(r) for r in search.first_chain(none, one, one.selectExpr("start AS node")).collect()] == [("a", "a", 0, ["a"])]
    assert search.first_chain(none, one.limit(0), one.selectExpr("start AS node")).count() == 0


def test_settings_of_all_ancestors(spark):
    """Deep chains, a circle, unknown parents, nulls and repeated rows."""
    rng = random.Random(6)
    rows = [(i, rng.randrange(max(0, i - 2), i) if i % 50 else None, {rng.choice("abc"): str(i)} if rng.random() < 0.2 else None) for i in range(300)]
    rows += [(400, 401, {"a": "x"}), (401, 402, {"b": "y"}), (402, 401, {"b": "z", "c": "w"}), (403, 999, {"a": "q"}), (None, 3, {"a": "n"}), (5, rows[5][1], rows[5][2])]
    own = {n: (p, s or {}) for n, p, s in rows if n is not None}

    def plain(n):
        seen, out = set(), {}
        while n in own and n not in seen:
            seen.add(n)
            out = own[n][1] | out if not out else {**own[n][1], **out}
            n = own[n][0]
        return out

    got = inherit.effective(spark.createDataFrame(rows, "node int, parent int, settings map<string,string>").repartition(5))
    assert {r.node: r.settings for r in got.collect()} == {n: plain(n) for n in own}
    assert inherit.effective(spark.createDataFrame([], "node int, parent int, settings map<string,string>")).count() == 0


def test_aliases_by_prefix(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randrange(n)))
    patterns = [(p, word(5), rng.choice([None, "", word(3)]), 0, rng.choice(["x/*", "y", "z/*/w"])) for p in range(200)]
    specifiers = sorted({word(9) for _ in range(300)})
    expected = {}
    for s in specifiers:
        for _, prefix, suffix, _, target in patterns:
            if suffix is None and s == prefix:
                expected[s] = (prefix, target)
            elif suffix is not None and s.startswith(prefix) and s.endswith(suffix) and len(s) >= len(prefix) + len(suffix):
                expected[s] = (prefix, target.replace("*", s[len(prefix) : len(s) - len(suffix)]))
            if s in expected:
                break
    aliases = spark.createDataFrame(patterns, "priority int, prefix string, suffix string, target_ord int, target string")
    found = resolve.expand_aliases(spark.createDataFrame([(s,) for s in specifiers], "specifier string"), aliases, ["specifier"])
    assert {r.specifier: (r.prefix, r.target) for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    per_project = resolve.expand_aliases(spark.createDataFrame([("p", "a/b"), ("q", "a/b"), ("r", "a/b")], "project_id string, specifier string"), spark.createDataFrame([("p", 0, "a/", "", 0, "m/*"), ("q", 0, "a/b", None, 0, "n"), ("q", 0, "a/b", None, 1, "o")], resolve.ALIASES), ["project_id", "specifier"])
    assert sorted((r.project_id, r.target_ord, r.target) for r in per_project.collect()) == [("p", 0, "m/b"), ("q", 0, "n"), ("q", 1, "o")]


def test_many_starts_through_a_hub_take_a_row_for_each_node(spark, monkeypatch):
    """300 starts that all see 300 nodes before the one marked: rows by nodes and edges, not by pairs."""
    rows = []
    monkeypatch.setattr(search, "cut_lineage", lambda df, f=search.cut_lineage: (lambda out: rows.append(out.count()) or out)(f(df)))
    edges = [(s, 1000, 0) for s in range(300)] + [(1000, 2000 + k, k) for k in range(300)] + [(2000 + k, 5000, 0) for k in (7, 9)]
    found = search.first_chain(spark.createDataFrame(edges, "src int, dst int, ord int"), spark.createDataFrame([(s,) for s in range(300)], "start int"), spark.createDataFrame([(5000,)], "node int"))
    assert {(r.hit, r.depth, tuple(r.chain[1:])) for r in found.collect()} == {(5000, 3, (1000, 2007, 5000))}
    assert sum(rows) < 6000
