"""Graphs in blocks: levels, ancestors and strong pieces however nodes are dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.operators import blocks, relops, walks
from tests.test_walks import dag, graph, plain_ancestors, plain_levels


def by_number(spark, pairs):
    return graph(spark, pairs).select(F.col("src").cast("long").alias("s"), F.col("dst").cast("long").alias("d"))


@pytest.mark.parametrize("edges_each", [120, 1 << 20], ids=["many blocks", "one block"])
def test_dense_graphs_in_blocks(spark, monkeypatch, edges_each):
    monkeypatch.setattr(blocks, "EDGES", edges_each)
    pairs = dag(150, 1200, 150, 5)
    names = random.Random(2).sample(range(151), 151)  # ways go to and fro between blocks
    for own in (pairs, [(names[a], names[b]) for a, b in pairs]):
        df = by_number(spark, own)
        first = df.select(F.col("s").alias("node")).union(df.select("d")).distinct().select("node", F.lit(0).alias("level"))
        named = {k: k for k in range(151)} if own is pairs else dict(enumerate(names))
        levels = {named[k]: v for k, v in plain_levels(pairs).items()}
        assert {r.node: r.level for r in blocks.levels(df, first, lambda: False).collect()} == levels
        sizes = spark.range(151).select("id", (F.col("id") % 3 + 1).alias("size"))
        ancestors = {k: {k} for k in range(151)}
        for _ in range(150):
            before = {k: len(v) for k, v in ancestors.items()}
            for a, b in own:
                ancestors[b] |= ancestors[a]
            if before == {k: len(v) for k, v in ancestors.items()}:
                break
        assert {r.node: r.total for r in blocks.weights_before(df, sizes).collect()} == {k: sum(x % 3 + 1 for x in v) for k, v in ancestors.items()}


def test_circles_within_and_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "EDGES", 60)
    monkeypatch.setattr(blocks, "ASKED", 2)
    for extra in ((5, 4), (119, 0)):
        with pytest.raises(ValueError):
            walks.topological_levels(graph(spark, sorted({*dag(120, 900, 120, 8), (4, 5), (0, 119), extra})))


def test_the_dense_way_is_taken(spark, monkeypatch):
    """Ancestors of a graph whose walks are too many, over circles, in blocks."""
    monkeypatch.setattr(blocks, "EDGES", 200)
    called = []
    monkeypatch.setattr(blocks, "weights_before", lambda *a, f=blocks.weights_before: called.append(1) or f(*a))
    pairs = [*dag(120, 1100, 120, 9), (40, 39), (39, 40)]
    assert {r.node: r.ancestors for r in walks.ancestor_counts(graph(spark, pairs)).collect()} == plain_ancestors(pairs)
    assert called


def _knots():
    """Three circles with chords, over more than a block each, the edges between them, and a chain: pairs, and own components."""
    pick = random.Random(7)
    pairs = {(c + k, c + (k + 1) % 40) for c in (0, 100, 200) for k in range(40)} | {(c + pick.randrange(40), c + pick.randrange(40)) for c in (0, 100, 200) for _ in range(250)}
    pairs = {(a, b) for a, b in pairs if a != b} | {(3, 110), (4, 110), (115, 210), (5, 210), (7, 150), (150, 151), (151, 152), (152, 205)}
    return sorted(pairs), {n: n - n % 100 if n % 100 < 40 else n for a, b in pairs for n in (a, b)}


def test_graphs_with_circles_are_dealt_and_contracted_once(spark, monkeypatch):
    """All edges are dealt to blocks once, levels aren't tried where a block has a circle, and only one contraction sees all edges."""
    pairs, own = _knots()
    dealt, seen = [], []
    monkeypatch.setattr(blocks, "EDGES", 400)
    monkeypatch.setattr(blocks, "dealt", lambda *a, f=blocks.dealt: dealt.append(1) or f(*a))
    for module in (relops, walks):
        if hasattr(module, "condensed"):
            monkeypatch.setattr(module, "condensed", lambda edges, *a, f=relops.condensed: seen.append(edges.count()) or f(edges, *a))
    df = graph(spark, pairs)
    assert {r.node: r.ancestors for r in walks.ancestor_counts(df).collect()} == plain_ancestors(pairs)
    assert len(dealt) == 1 and sum(n == len(pairs) for n in seen) == 1
    dealt.clear(), seen.clear()
    between = sorted({(own[a], own[b]) for a, b in pairs if own[a] != own[b]})
    assert {r.node: r.level for r in walks.component_levels(df).collect()} == plain_levels(between)
    assert len(dealt) == 1 and sum(n == len(pairs) for n in seen) == 1
    assert {r.node: r.component for r in relops.strong_components(df).collect()} == {a: c for a, c in own.items() if a % 100 < 40}


def test_loops_are_levels_of_their_own(spark):
    assert {r.node: r.level for r in walks.component_levels(graph(spark, [(1, 1), (2, 3), (3, 2), (3, 4), (4, 4)])).collect()} == {1: 0, 2: 0, 4: 1}


def test_pieces_are_strong():
    pick = random.Random(1)
    for n, m in ((6, 9), (40, 60), (60, 300)):
        s, d = (np.array([pick.randrange(n) for _ in range(m)]) for _ in range(2))
        reach = np.eye(n, dtype=bool)
        reach[s, d] = True
        for k in range(n):
            reach |= reach[:, [k]] & reach[[k]]
        piece = blocks.pieces(s, d, n)
        for k in np.flatnonzero(piece >= 0):
            assert (np.flatnonzero(reach[k] & reach[:, k]) == np.flatnonzero(piece == piece[k])).all() and piece[k] == np.flatnonzero(piece == piece[k])[0]
    assert (blocks.pieces(np.array([0, 1, 2]), np.array([1, 2, 0]), 4) == [0, 0, 0, -1]).all()


def test_closure_over_circles(spark, monkeypatch):
    """Pairs by components against a plain search; what is searched grows with components, not with their members."""
    pick = random.Random(3)
    pairs = [(k, (k + 1) % 60) for k in range(60)] + [(100 + k, 100 + (k + 1) % 40) for k in range(40)] + [(5, 100), (139, 200), (200, 201), (300, 5)]
    pairs += [(a, b) for a, b in ((pick.randrange(400, 440), pick.randrange(400, 440)) for _ in range(50))]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    expected = set()
    for start in {a for a, _ in pairs if a % 5 == 0}:
        seen, front = set(), after[start]
        while front:
            seen |= front
            front = {x for n in front for x in after.get(n, ())} - seen
        expected |= {(start, n) for n in seen}
    searched = []
    monkeypatch.setattr(relops, "reachable", lambda edges, starts, f=relops.reachable: searched.append(edges.count()) or f(edges, starts))
    df = graph(spark, pairs)
    found = [tuple(r) for r in relops.closure(df, df.where("src % 5 = 0").select(F.col("src").alias("start"))).collect()]
    assert sorted(found) == sorted(expected) and searched[0] < 60


def _brute_totals(pairs, n):
    before = [1 << k for k in range(n)]
    for a, b in sorted(pairs, key=lambda p: p[1]):  # edges lead to larger numbers
        before[b] |= before[a]
    return {k: sum(x % 3 + 1 for x in range(n) if v >> x & 1) for k, v in enumerate(before)}


def test_rounds_of_levels_move_arrays(spark, monkeypatch):
    """Each block's edges lead to all later ones: rounds move a row for a pair of blocks, not all edges again."""
    pairs, rows = dag(400, 3000, 400, 11), []
    monkeypatch.setattr(blocks, "EDGES", 100)
    df = by_number(spark, pairs)
    first = df.select(F.col("s").alias("node")).union(df.select("d")).distinct().select("node", F.lit(0).alias("level"))
    monkeypatch.setattr(blocks, "cut_lineage", lambda d, f=blocks.cut_lineage: [c := f(d), rows.append(c.count())][0])
    assert {r.node: r.level for r in blocks.levels(df, first, lambda: False).collect()} == plain_levels(pairs)
    assert sum(rows) < len(pairs) / 4


def test_stripes_of_nodes_and_pieces_of_edges(spark, monkeypatch):
    """One dense graph over many stripes: sums move, sets don't; stripes that all, some and none of are before a node."""
    monkeypatch.setattr(blocks, "EDGES", 100)
    for name, value in (("STRIPE", 0), ("PIECE", 300)):
        monkeypatch.setattr(blocks, name, value, raising=False)
    pairs, rows = [*dag(400, 4000, 400, 12), *((a + 420, b + 420) for a, b in dag(60, 90, 5, 13))], []
    sizes = spark.range(500).select("id", (F.col("id") % 3 + 1).alias("size"))
    monkeypatch.setattr(blocks, "cut_lineage", lambda d, f=blocks.cut_lineage: [c := f(d), rows.append(c.count())][0])
    assert {r.node: r.total for r in blocks.weights_before(by_number(spark, pairs), sizes).collect()} == _brute_totals(pairs, 500)
    assert max(rows) <= 500


def test_closure_lists_members_from_few_rows(spark, monkeypatch):
    """What meets in the last join is a row for a start and a list, not for each pair; a large component is more than one list."""
    monkeypatch.setattr(relops, "LISTED", 50, raising=False)
    pairs = [(k, (k + 1) % 200) for k in range(200)] + [(7, 300), (300, 301)]
    df = graph(spark, pairs)
    found = relops.closure(df, df.where("src % 2 = 0").select(F.col("src").alias("start")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join")[0].count("Generate explode") == 1  # pairs are made above all joins
    assert sorted(map(tuple, found.collect())) == sorted([(s, n) for s in range(0, 200, 2) for n in (*range(200), 300, 301)] + [(300, 301)])
