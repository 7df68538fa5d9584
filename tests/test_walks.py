"""Levels, ancestors and components over walks of doubling length."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factgraph.operators import relops, walks


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def plain_levels(pairs):
    into, nodes = defaultdict(set), sorted({x for p in pairs for x in p})
    for a, b in pairs:
        into[b].add(a)
    out = {}
    for n in nodes:  # edges lead to larger numbers
        out[n] = max((out[a] + 1 for a in into[n]), default=0)
    return out


def plain_ancestors(pairs):
    into, nodes, out = defaultdict(set), {x for p in pairs for x in p}, {}
    for a, b in pairs:
        into[b].add(a)
    for n in nodes:
        seen, front = set(), {n}
        while front:
            front = {a for x in front for a in into[x]} - seen
            seen |= front
        out[n] = len(seen - {n})
    return out


def dag(n, edges, reach, seed):
    rng = random.Random(seed)
    return sorted({(a, min(n, a + 1 + rng.randrange(reach))) for a in (rng.randrange(n) for _ in range(edges))} - {(n, n)})


@pytest.mark.parametrize("pairs", [dag(60, 400, 60, 1), dag(300, 350, 4, 2), [(i, i + 1) for i in range(40)], [(0, 1), (0, 1), (2, 3)]], ids=["dense", "thin", "chain", "tiny"])
def test_levels_and_ancestors_by_plain_search(spark, pairs):
    df = graph(spark, pairs)
    assert {r.node: r.level for r in walks.topological_levels(df).collect()} == plain_levels(pairs)
    assert {r.node: r.ancestors for r in walks.ancestor_counts(df).collect()} == plain_ancestors(pairs)


def test_ancestors_through_circles(spark):
    rng = random.Random(4)
    for n, m in ((30, 40), (40, 160)):
        pairs = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b]
        df = graph(spark, pairs)
        assert {r.node: r.ancestors for r in walks.ancestor_counts(df).collect()} == plain_ancestors(pairs)
        reach = {a: set() for p in pairs for a in p}
        for r in relops.reachable(df, df.select(F.col("src").alias("start"))).collect():
            reach[r.start].add(r.node)
        own = {a: min([a, *[b for b in reach[a] if a in reach[b]]]) for a in reach}
        assert {r.node: r.component for r in relops.strong_components(df).collect()} == {a: c for a, c in own.items() if sum(x == c for x in own.values()) > 1}


def test_circles_have_no_levels(spark):
    for pairs in ([(0, 1), (1, 0)], [(0, 0)], [(0, 1), (1, 2), (2, 3), (3, 1)], [*dag(40, 300, 40, 3), (39, 2)]):
        with pytest.raises(ValueError):
            walks.topological_levels(graph(spark, pairs))
    assert walks.topological_levels(graph(spark, [])).count() == 0 and walks.ancestor_counts(graph(spark, [])).count() == 0
    alone = spark.createDataFrame([(7,), (7,)], "node int")
    assert [tuple(r) for r in walks.topological_levels(graph(spark, []), nodes=alone).collect()] == [(7, 0)]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """100,000 nodes in 17 squares; sets of more than one bitmap."""
    made = []
    monkeypatch.setattr(relops, "_composed", lambda a, b, f=relops._composed: made.append(1) or f(a, b))
    n = 100_000
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    wrong = walks.topological_levels(chain).where("node <> level").count()
    assert wrong == 0 and len(made) < 25


def test_sets_of_several_bitmaps(spark):
    star = spark.range(40_000).select(F.col("id").alias("src"), F.lit(50_000).cast("long").alias("dst"))
    tail = spark.createDataFrame([(50_000, 50_001), (50_001, 50_000), (50_001, 50_002)], "src long, dst long")
    found = {r.node: r.ancestors for r in walks.ancestor_counts(star.union(tail)).where("node >= 50000 OR node < 2").collect()}
    assert found == {0: 0, 1: 0, 50_000: 40_001, 50_001: 40_001, 50_002: 40_002}
