"""Bucketed tables, digest trees and Bloom filters."""

import glob

import pytest
from pyspark.sql import functions as F

from factgraph.operators import bloom, buckets, merkle, relops


def rows_of(df):
    return sorted((r.k, r.v) for r in df.collect()) if df is not None else None


def table(spark, pairs):
    return spark.createDataFrame(pairs, "k int, v string")


def test_a_save_writes_the_buckets_that_change(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert buckets.load(spark, folder) is None
    first = {k: f"v{k}" for k in range(200)}
    buckets.save(table(spark, list(first.items())), folder, ["k"], buckets=16)
    assert rows_of(buckets.load(spark, folder)) == sorted(first.items())
    before = {p for p in glob.glob(f"{folder}/version=1/bucket=*")}
    assert buckets.save(table(spark, []), folder, ["k"]) == []
    touched = buckets.save(table(spark, [(7, "new")]), folder, ["k"])
    assert len(touched) == 1 and len(glob.glob(f"{folder}/version=2/bucket=*")) == 1 and len(before) > 10
    assert rows_of(buckets.load(spark, folder)) == sorted((first | {7: "new"}).items())
    buckets.save(table(spark, [(300, "x")]), folder, ["k"], gone=table(spark, [(5, ""), (999, "")]))
    assert rows_of(buckets.load(spark, folder)) == sorted({k: v for k, v in (first | {7: "new", 300: "x"}).items() if k != 5}.items())
    buckets.save(table(spark, [(1, "only")]), folder, ["k"], whole=True)
    assert rows_of(buckets.load(spark, folder)) == [(1, "only")]
    buckets.save(table(spark, [(2, "two")]), folder, ["k"])
    assert not glob.glob(f"{folder}/version=1") and len(glob.glob(f"{folder}/manifest-*.json")) == 2


def test_a_save_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    buckets.save(table(spark, [(1, "a"), (2, "b")]), folder, ["k"])
    with monkeypatch.context() as m:
        m.setattr(buckets, "_swap", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            buckets.save(table(spark, [(1, "wrong")]), folder, ["k"])
    assert rows_of(buckets.load(spark, folder)) == [(1, "a"), (2, "b")]
    bad = table(spark, [(1, "x")]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        buckets.save(bad, folder, ["k"])
    assert rows_of(buckets.load(spark, folder)) == [(1, "a"), (2, "b")]
    buckets.save(table(spark, [(1, "right")]), folder, ["k"])
    assert rows_of(buckets.load(spark, folder)) == [(1, "right"), (2, "b")]


def test_trees_lead_to_the_changes_only(spark):
    old = table(spark, [(k, None if k == 4 else f"v{k}") for k in range(3000)])
    new = old.where("k NOT IN (17, 18)").withColumn("v", F.when(F.col("k") == 40, "other").otherwise(F.col("v"))).union(table(spark, [(5000, None)]))
    found = merkle.changes(old, new, ["k"], ["v"])
    assert {(r.k, r.change) for r in found.collect()} == {(17, "removed"), (18, "removed"), (40, "changed"), (5000, "added")}
    trees = [merkle.tree(merkle.digested(x, ["k"], ["v"])) for x in (old, new)]
    leaves = merkle.differing(*trees)
    assert 1 <= leaves.count() <= 4  # of some 3,000
    assert merkle.differing(trees[0], trees[0]).count() == 0 and merkle.changes(old, old.limit(0), ["k"], ["v"]).count() == 3000
    assert [r.n for r in trees[0].where("level = 0").collect()] == [3000]


def test_filters_exclude_no_target(spark):
    targets = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("k"))
    every = spark.range(4000).select(F.col("id").cast("string").alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    marked = bloom.likely(every, ["k"], bloom.build(targets.union(spark.createDataFrame([(None,)], "k string")), ["k"]))
    assert marked.where("likely AND k % 2 = 0").count() == 2000 and marked.where("likely").count() < 2100 and marked.count() == 4001
    full = bloom.likely(every, ["k"], bloom.build(targets, ["k"], most=1))
    assert full.where("likely AND k % 2 = 0").count() == 2000
    for f in (bloom.difference, relops.difference):
        assert f(every, targets, ["k"]).where("k IS NOT NULL").count() == 2000 and f(every, targets.limit(0), ["k"]).count() == 4001
