"""Keyed state of findings: openings and resolutions against all periods at once."""

import datetime
import random

import numpy as np

from pyspark.sql import functions as F

from factgraph.streaming import lifetimes as L


def brute(seen):
    return sorted([(p, "opened") for p in seen if p - 1 not in seen] + [(p + 1, "resolved") for p in seen if p + 1 not in seen])


def test_periods_settle_alike_however_they_come():
    pick = random.Random(5)
    for _ in range(300):
        seen = {p for p in range(30) if pick.random() < pick.choice([0.1, 0.5, 0.9])}
        found, held, done = [], set(), 0
        while done < 32:
            until = min(32, done + pick.randrange(0, 7))
            held |= {p for p in seen if done <= p < until + 3}  # some come before their period is complete
            new, held = L.settle(held, done, until)
            found, done = found + new, until
        assert sorted(found) == brute(seen) and held == set()


def test_a_stream_that_is_stopped_between_its_parts(spark, tmp_path):
    at = lambda day, hour=1: datetime.datetime(2024, 1, day, hour)
    parts = [
        [("a", at(1)), ("a", at(2)), ("a", at(2)), ("b", at(1)), (None, at(1)), ("c", None)],
        [("a", at(5)), ("b", at(4)), ("b", at(5)), ("a", at(4, 22))],  # a resolved on the third, and again open
        [("b", at(1)), ("d", at(6))],  # the first comes too late and changes nothing
        [(None, at(20))],
    ]
    folder = str(tmp_path)
    for part in parts:
        spark.createDataFrame(part, "key string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("key string, at timestamp").parquet(f"{folder}/in")
        L.advance(L.lifetimes(stream, 86400, "1 hour"), f"{folder}/out", f"{folder}/checkpoint")
    first = datetime.date(2024, 1, 1).toordinal() - datetime.date(1970, 1, 1).toordinal() - 1
    rows = spark.read.parquet(f"{folder}/out").withColumn("day", F.col("period") - first).collect()
    seen = {"a": {1, 2, 4, 5}, "b": {1, 4, 5}, "d": {6}}
    assert sorted((r.key, r.day, r.change) for r in rows) == sorted((k, *c) for k, s in seen.items() for c in brute(s))
    assert spark.conf.get(L.STORE, None) is None or L.PROVIDER not in spark.conf.get(L.STORE)


def test_many_findings_settle_at_once_as_each_does():
    pick = random.Random(9)
    for _ in range(40):
        seen = {k: {p for p in range(20) if pick.random() < 0.4} for k in "abcdef"}
        done, until = sorted(pick.sample(range(22), 2))
        rows = [(k, p) for k, s in seen.items() for p in s for _ in range(pick.randrange(1, 3))]
        pick.shuffle(rows)
        found, kept = L.settle_all(np.array([k for k, _ in rows], object), np.array([p for _, p in rows], np.int64), done, until)
        alone = {k: L.settle(s, done, until) for k, s in seen.items()}
        assert sorted(found.itertuples(index=False, name=None)) == sorted((k, p, c) for k, (changes, _) in alone.items() for p, c in changes)
        assert set(kept.itertuples(index=False, name=None)) == {(k, p) for k, (_, left) in alone.items() for p in left}
