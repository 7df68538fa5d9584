"""Base counts and the likelihood ratio against counts of the n-grams themselves."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import common
from factgraph.llm import quality_rules as q

from .test_llm import ODD, WORD, odd_docs


def n_grams(text):
    words = WORD.findall(text or "")
    return collections.Counter((w,) for w in words) + collections.Counter(zip(words, words[1:]))


def brute_ratio(text, target, raw, smoothing=0.1):
    """Mean log ratio with the n-grams as they are; ``target`` and ``raw`` are their counts."""
    own, t, r = n_grams(text), sum(target.values()), sum(raw.values())
    extra, total = smoothing * max(t, 1), 0.0
    for g, n in own.items():
        p = (raw[g] + 1) / (r + q.BUCKETS)
        total += n * math.log((target[g] + extra * p) / (t + extra) / p)
    return total / sum(own.values()) if own else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["the", "and", "tion", "ereth", "onin", "wh", "shand", "of"]
    prose = [" ".join(rng.choices(words, k=60)) + "." for _ in range(60)]
    return [*prose, *["#$ %% ^^ @@ " * 20 for _ in range(6)], *ODD, "a b c d e f g h a b c d e f g h", "x\nx\ny\n\n\nx"]


def test_base_counts_and_ratios(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))
    target = docs.where("doc_id < 50")
    ratio = q.Ratio.fit(target, docs)
    in_target = sum((n_grams(t) for t in texts[:50]), collections.Counter())
    in_raw = sum((n_grams(t) for t in texts), collections.Counter())
    hashes = {g: q.hashed([w.encode() for w in g])[-1] for g in in_raw}
    assert len(set(hashes.values())) == len(hashes)  # no clash in this fixture
    # the threshold: a passage's ratio without its own counts; a hundredth of 50 passages is none, so the lowest one's
    alone = [brute_ratio(t, in_target - n_grams(t), in_raw) for t in texts[:50]]
    assert ratio.threshold == pytest.approx(math.floor(min(alone) * 1000) / 1000)
    found = {r.doc_id: r for r in q.score(docs, ratio).collect()}
    for i, t in enumerate(texts):
        t, r = t or "", found[i]
        words = WORD.findall(t)
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = len({k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(words) < 20 or 100 * repeated > 30 * len(words)) and r.kept == (not r.base_failed and r.llr >= ratio.threshold)
        assert r.llr == pytest.approx(brute_ratio(t, in_target, in_raw), abs=1e-6)
    assert all(found[i].kept for i in range(50) if not found[i].base_failed) and not any(found[i].kept for i in range(60, 66))
    assert {r.doc_id for r in q.keep(docs, ratio).collect()} == {i for i, r in found.items() if r.kept}
    assert q.score(docs.limit(0), ratio).count() == 0


def test_quantile_of_the_threshold(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts[:60])), "doc_id long, text string")
    counts = sum((n_grams(t) for t in texts[:60]), collections.Counter())
    alone = sorted(math.floor(brute_ratio(t, counts - n_grams(t), counts) * 1000) for t in texts[:60])
    for quantile in (0, 0.1, 0.5, 1):
        threshold = q.Ratio.fit(docs, docs, quantile=quantile).threshold
        assert sum(a * q.GRID < threshold - 1e-9 for a in alone) <= quantile * 60
        above = [a for a in alone if a * q.GRID > threshold + 1e-9]
        assert not above or sum(a < above[0] for a in alone) > quantile * 60
    assert q.Ratio.fit(docs.limit(0), docs).threshold == -np.inf
    assert q.Ratio.fit(spark.createDataFrame([(None,), ("",)], "text string"), docs).threshold == -np.inf


def test_odd_rows_and_partitions(spark):
    odd = odd_docs(spark)
    one = q.Ratio.fit(odd, odd)
    two = q.Ratio.fit(odd.repartition(4), odd.orderBy(F.desc("n_chars")).repartition(3))
    assert (one.values == two.values).all() and one.threshold == two.threshold
    assert q.score(odd, one).count() == len(ODD) and q.keep(odd, one).columns == odd.columns


def test_labelled_documents(spark):
    """Of the labelled documents that pass the base rules, the good stay and most of the others go."""
    docs, labels, target = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels", "benchmark"))
    found = q.score(docs, q.Ratio.fit(target, docs)).where("NOT base_failed").join(labels, "doc_id")
    kept = {r.quality: r.kept for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.2
