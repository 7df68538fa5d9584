"""The class model against brute force: counts, classes, scores."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import class_ngram as c
from factgraph.llm import common

from .test_llm import ODD, WORD


def tokens_of(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    sides = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    made = [" ".join(rng.choice(sides[(i + k) % 2]) for k in range(rng.randrange(5, 80))) for i in range(300)]
    return made + [t if t is None else t.replace("　", " ") for t in ODD]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("word", F.lit(1))


@pytest.fixture(scope="module")
def training(texts):
    return {i: tokens_of(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10}


def x_log_x(a):
    return float((a * np.log(np.maximum(a, 1e-300))).sum())


def likelihood(table):
    return x_log_x(table) - x_log_x(table.sum(0)) - x_log_x(table.sum(1))


def kind(word):
    return 0 if re.search("[^\\x00-\\x7f]", word) else 2 if re.fullmatch("[a-z]+", word) else 1 if re.search("[0-9]", word) else 3


@pytest.mark.parametrize("most, seeds", [(1000, 1000), (1000, 7), (30, 7), (0, 0)])
def test_scores_by_brute_force(spark, docs, texts, training, most, seeds):
    counts = collections.Counter(w for own in training.values() for w in own)
    n, v = sum(counts.values()), len(counts)
    model = c.fit(docs, common.cut_lineage(c.word_counts(docs)), 12, most, seeds)
    assert len(model.counts) <= most and all(counts[w.decode()] == k for w, k in model.counts.items())
    assert min(model.counts.values(), default=0) >= max((k for w, k in counts.items() if w and w.encode() not in model.counts), default=0) or most == 0
    ids = {w.decode(): 1 + i for i, w in enumerate(model.counts)}
    of = lambda w: 0 if not w else int(model.classes[ids[w]]) if w in ids else 1 + kind(w)
    table, class_n, class_v = np.zeros((12, 12)), np.zeros(12), np.zeros(12)
    for own in training.values():
        for a, b in zip(["", *own], own):
            table[of(a), of(b)] += 1
    for w, k in counts.items():
        class_n[of(w)] += k
        class_v[of(w)] += 1
    share = (class_n + 0.1) / (n + 0.1 * 12)
    moves = (table + 2 * share) / (table.sum(1, keepdims=True) + 2)
    assert moves.sum(1) == pytest.approx(np.ones(12))
    found = c.score(docs, 12, most, seeds).collect()
    assert len(found) == len(texts)
    for r in found:
        own = tokens_of(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in training, len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-9)
        expected = sum(math.log10(moves[of(a), of(b)] * (counts[b] + 0.1) / (class_n[of(b)] + 0.1 * (class_v[of(b)] + 1))) for a, b in zip(["", *own], own))
        assert r.score == pytest.approx(expected, abs=1e-8) and r.perplexity == pytest.approx(10 ** (-expected / len(own)))


def test_classes_split_the_sides_and_lift_held_out_scores(docs):
    found = [r for r in c.score(docs, 8, 1000, 5).collect() if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)
    model = c.fit(docs, c.word_counts(docs), 8, 1000, 5)
    sides = {(w[:1], int(model.classes[1 + i])) for i, w in enumerate(model.counts) if re.fullmatch(b"[ab][0-9]+", w)}
    assert not {k for s, k in sides if s == b"a"} & {k for s, k in sides if s == b"b"}


def test_partitions_change_nothing(docs):
    one, two = (c.fit(d, c.word_counts(d), 9, 50, 8) for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(5)))
    assert (one.classes == two.classes).all() and one.counts == two.counts
    assert one.transitions == pytest.approx(two.transitions)


def test_best_class_is_the_likelihoods():
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 9, (40, 40)).astype(float)
    for placed in (True, False):
        of = rng.integers(0, 6, 40)
        for u in (0, 5, 17):
            rest = np.delete(np.arange(40), u)

            def table(k):
                member = np.zeros((40, 6))
                for w in range(40):
                    if w != u or k is not None:
                        member[w, k if w == u else of[w]] = 1
                return member.T @ pairs @ member

            scores = [likelihood(table(k)) for k in range(6)]
            mine = int(of[u]) if placed else -1
            out, into = np.bincount(of[rest], pairs[u, rest], 6), np.bincount(of[rest], pairs[rest, u], 6)
            if placed:
                out[mine] += pairs[u, u]
                into[mine] += pairs[u, u]
            new, rise = c.best_classes(table(mine if placed else None), out[None], into[None], pairs[u, u][None], np.array([mine]), 2)
            best = 2 + int(np.argmax(scores[2:]))
            if placed and mine >= 2 or not placed:
                assert new[0] == best
            if placed and mine >= 2:
                assert rise[0] == pytest.approx(scores[best] - scores[mine], abs=1e-6)


def test_exchange_ends_in_a_local_optimum():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 30, (20, 20)).astype(float)
    pairs[::2, ::2] *= 9

    def value(of):
        member = np.eye(5)[of]
        return likelihood(member.T @ pairs @ member)

    start, end = c.exchange(pairs, {0: 0}, 5, 0), c.exchange(pairs, {0: 0}, 5, 20)
    assert value(end) > value(start) and (end[1:] > 0).all()
    for u in range(1, 20):
        for k in range(1, 5):
            assert value(np.where(np.arange(20) == u, k, end)) <= value(end) + 1e-6


def test_vocabulary_has_a_bound(spark):
    counts = spark.createDataFrame([(w.encode(), n) for w, n in [("", 900), *((f"w{i}", 1 + i // 3) for i in range(90))]], "word binary, c long")
    for most in (0, 1, 4, 30, 90, 500):
        found = c.vocabulary(counts, most)
        assert len(found) <= most and list(found.values()) == sorted(found.values(), reverse=True) and b"" not in found
    assert len(c.vocabulary(counts, 90)) == 90


def test_empty_tables(spark, docs):
    assert c.score(docs.limit(0)).count() == 0
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    for r in c.score(held).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.score < 0
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (None, "")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in c.score(odd, 8).collect()) == [1, 1, 1, 3]


def test_vocabulary_is_exact(spark):
    """The most frequent words, ties by word: of words that each occur once, too, and of those with a long common beginning."""
    rows = [(w.encode(), k) for k, w in [(10**6 + i % 3, f"often{i}") for i in range(40)] + [(7, f"w{i:04d}") for i in range(300)] + [(1, f"the same beginning {i:05d}") for i in range(700)] + [(1, "")]]
    counts = spark.createDataFrame(rows, "word binary, c long")
    ranked = [w for w, _ in sorted(((w, k) for w, k in rows if w), key=lambda p: (-p[1], p[0]))]
    for most, held in ((0, 0), (1, 0), (39, 0), (40, 0), (41, 0), (200, 0), (340, 0), (341, 0), (700, 0), (1039, 0), (5000, 0), (20, 340), (20, 339), (350, 600)):
        found = list(c.vocabulary(counts, most, held))
        assert found[:most] == ranked[:most] and found == ranked[: len(found)] and len(found) <= max(most, held)
    assert len(c.vocabulary(counts, 20, 340)) == 340
    assert sum(df.count() for df in c._first(counts.where("c = 1"), 50)) <= 100
