"""The classifier's features and scores are functions of a text alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import quality_classifier as q

from .test_llm import ODD, odd_docs


def brute_features(text):
    """Passages of a text, byte by byte and word by word."""
    raw = text.encode()
    words, of, blank_before = [], [], True
    for b in raw:
        blank = b in b" \t\n\r\x0b\x0c"
        if not blank and blank_before:
            words.append([])
        if not blank:
            words[-1].append(b)
        blank_before = blank
        of.append(max(len(words) - 1, 0) // q.PASSAGE_WORDS)
    out = np.zeros((max(1, -(-len(words) // q.PASSAGE_WORDS)), q.FEATURES))
    for p in range(len(out)):
        own = [i for i, o in enumerate(of) if o == p]
        size = max(1, len(own))
        for i in own:
            out[p, q._KIND[raw[i]]] += 1 / size
            if i + 2 < len(raw):
                mixed = 0
                for k, factor in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
                    mixed ^= raw[i + k] * factor & 0xFFFFFFFF
                out[p, 10 + (mixed >> 26)] += 1 / size
        here = [bytes(w) for w in words[p * q.PASSAGE_WORDS : (p + 1) * q.PASSAGE_WORDS]]
        if here:
            out[p, -4:] = sum(a == b for a, b in zip(here, here[1:])) / len(here), len(set(here)) / len(here), size / len(here) / 8, np.log1p(len(here)) / 4
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "and", "THE", "12", "é字", "!!", "#", "x" * 90, "a|b"]
    made = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 63, 64, 65, 200]))) + rng.choice(["", " ", "\n\t", "  a"]) for _ in range(60)]
    return [t or "" for t in ODD] + ["  lead", "\n", *made, *made[:9]]


def random_model(texts):
    x, firsts = q.passages(texts)
    y = np.random.default_rng(0).integers(0, 2, len(texts)).astype(float)
    return q.Model.fit(x.astype(float), firsts, y, rounds=30)


def test_features_equal_brute_force(texts):
    x, firsts = q.passages(texts)
    for text, a, b in zip(texts, firsts, firsts[1:]):
        assert x[a:b] == pytest.approx(brute_features(text), abs=1e-5)


def test_stretches_give_the_same_features(texts, monkeypatch):
    for text in ["\n ".join(texts), "x" * 500, " " * 100, " a" * 300]:
        expected, firsts = q._step([text.encode()])
        for stretch in (3, 10, 64, 1000):
            monkeypatch.setattr(q, "STRETCH", stretch)
            x, found = q.passages([text])
            assert (x == expected).all() and (found == firsts).all()


def test_scores_depend_on_the_text_alone(texts):
    model = random_model(texts)
    together, order = model.score(texts), np.random.default_rng(1).permutation(len(texts))
    assert (model.score([texts[i] for i in order]) == together[order]).all()
    assert [model.score([t])[0] for t in texts] == together.tolist()


def test_scores_under_any_partitioning(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = random_model(texts)
    first = {tuple(r) for r in q.score(docs.coalesce(1), model).collect()}
    assert first == {tuple(r) for r in q.score(docs.orderBy(F.desc("text")).repartition(7), model).collect()}
    by_text = {}
    for r in first:
        assert by_text.setdefault(texts[r[0]], r[2]) == r[2]


def test_sample_of_repeated_and_missing_rows(spark):
    good = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words and more of them "), F.col("id").cast("string")).alias("text"))
    bad = spark.range(40, 80).select(F.col("id").alias("doc_id"), F.lit("#$%% |||| 99 !!!! ").alias("text"))
    docs = good.unionByName(bad)
    labels = docs.select("doc_id", (F.col("doc_id") < 40).cast("int").alias("quality"))
    model = q.fit(docs, labels)
    assert model.score(["plain words and more of them 5"])[0] > 0.7 > 0.3 > model.score(["#$%% |||| 99 !!!! "])[0]
    # repeated ids, in any order, labels of rows that are not there, null and too long texts
    odd = spark.createDataFrame([(3, "z"), (3, "y"), (200, None), (201, "x" * (q.SAMPLE_BYTES + 1)), (None, "n")], "doc_id long, text string")
    more = labels.unionByName(spark.createDataFrame([(i, 0) for i in (200, 201, 999, None)] + [(5, None)], "doc_id long, quality int"))
    one, two = q.fit(docs.unionByName(odd), more), q.fit(odd.repartition(3).unionByName(docs.orderBy(F.desc("doc_id"))), more)
    assert one.score([t or "" for t in ODD]).tolist() == two.score([t or "" for t in ODD]).tolist()
    # rows without a usable text take no place in the sample
    assert q.fit(docs.unionByName(odd), more, sample=80).score(["#$%% |||| 99 !!!! "])[0] < 0.3
    assert q.score(odd_docs(spark).limit(0), model).count() == 0
