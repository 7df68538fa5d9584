"""Literals by their rare grams against a nested loop."""

import random

from pyspark.sql import functions as F

from factgraph.operators import literals


def brute(texts, wanted):
    return sorted((i, w, t.index(w) + 1) for i, t in texts if t for w in set(wanted) if w and w in t)


def found(spark, texts, wanted):
    rows = spark.createDataFrame(texts, "id int, text string").withColumn("literal", F.lit("other"))
    out = literals.find(rows, spark.createDataFrame([(w,) for w in wanted], "literal string"), ["id"])
    return sorted((r.id, r.literal, r.position) for r in out.collect())


def test_every_length_and_place(spark):
    pick = random.Random(3)
    letters = "abcé 漢\n_-"
    texts = [(k, "".join(pick.choices(letters, k=pick.choice([0, 3, 40, 400])))) for k in range(120)]
    wanted = [t[a : a + pick.choice([1, 2, 4, 7, 8, 9, 14, 15, 16, 30, 400])] for _, t in texts if t for a in [pick.randrange(len(t))]]
    wanted += ["".join(pick.choices(letters, k=pick.randrange(1, 20))) for _ in range(60)] + ["", "not there at all", "é"]
    assert found(spark, texts, wanted + wanted[:5]) == brute(texts, wanted)


def test_nulls_repeats_and_empty_tables(spark):
    texts = [(1, "a secret_key_of_mine here"), (1, "secret_key_of_mine"), (2, None), (3, ""), (None, "secret_key_of_mine!")]
    own = found(spark, [t for t in texts if t[0]], ["secret_key_of_mine", None, ""])
    assert own == [(1, "secret_key_of_mine", 1), (1, "secret_key_of_mine", 3)]
    out = literals.find(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([("_of_",)], "literal string"), ["id"])
    assert sorted(((r.id is None), r.position) for r in out.collect()) == [(False, 11), (False, 13), (True, 11)]
    assert found(spark, texts[:2], []) == [] and found(spark, [], ["a"]) == []


def test_a_literal_that_all_texts_hold_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(literals, "HOT", 4)  # all frequent grams are dealt
    texts = [(k, f"{k} every text holds this line {k % 3}") for k in range(200)]
    wanted = ["every text holds this line", "line 1", "text holds", "7 every"]
    assert found(spark, texts, wanted) == brute(texts, wanted)
    long = "x" * (literals.BLOCK - 9) + "over the border" + "y" * 50
    assert found(spark, [(1, long)], ["over the border", "er the b", "the", "xxxxover the bord"]) == brute([(1, long)], ["over the border", "er the b", "the", "xxxxover the bord"])
    assert len(literals.grams(b"one text of some length for the index", literals.LEAST)) < 16


def test_small_and_large_tables_find_alike(spark, monkeypatch):
    """Tables that are sent to all tasks move no text; larger ones go by the index."""
    pick = random.Random(8)
    texts = [(k, "".join(pick.choices("abé 漢", k=pick.choice([0, 5, 90, 300])))) for k in range(60)]
    wanted = [t[a : a + pick.choice([1, 2, 3, 8, 9, 20, 300])] for _, t in texts if t for a in [pick.randrange(len(t))]] + ["ab", "é", "not there"]
    moved = []
    monkeypatch.setattr(literals, "cut_lineage", lambda df, f=literals.cut_lineage: moved.append(1) or f(df))
    assert found(spark, texts, wanted) == brute(texts, wanted) and not moved
    monkeypatch.setattr(literals, "BLOCK", 64)
    table = literals.Table([w.encode() for w in sorted(set(wanted))])
    assert sorted((i, sorted(set(wanted))[k], p) for i, t in texts for k, p in zip(*table.find(t.encode()))) == brute(texts, wanted)
    monkeypatch.undo()
    monkeypatch.setattr(literals, "HELD", 0)
    assert found(spark, texts, wanted) == brute(texts, wanted)
