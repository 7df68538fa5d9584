"""Near-duplicates: repeated ids, hot groups, wide fingerprints."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import common, simhash, simhash_similarity as s

from .test_llm import brute_shingles, odd_docs


@pytest.mark.parametrize("module", [simhash, s])
def test_repeated_ids_lose_no_text(spark, module):
    """(1, A), (2, A), (2, B): A stays as 1 and B as 2, in whatever order rows come."""
    rows = [(1, "a text of some words that is here", "x"), (2, "a text of some words that is here", "y"), (2, "quite another text with other words in it", "z"), (None, "a text of some words that is here", "n")]
    for order in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]]):
        docs = spark.createDataFrame(order, "doc_id long, text string, version string").coalesce(1)
        assert sorted(module.deduplicate(docs).collect(), key=str) == sorted([spark.createDataFrame([rows[i]], docs.schema).first() for i in (0, 2, 3)], key=str)
    same = spark.createDataFrame([(5, "one two three", "b"), (5, "one two three", "a"), (5, "one two three", "b")], "doc_id long, text string, version string")
    assert module.deduplicate(same).collect() == module.deduplicate(same.orderBy("version")).collect() and module.deduplicate(same).count() == 1
    assert module.deduplicate(docs.limit(0)).count() == 0 and module.near_duplicates(docs.limit(0)).count() == 0
    odd = odd_docs(spark)
    kept = module.deduplicate(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 1


def test_hot_keys_meet_their_owners(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.range(1000).select(F.when(F.col("id") < 600, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    owners = rows.select("k").distinct().where("k <> 900").select("k", (F.col("k") * 2).alias("o"))
    out = common.join_owners(rows, owners, "k")
    assert out.count() == 1000 and out.where("o = 2 * k").count() == 999 and out.where("o IS NULL").count() == 1


def test_wide_fingerprint_by_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 255, 256, 700):
        hashes = np.unique(rng.integers(0, 1 << 63, n).astype("<u8"))
        sums = [0] * 320
        for h in hashes.tolist():
            for word in range(5):
                x = (h + (word + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
                for mixer in s._MIXERS.tolist():
                    x = ((x ^ x >> 33) * mixer) % (1 << 64)
                x ^= x >> 33
                for bit in range(64):
                    sums[word * 64 + bit] += x >> bit & 1
        prints, unsure = s.fingerprint(hashes)
        bits = np.unpackbits(prints.view(np.uint8), bitorder="little")
        assert bits.tolist() == [2 * c > len(hashes) for c in sums]
        places = unsure.view(np.uint8).reshape(10, 8)
        for block in range(10):
            margins = [(abs(2 * c - len(hashes)), i) for i, c in enumerate(sums[block * 32 : block * 32 + 32])]
            assert places[block].tolist() == [i for _, i in sorted(margins)[:8]]
        keys = s.variants(prints[None], unsure[None])[0]
        value = sum(int(b) << i for i, b in enumerate(bits[:32]))
        expected = {value ^ m for m in [0, *[1 << int(a) for a in places[0]], *[1 << int(a) | 1 << int(b) for a in places[0] for b in places[0] if a < b]]}
        assert set(keys[:37].tolist()) == expected and len(set(keys.tolist())) == 370


def test_recall_and_groups_of_near_copies(spark):
    """One large group of copies of a text, changed more or less, texts far from it, and pairs at the threshold."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]

    def changed(base, n):
        out = list(base)
        for at in rng.sample(range(len(base)), n):
            out[at] = rng.choice(words)
        return out

    centre = rng.choices(words, k=150)
    texts = [" ".join(changed(centre, rng.randrange(12))) for _ in range(150)]
    for _ in range(60):
        base = rng.choices(words, k=200)
        texts += [" ".join(base), " ".join(changed(base, 4))]
    sets = [brute_shingles(t) for t in texts]
    linked, roots = [], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                linked.append((i, j))
                roots = [min(roots[i], roots[j]) if r in (roots[i], roots[j]) else r for r in roots]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in s.near_duplicates(docs).collect()}
    assert len(linked) > 300 and sum(found[i] == found[j] for i, j in linked) >= 0.99 * len(linked)
    for i, c in found.items():  # and nothing else is linked
        assert roots[i] == roots[c]


def test_short_texts_lose_no_link(spark):
    """Each text and the same with one more word, where that makes a similarity of 0.8 or more: all are found."""
    rng = random.Random(11)
    rows, expected = [], {}
    for k in range(360):
        words = [f"w{rng.randrange(10**6)}" for _ in range(8 + k % 6)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
        expected |= {2 * k: 2 * k, 2 * k + 1: 2 * k}
    found = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lost = sum(r["component_id"] != expected[r["doc_id"]] for r in found)
    assert lost == 0
    hashes = np.arange(100, 112, dtype=np.uint64)
    assert [len(s.prefix(hashes[:n])) for n in (0, 1, 4, 5, 10, 12)] == [0, 1, 1, 2, 3, 3] and len(s.prefix(np.arange(13, dtype=np.uint64))) == 0


def test_tests_grow_with_the_group(spark, monkeypatch):
    """Texts of one template with some words changed, most of them just about similar: tests grow with their number."""
    tests, verified = [], s._verified
    monkeypatch.setattr(s, "_verified", lambda pairs, held: verified(common.cut_lineage(pairs.selectExpr("*")), held) if tests.append(pairs.count()) is None else None)
    monkeypatch.setattr(s, "MET", 100)
    sums = []
    for n in (300, 1200):
        rng = random.Random(3)
        template = [f"w{i}" for i in range(300)]
        texts = []
        for _ in range(n):
            out = list(template)
            for at in rng.sample(range(300), 4):
                out[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(out))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        del tests[:]
        groups = s.near_duplicates(docs).select("component_id").distinct().count()
        sums.append((sum(tests), groups))
    assert sums[1][0] < 6 * sums[0][0] and [groups for _, groups in sums] == [1, 1]


def test_components_take_few_rounds_and_nothing_is_sent_by_the_driver(spark, monkeypatch):
    """Stars take no round and a chain of three edges one or two; small sides meet by shuffle."""
    from factgraph.llm import components as c

    plans = []
    monkeypatch.setattr(c, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), common.cut_lineage(df))[1])
    stars = spark.createDataFrame([(5, 1), (6, 1), (1, 7), (8, 2), (2, 2), (None, 2)], "a long, b long")
    assert {(r.node, r.root) for r in c.components(stars).collect()} == {(1, 1), (5, 1), (6, 1), (7, 1), (2, 2), (8, 2)} and len(plans) == 1
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {(r.node, r.root) for r in c.components(chain).collect()} == {(i, 1) for i in range(1, 5)} and 2 <= len(plans) - 1 <= 3
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
