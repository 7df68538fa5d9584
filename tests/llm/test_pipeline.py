"""The pipeline's stages against plain versions of each, on the smallest tables."""

import collections
import math
import zlib

import duckdb
import numpy as np


from factgraph.llm import bpe, common, pii_oracle, quality_classifier

from .test_llm import WORD, brute_shingles
from .test_quality_classifier import brute_features
from .test_quality_rules import brute_ratio, n_grams


def accepted(model, text):
    x = brute_features(text).astype(np.float32)
    return round(float(model.attention(x, np.array([0, len(x)]))[0][0]), 6) >= quality_classifier.ACCEPTED


def passes(text, in_target, in_raw, threshold):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    repeated = len({k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)})
    return len(words) >= 20 and 100 * repeated <= 30 * len(words) and round(brute_ratio(text, in_target, in_raw), 9) >= threshold


def first_of_groups(texts):
    """The smallest id of each component of texts of similarity 0.8."""
    ids = sorted(texts)
    sets, root = {i: brute_shingles(texts[i]) for i in ids}, {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
    return set(root.values())


def test_stages_equal_plain_versions(spark, sf_dir):
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality_classifier.fit(docs, labels)
    texts = {i: t for i, t in texts.items() if accepted(model, t)}
    one = common.cut_lineage(p.classify_quality(spark, docs, sf_dir))
    assert {r.doc_id for r in one.collect()} == set(texts)

    passages = [r.text for r in common.table(spark, sf_dir, "benchmark").collect()]
    in_target, in_raw = (sum(map(n_grams, each), collections.Counter()) for each in (passages, texts.values()))
    alone = sorted(math.floor(brute_ratio(t, in_target - n_grams(t), in_raw) * 1000) for t in passages)
    threshold = alone[math.floor(0.01 * len(alone))] * 0.001
    # buckets that two n-grams share move a ratio a little, so texts within a hair of the threshold may go either way
    near = {i for i, t in texts.items() if abs(brute_ratio(t, in_target, in_raw) - threshold) < 0.02}
    texts = {i: t for i, t in texts.items() if passes(t, in_target, in_raw, threshold) or i in near}
    two = common.cut_lineage(p.apply_quality_rules(spark, one, sf_dir))
    kept = {r.doc_id for r in two.collect()}
    assert kept <= set(texts) and set(texts) - kept <= near and len(kept) > 100
    texts = {i: t for i, t in texts.items() if i in kept}

    texts = {i: texts[i] for i in first_of_groups(texts)}
    three = common.cut_lineage(p.drop_near_duplicates(spark, two, sf_dir))
    assert {r.doc_id for r in three.collect()} == set(texts)

    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
    texts = {i: t for i, t, _ in con.sql(pii_oracle.sql()).fetchall()}
    four = common.cut_lineage(p.pseudonymise(spark, three, sf_dir))
    assert {r.doc_id: r.text or "" for r in four.collect()} == texts

    library = Tokenizer.from_file(public_tokenizers.path(bpe.JSON_VOCABULARY))
    ids = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    held = collections.Counter()
    for r in p.run(spark, sf_dir).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        held[r.doc_id] += r.length
    assert held == {i: len(x) for i, x in ids.items()}
