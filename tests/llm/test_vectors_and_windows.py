"""Vector codes, vector clusters and repeated windows against plain versions, edge cases included."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import substring_dedup, vector_clusters, vector_codes, vectors

from .test_llm import ODD, odd_docs

VECTORS = "vec_id long, embedding array<double>, label int, q string, code string, before int, n long, dims int, cluster int, key string, part int"


def odd_vectors(spark, n=60, dims=16, seed=3):
    """Nulls in any column, non-finite components, repeated rows and ids, other lengths, and columns whose names clash."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-2, 2), rng.randrange(-3, 3) / 2]) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [rows[4]] * 3 + [(7, rows[9][1], 5), (None, rows[3][1], None), (None, rows[11][1], 2), (200, None, 1), (201, [None] * dims, 1), (202, [0.5] * (dims - 1) + [math.nan], 1), (203, [math.inf] + [0.5] * (dims - 1), 1), (204, [], 1), (205, [1.0] * (dims // 2), 1)]
    rng.shuffle(rows)
    return [(*r, "q", "c", 1, 2, 3, 4, "k", 5) for r in rows]


def whole(rows, scale, dims):
    fine = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(scale * x) for x in r[1]], r[2]) for r in fine]


def far(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y))


def rounds_of(points, centres, rounds):
    """Plain Lloyd rounds: (centres, index of each point)."""
    best = lambda x: min(range(len(centres)), key=lambda k: (far(x, centres[k]), k))
    for _ in range(rounds):
        found = [best(x) for x in points]
        groups = [[x for x, k in zip(points, found) if k == c] for c in range(len(centres))]
        centres = [[sum(column) // len(g) for column in zip(*g)] if g else c for g, c in zip(groups, centres)]
    return centres, [best(x) for x in points]


@pytest.mark.parametrize("entries,rounds", [(5, 4), (100, 2)])
def test_codes_by_plain_rounds(spark, entries, rounds):
    rows = odd_vectors(spark)
    kept = whole(rows, 64, 16)
    seeds = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], np.array(r[1], "<i4").tobytes()))[:entries]
    parts = [rounds_of([r[1][p * 4 : p * 4 + 4] for r in kept], [s[1][p * 4 : p * 4 + 4] for s in seeds], rounds) for p in range(4)]
    errors = [sum(far(r[1][p * 4 : p * 4 + 4], parts[p][0][parts[p][1][i]]) for p in range(4)) for i, r in enumerate(kept)]
    digest = hashlib.sha256(",".join(str(x) for centres, _ in parts for c in centres for x in c).encode()).hexdigest()
    of_label = {lab: sum(e for e, r in zip(errors, kept) if r[2] == lab) for lab in {r[2] for r in kept}}
    expected = [(r[0], "".join(f"{found[i]:02x}" for _, found in parts), errors[i], of_label[r[2]], digest) for i, r in enumerate(kept)]
    for partitions in (1, 7):
        own = vector_codes.codes(spark.createDataFrame(rows, VECTORS).repartition(partitions), 4, entries, rounds, 64)
        assert own.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, own.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("clusters", [6, 90])
def test_clusters_by_plain_rounds(spark, clusters):
    rows = odd_vectors(spark, seed=8)
    kept = whole(rows, 16, 16)
    named = sorted((hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes(), r[1]) for r in kept if r[0] is not None)
    centres, found = rounds_of([r[1] for r in kept], [x for _, _, x in named[:clusters]], 3)
    away = [far(r[1], centres[k]) for r, k in zip(kept, found)]
    inertia = [sum(d for d, k in zip(away, found) if k == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    expected = [(r[0], k, d, inertia[k], sum(inertia), digest[k]) for r, k, d in zip(kept, found, away)]
    own = vector_clusters.clusters(spark.createDataFrame(rows, VECTORS).repartition(5), clusters, 3, 16, 16)
    assert own.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, own.collect()), key=str) == sorted(expected, key=str)


def test_vectors_of_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    only_null = spark.createDataFrame([(None, [1.0] * 16, 1, "q", "c", 1, 2, 3, 4, "k", 5), (3, None, 1, "q", "c", 1, 2, 3, 4, "k", 5)], VECTORS)
    uneven = spark.createDataFrame([(1, [1.0] * 15, 1, "q", "c", 1, 2, 3, 4, "k", 5)], VECTORS)
    for df in (none, only_null, uneven):
        assert vector_codes.codes(df, 4).count() == 0 and vector_clusters.clusters(df, dims=16).count() == 0
    with pytest.raises(Exception, match="a component of"):
        vectors.quantised(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), 4).collect()


def test_differences_keep_the_sums(spark):
    """Only parts that change are sent, and sums over tasks are exact in two steps."""
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 2)], 0) for i in range(30)], "vec_id long, embedding array<double>, label int").repartition(4)
    state = vectors.quantised(rows, 1).select("vec_id", "label", "q", F.lit(None).cast("binary").alias("code"))
    once = vector_codes._assigned(state, [[[0], [1]], [[0], [1]]], 2)
    first = {(r["part"], r["entry"]): int(r["n"]) for r in vectors.summed(vector_codes._differences(once, 2, 1), ["part", "entry"], 900).collect()}
    assert sum(first.values()) == 60
    again = vector_codes._assigned(once, [[[0], [1]], [[0], [1]]], 2)
    assert vector_codes._differences(again, 2, 1).count() == 0
    moved = vector_codes._assigned(once, [[[0], [2]], [[0], [1]]], 2)  # of the first part, ones come nearer to nothing new: ties go down
    assert {(r["part"], r["entry"], int(r["n"])) for r in vector_codes._differences(moved, 2, 1).groupBy("part", "entry").agg(F.sum("n").alias("n")).collect()} == {(0, 0, 10), (0, 1, -10)}


# repeated windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    """(doc_id, n_words, n_removed, kept) by dictionaries."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    docs = sorted(set(rows), key=key)
    seen, out = set(), {}
    for r in docs:
        words = WORD.findall(r[1] or "")
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[r] = (r[0], len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return sorted((out[r] for r in rows), key=str)


@pytest.mark.parametrize("window,slots", [(1, 1 << 20), (3, 1 << 20), (20, substring_dedup.MOST_SLOTS)])
def test_windows_by_plain_search(spark, window, slots):
    rng = random.Random(window)
    base = [[rng.choice(["é", "b", "c", "Dd", "字"]) for _ in range(rng.randrange(60))] for _ in range(25)]
    rows = [(i, " ".join(w) if i % 3 else "\n\t".join([*w[:30], *w[5:40], *rng.choice(base)])) for i, w in enumerate(base * 2)]
    rows += [(None, rows[3][1]), (None, None), (77, ""), (78, " \t"), (79, rows[6][1]), (79, rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for partitions in (1, 9):
        own = substring_dedup.deduplicate(docs.repartition(partitions), window, slots)
        assert sorted(map(tuple, own.collect()), key=str) == plain(rows, window)


def test_windows_of_odd_documents(spark, monkeypatch):
    docs = odd_docs(spark)
    out = {r["doc_id"]: r for r in substring_dedup.deduplicate(docs.where("doc_id IS NOT NULL AND doc_id <> 9")).collect()}
    expected = {r[0]: r for r in plain([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in (None, 9)], 20)}
    assert {k: tuple(r) for k, r in out.items()} == expected and out[7]["n_removed"] == 2999 and out[0]["n_words"] == 0
    assert substring_dedup.deduplicate(docs).count() == len(ODD) and substring_dedup.deduplicate(docs.limit(0)).count() == 0
    # texts in pieces, and blocks in two steps, make no difference
    monkeypatch.setattr(substring_dedup, "STRETCH", 50)
    text = b" ".join(b"w%d" % (i % 90) for i in range(500)) + b"\x0b" + b"z" * 300 + b" end"
    assert b"".join(substring_dedup.pieces(text, 50)) == text
    monkeypatch.undo()
    bits, size = substring_dedup.sketch(substring_dedup._texts(docs.repartition(5)))
    monkeypatch.setattr(substring_dedup, "MERGED", 1)
    monkeypatch.setattr(substring_dedup, "COUNTED", 100)
    assert substring_dedup.sketch(substring_dedup._texts(docs.repartition(5))) == (bits, size)


def test_texts_of_one_id_follow_each_other(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long + " a"), (1, long + " b"), (2, long)]
    out = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in out) == [0, 30, 30] and [r["n_removed"] for r in out if r["doc_id"] == 2] == [30]


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, (2, 3000)).astype(np.uint64)
    hashes = np.concatenate([hashes, hashes[:, :700]], 1)
    size = 1 << 12
    own = substring_dedup.slots(hashes, size)
    counts = sum(np.bincount(np.where((own[k] != own[:k]).all(0), own[k], size), minlength=size + 1) for k in range(len(own)))[:size]
    bits = np.packbits(counts > 1, bitorder="little")
    may = substring_dedup._estimated(hashes, bits, size)
    assert may[:700].all() and may[3000:].all() and not may.all()
    marks = np.unique(rng.integers(0, 1 << 20, 500))
    assert (substring_dedup.unpacked(substring_dedup.packed(marks)) == marks).all() and substring_dedup.packed(marks[:0]) == b""
    assert substring_dedup.merged([np.array([4, 9]), np.array([4, 6])]).tolist() == [5, 6, 9]


def test_windows_in_stretches_and_words_by_their_spaces(monkeypatch):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 5, (2, 400)).astype(np.uint64)
    whole = substring_dedup.windows(words)
    monkeypatch.setattr(substring_dedup, "HASHED", 7)
    assert (substring_dedup.windows(words) == whole).all() and whole.shape == (2, 381)
    assert substring_dedup.windows(words[:, :19]).shape == (2, 0)
    texts = [b"", b" a\x0b\x0cb ", "é x\x1cy z 字\0".encode(), b"\t \n", b"a"]
    hashes, counts = substring_dedup.word_hashes(texts)
    assert counts.tolist() == [0, 2, 2, 0, 1] == [len(WORD.findall(t.decode())) for t in texts]
    assert (hashes[:, 0] == hashes[:, 4]).all() and len({tuple(h) for h in hashes.T.tolist()}) == 4
    # windows whose keys clash are told apart
    monkeypatch.setattr(substring_dedup, "_mixed", lambda x: x & np.uint64(1))
    of = np.sort(rng.integers(0, 3, 400))
    seen = set()
    expected = [(k := (o, *h)) not in seen and not seen.add(k) for o, h in zip(of.tolist(), words.T.tolist())]
    assert substring_dedup._first_inside(words, of).tolist() == expected
