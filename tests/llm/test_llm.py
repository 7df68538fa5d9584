"""Each operator against a brute-force version on small fixtures, edge cases included."""

import base64
import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factgraph.llm import avi, bpe, chat, class_ngram, common, jpeg, packing, pii, pii_oracle, quality_classifier, quality_rules, queries, simhash, simhash_similarity, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "The  quick\tbrown fox's 'll <|endoftext|>x", "é字😀   x　", "word " * 3000, "x" * 5000, "same text here", "same text here", "#$%& | <>", "UPPER lower 123"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out boolean, word string, fp long, row long, a long, b long, u long, v long, ids string, media string"


def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns whose names clash."""
    rows = [(None if i == 8 else i if i != 10 else 9, t, None, "s", None, True, "w", 1, 2, 3, 4, 5, 6, "i", "m") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabet = [*"ab'slrevetmdLL  \n\t\r .,!?'''12½²é字😀ñ́ ​", "'ll", "'re", "  ", "\n\n", "'s", " '", "<|endoftext|>", " the", "tion"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(n)] + ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(n // 3)]


@pytest.fixture(scope="module")
def rank_library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANK_VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def json_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(bpe.JSON_VOCABULARY))


# byte-level BPE


def test_both_libraries_have_the_same_classes():
    assert (bpe.rank_library_classes() == bpe.json_library_classes()).all()


def test_encoder_equals_both_libraries(rank_library, json_library):
    texts = random_texts(1500, 1) + [t or "" for t in ODD] + ["a" * 3000, " " * 3000 + "x", "ab" * 200 + "'ll" * 50]
    own = bpe.Encoder(bpe.Vocabulary.ranked(common.tokenizer_path(bpe.RANK_VOCABULARY)))
    assert list(own.encode(texts)) == [rank_library.encode_ordinary(t) for t in texts]
    own = bpe.Encoder(bpe.Vocabulary.from_json(common.tokenizer_path(bpe.JSON_VOCABULARY)), cached=50)
    assert list(own.encode(texts)) == [e.ids for e in json_library.encode_batch_fast(texts, add_special_tokens=False)]


def test_stretches_change_nothing(rank_library):
    text = " ".join(random_texts(200, 2))
    assert "".join(bpe.stretches(text, 50)) == text
    assert [i for part in bpe.stretches(text, 50) for i in rank_library.encode_ordinary(part)] == rank_library.encode_ordinary(text)


def test_encode_and_decode_columns(spark, rank_library):
    found = bpe.decode(bpe.encode(odd_docs(spark)), ids="ids_").collect()
    assert collections.Counter(r["text"] for r in found) == collections.Counter(ODD)
    for r in found:
        raw = (r["text"] or "").encode()
        assert r["ids_"] == rank_library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == raw
        assert (r["token_ends"] or [0])[-1] == len(raw)


def test_digests(spark, rank_library):
    for r in bpe.digests(odd_docs(spark).where("doc_id IS NOT NULL")).collect():
        text = ODD[r.doc_id] or ""
        ids = rank_library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(odd_docs(spark).limit(0)).count() == 0


# token counts


def test_every_prefix(spark, json_library):
    own = token_counts.PrefixCounter(bpe.Vocabulary.from_json(common.tokenizer_path(bpe.JSON_VOCABULARY)), cached=100)
    texts = random_texts(300, 3)
    for text in texts:
        expected = [len(e.ids) for e in json_library.encode_batch_fast([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
        assert own.prefixes(text).tolist() == expected, text
    for budget in (0, 2, 9):
        for text, (total, fits) in zip(texts, own.totals(texts, budget)):
            counts = own.prefixes(text)
            assert total == counts[-1] and fits == np.flatnonzero(counts <= budget)[-1]


def test_totals_and_stored_counts(spark, json_library):
    docs = odd_docs(spark)
    found = token_counts.totals(docs).collect()
    assert len(found) == len(ODD)
    for r in found:
        if r.doc_id is not None:
            text = ODD[r.doc_id] or ""
            n = len(json_library.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    stored = token_counts.prefix_counts(docs.where("length(text) < 100"))
    for r in stored.select("text", token_counts.tokens_of_prefix(F.col("prefix_tokens"), 3).alias("n"), token_counts.characters_within(F.col("prefix_tokens"), 2).alias("c")).collect():
        counts = [len(e.ids) for e in json_library.encode_batch_fast([r.text[:i] for i in range(len(r.text) + 1)], add_special_tokens=False)]
        assert r.n == counts[min(3, len(r.text))] and r.c == max(i for i, c in enumerate(counts) if c <= 2)


# packing


@pytest.mark.parametrize("window", [64, 1 << 20])
def test_packing(spark, json_library, window):
    found = packing.pack(odd_docs(spark).where("doc_id IS NOT NULL AND doc_id <> 9"), size=128, window=window).collect()
    ids = {i: json_library.encode_batch_fast([t or ""], add_special_tokens=False)[0].ids + [1] for i, t in enumerate(ODD) if i not in (8, 9, 10)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    for i, own in pieces.items():
        assert sum(n for _, n in own) == len(ids[i]) and sorted(own)[0][0] == 0
    assert set(pieces) == set(ids)
    for own in sequences.values():
        at = 0
        for offset, n, room in sorted(own):
            assert offset == at
            at += n
        assert at == room and (room == 128 or room & (room - 1) == 0)


def test_packing_goes_to_the_lowest_cost():
    """The dealt rule, room by room."""
    rng = random.Random(5)
    for lengths in ([rng.randrange(1, 2048) for _ in range(400)], [2047] * 30, [5, 5, 5, 5], [1], [1500, 1500, 1500, 300]):
        rooms = packing.rooms_for(sum(lengths), 2048)
        room, spent, used, expected = list(rooms), [0.0] * len(rooms), [0] * len(rooms), []

        def put(piece, begin, n, at):
            expected.append((piece, begin, n, at, used[at]))
            used[at] += n
            room[at] -= n
            spent[at] += packing.cost(n)

        rest = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            able = [k for k in range(len(rooms)) if room[k] >= lengths[i]]
            if able:
                put(i, 0, lengths[i], min(able, key=lambda k: spent[k]))
            else:
                rest.append(i)
        for i in rest:
            begin = 0
            while begin < lengths[i]:
                at = min((k for k in range(len(rooms)) if room[k]), key=lambda k: spent[k])
                n = min(lengths[i] - begin, room[at])
                put(i, begin, n, at)
                begin += n
        assert packing.assign(lengths) == expected and sum(rooms) == sum(lengths) and not any(room)


def test_packing_of_odd_rows(spark, json_library):
    found = packing.pack(odd_docs(spark), size=256).collect()
    assert packing.pack(odd_docs(spark).limit(0)).count() == 0
    expected = collections.Counter(len(json_library.encode_batch_fast([t or ""], add_special_tokens=False)[0].ids) + 1 for t in ODD)
    whole = collections.Counter(r.doc_tokens for r in found if r.start == 0)
    assert whole == expected and sum(r.length for r in found) == sum(n * k for n, k in expected.items())
    assert {r.doc_id for r in found} == {None, *(i for i in range(len(ODD)) if i not in (8, 10))}


def test_special_tokens_come_from_the_vocabulary(tmp_path, monkeypatch):
    assert packing.special_tokens(bpe.JSON_VOCABULARY, bpe.RANK_VOCABULARY) == {"<|endoftext|>": 50256}
    with pytest.raises(ValueError, match="other tokens"):
        packing.special_tokens(bpe.JSON_VOCABULARY, "byte_bpe_multi_50k.tiktoken")


def test_very_long_texts_with_special_tokens(json_library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 60)
    texts = [" ".join(random_texts(40, s)) + "<|endoftext|>" * (s % 3) + " tail <|endo" * 20 for s in range(4)]
    coder = bpe.Encoder(bpe.Vocabulary.from_json(common.tokenizer_path(bpe.JSON_VOCABULARY)))
    expected = [e.ids for e in json_library.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(bpe.encode_texts(coder, texts)) == expected
    known = token_counts.PrefixCounter(bpe.Vocabulary.from_json(common.tokenizer_path(bpe.JSON_VOCABULARY)))
    for limit in (1, 7, 100, 10_000):
        for text, ids in zip(texts, expected):
            total, cut = token_counts._long_totals(known, text, limit)
            assert total == len(ids) and (total, cut) == next(known.totals([text], limit))


def test_caches_hold_few_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    vocabulary = bpe.Vocabulary.from_json(common.tokenizer_path(bpe.JSON_VOCABULARY))
    coder, known = bpe.Encoder(vocabulary), token_counts.PrefixCounter(vocabulary)
    for i in range(30):
        texts = ["".join(random.Random(i * 50 + k).choices("abcdefgh", k=40)) for k in range(50)] + [f"{i}" + "x" * 3000 + "y" * i]
        list(bpe.encode_texts(coder, texts))
        known.trim()
        list(known.totals(texts, 5))
    coder.trim()
    known.trim()
    for cache in (coder.cache, coder.older, known.tables, known.older):
        assert sum(map(len, cache)) <= 5000 + 50 * 40 + 300 and max(map(len, cache)) <= bpe.LONG_PIECE


# near-duplicates


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids, root = sorted(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(12)]
    texts = [*base, *[t.replace("w1 ", "w2 ", 1) for t in base], *[t + " tail" for t in base], "", " ", None, "one", "two words", *base[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    expected = brute_components(prints)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in found.items()} == expected
    kept = simhash.deduplicate(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.deduplicate(odd_docs(spark)).where("doc_id IS NULL").count() == 1


def brute_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_drops_shingle_near_duplicates(spark, sf_dir):
    """Copies with changed words at similarities on both sides of 0.8; links through a third text count."""
    import corpus_pipeline as p

    rng = random.Random(11)
    words, texts = [f"w{i}" for i in range(5000)], []
    for _ in range(12):
        base = rng.choices(words, k=300)
        texts.append(" ".join(base))
        for n in (1, 3, 6, 8, 12, 20):
            for at in rng.sample(range(300), n):
                base = [*base[:at], rng.choice(words), *base[at + 1 :]]
            texts.append(" ".join(base))
    rng.shuffle(texts)
    texts += ["", None, "one", "One", "a b c d e f"]
    sets, root = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 24 < len(set(root)) < len(texts) - 12
    assert {r.doc_id: r.component_id for r in simhash_similarity.near_duplicates(docs).collect()} == dict(enumerate(root))
    assert {r.doc_id for r in p.drop_near_duplicates(spark, docs, sf_dir).collect()} == set(root)


def test_components_of_a_long_chain(spark):
    from factgraph.llm.components import components

    order = random.Random(1).sample(range(200), 200)
    edges = spark.createDataFrame([*zip(order, order[1:]), (500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


# pseudonyms

PRIVATE = ["card 4111 1111 1111 1111 x", "4111111111111111.", "ip 192.168.1.10,", "ssn 123-45-6789", "+1 (743) 555-3824 é", "(743) 555-3824", "+44 20 7946 0958", "on 2023-02-28 and 31.12.1999 or 12/31/1999", "GB82 WEST 1234 5698 7654 32", "mail bosbt.42@mail8.example.com", "4111111111111111 64.12.9.1"]
CLEAN = ["4111111111111112", "999.1.1.1", "000-12-3456 666-12-3456", "2023-02-29 1850-01-01", "GB82WEST12345698765433", "version 1.2.3", "12345", "no digits at all"]


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def test_pseudonyms(spark):
    texts = [*PRIVATE, *CLEAN, None, ""]
    docs = spark.createDataFrame([(i, t, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, old string, __matches string")
    rows = {r.old: r for r in pii.pseudonymise(docs, "k", found="n").collect()}
    for t in [*CLEAN, None, ""]:
        assert rows[t].text == t and rows[t].n == 0
    for t in PRIVATE:
        new = rows[t].text
        assert rows[t].n >= 1 and new != t
        # same shape, but for numbers of addresses and leading zeros of days
        if "." not in t and "/" not in t:
            assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", t)
    card = re.search("[0-9]{16}", rows["4111111111111111."].text)[0]
    assert luhn(card) and re.sub("[^0-9]", "", rows[PRIVATE[0]].text) == card and rows[PRIVATE[-1]].text.startswith(card)
    assert rows["(743) 555-3824"].text[-14:] in rows["+1 (743) 555-3824 é"].text
    iban = re.sub(" ", "", rows["GB82 WEST 1234 5698 7654 32"].text)
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.pseudonymise(docs, "k").columns == docs.columns and pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_ibans_end_where_they_do(spark):
    """Words and numbers after an IBAN, and labels before a card, take nothing from it."""
    ibans = ["ES91 2100 0418 4502 0005 1332 BIC", "BE68 5390 0754 7034 EUR 50", "ES9121000418450200051332 OK", "NO93 8601 1117 947 A1"]
    cards = ["ID12 4111 1111 1111 1111", "DE12 4111 1111 1111 1111", "GB12 4111 1111 1111 1111 AB"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ibans, *cards])], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k", found="n").collect()}
    for i, t in enumerate([*ibans, *cards]):
        new = rows[i].text
        assert rows[i].n == 1 and new != t and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", t)
        if t in cards:
            assert new[:4] == t[:4] and luhn(re.sub("[^0-9]", "", new[4:]))


def test_pseudonyms_equal_the_oracle(spark):
    import duckdb

    texts = [*PRIVATE, *CLEAN, "", "x@y.zz AbC-9@d.ef.gh", "DE89370400440532013000 4111-1111-1111-1111", "1/2/2003 1999/12/31 (743)555-3824 743-555-3824", "13/02/2020 31/12/1999 2/3/2020 12.1.2020 30/30/2020", "415 555 2671 020 7946 0958 100 200 3000", "ES91 2100 0418 4502 0005 1332 BIC, BE68 5390 0754 7034 EUR 50"]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    own = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pii.DEMONSTRATION_KEY, found="n_found").select("doc_id", "text", "n_found")
    assert sorted(map(tuple, own.collect())) == sorted(con.sql(pii_oracle.sql()).fetchall())


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(319 * 229).select(F.floor(F.col("id") / 229).alias("l"), (F.col("id") % 229).alias("r"))
    l, r = pii.feistel(F.col("l"), F.col("r"), F.lit(319), F.lit(229), "k", "t")
    out = pairs.select(l.alias("l"), r.alias("r"))
    assert out.distinct().count() == 319 * 229 and out.where("l >= 319 OR r >= 229 OR l < 0 OR r < 0").count() == 0
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select(pii.permute_digits(F.col("d"), "k", "t").alias("p"))
    assert digits.distinct().count() == 1000 and digits.where("length(p) <> 3").count() == 0


# quality


def test_classifier(spark, sf_dir):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    model = quality_classifier.fit(docs, labels)
    found = {r.doc_id: r for r in quality_classifier.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(found[i].predicted, q) for i, q in truth.items() if found[i].held_out]
    assert sum(p == q for p, q in tested) >= 0.95 * len(tested)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in found.items())
    odd = odd_docs(spark)
    assert quality_classifier.score(odd, model).where("score BETWEEN 0 AND 1").count() == len(ODD)
    kept = quality_classifier.keep(odd, model)
    assert kept.columns == odd.columns
    assert quality_classifier.fit(odd.limit(0), labels.limit(0)).score(["x"])[0] == 0.9


def test_classifier_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 1, (rng.integers(1, 6), quality_classifier.FEATURES)) for _ in range(80)]
    y = np.array([float(b[:, 0].max() > 1) for b in bags])
    firsts = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    model = quality_classifier.Model.fit(np.concatenate(bags), firsts, y)
    scores, attention = model.attention(np.concatenate(bags), firsts)
    assert ((scores > 0.5) == y).mean() > 0.9 and np.add.reduceat(attention, firsts[:-1]) == pytest.approx(np.ones(80))


# chat


def test_common_prefix_and_masks(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a = [turn("user", "hi"), turn("assistant", "yes"), turn("user", None), turn("assistant", "ééé")]
    pairs = [(1, a, a[:3] + [turn("assistant", "no")]), (2, a, a), (3, a, []), (4, None, a), (5, [turn(None, "x")], [turn("user", "x")])]
    rows = {r.id: r for r in chat.format_preferences(spark.createDataFrame(pairs, "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("prompt", F.lit("taken"))).collect()}
    assert [rows[i].prompt_turns for i in range(1, 6)] == [3, 4, 0, 0, 0]
    r = rows[1]
    assert r.prompt == "taken" and r.prompt_.startswith("<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n") and r.chosen == "<|assistant|>\nééé<|end|>\n"
    begin, end = map(int, r.chosen_spans.split("-"))
    assert r.chosen[begin:end] == "ééé<|end|>" and rows[2].chosen == "" == rows[2].chosen_spans and rows[3].rejected == ""


def test_chat_oracle(spark, sf_dir):
    """The SQL compares turns; conversations that go on alike part later than halfway, or not at all."""
    import duckdb

    same = [(c, t, r, x) for c in (8000, 8001, 8002) for t, (r, x) in enumerate([("user", "q"), ("assistant", "a"), ("user", "more"), ("assistant", f"end {c // 8002}"), ("user", None), (None, "z")])]
    odd = [*same, (8004, 0, "user", "alone"), (8006, 0, None, None), (8007, 0, "user", "x"), (8007, 0, "assistant", "tie"), (8007, 0, "assistant", "tie"), *((None, i, "user", "no id") for i in range(3))]
    rows = common.table(spark, sf_dir, "conversations").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.register("conversations", rows.toArrow())
    own = chat.format_preferences(chat.crossed_pairs(rows))
    found = {r.conv_id: r for r in own.collect()}
    assert sorted(map(tuple, found.values())) == sorted(con.sql(f"SELECT {', '.join(own.columns)} FROM ({chat.ORACLE})").fetchall())
    assert [found[c].prompt_turns for c in (8000, 8001, 8002, 8004, 8006)] == [6, 3, 3, 0, 0] and None not in found
    assert chat.crossed_pairs(rows.limit(0)).count() == 0


# media


def test_payload_round_trip():
    rng = random.Random(3)
    payloads = [avi.pad(x) for x in (b"", b"a", b"l" * 5000, bytes(range(256)) * 20, b"\xff" * 3000, *[rng.randbytes(rng.randrange(2000)) for _ in range(40)])]
    files = avi.store(payloads)
    for data, file, (rate, comment, levels, hists) in zip(payloads, files, avi._decode_files(files, jpeg.Decoder())):
        assert avi.payload(levels, comment) == data and hists.sum(1).tolist() == [avi.WIDTH * avi.HEIGHT] * len(hists)
        assert avi.read_avi(file)[1] == avi.read_avi(file.replace(b"idx1", b"JUNK"))[1]


def brute_blocks(frame):
    """Coefficients of a frame, a bit at a time."""
    layout, at = jpeg.parse_header(frame)
    tables = {k: {(length, code): s for s, code, length in jpeg._codes(*v)} for k, v in layout.tables}
    out, segments = [], re.split(rb"\xff[\xd0-\xd7]", frame[at:-2])
    across, down = layout.units
    left = across * down
    for segment in segments:
        bits = "".join(f"{b:08b}" for b in segment.replace(b"\xff\x00", b"\xff"))
        pos, dc = 0, [0] * len(layout.components)

        def symbol(key):
            nonlocal pos
            code = length = 0
            while (length, code) not in tables[key] or not length:
                code, length, pos = code << 1 | int(bits[pos]), length + 1, pos + 1
            return tables[key][length, code]

        def value(size):
            nonlocal pos
            v = int(bits[pos : pos + size] or "0", 2)
            pos += size
            return v if not size or v >> size - 1 else v - (1 << size) + 1

        for _ in range(min(left, layout.restart or left)):
            for c in layout.plan:
                block = [0] * 64
                dc[c] += value(symbol(layout.components[c][2]))
                block[0], k = dc[c], 1
                while k < 64:
                    s = symbol(layout.components[c][3])
                    if not s & 15 and s != 0xF0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = value(s & 15)
                    k += 1
                if c == 0:
                    out.append(block)
        left -= min(left, layout.restart or left)
    return np.array(out)


def colour_frame(seed):
    """16 x 8 pixels, 4:2:0 like sampling (two luma blocks and one of each chroma), no restarts, other tables."""
    rng = random.Random(seed)
    tables = jpeg.default_tables()
    bits, dc, coefficients = "", [0, 0, 0], []
    codes = {k: {s: f"{code:0{length}b}" for s, code, length in jpeg._codes(*v)} for k, v in tables.items()}

    def number(v, size):
        return f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    for c in (0, 0, 1, 2):
        block = [rng.randrange(-60, 60)] + [rng.choice([0, 0, 0, 0, 0, 5, -3]) for _ in range(63)]
        block[20:50] = [0] * 30
        d, which = block[0] - dc[c], int(c > 0)
        dc[c] = block[0]
        size = abs(d).bit_length()
        bits += codes[0, which][size] + number(d, size)
        run = 0
        last = max([k for k in range(1, 64) if block[k]], default=0)
        for k in range(1, last + 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                bits += codes[1, which][0xF0]
                run -= 16
            size = abs(block[k]).bit_length()
            bits += codes[1, which][run << 4 | size] + number(block[k], size)
            run = 0
        if last < 63:
            bits += codes[1, which][0]
        if c == 0:
            coefficients.append(block)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    dht = b"".join(bytes([k[0] << 4 | k[1], *v[0]]) + v[1] for k, v in tables.items())
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(range(1, 65)) + b"\xff\xc4" + struct.pack(">H", 2 + len(dht)) + dht
    head += b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 8, 16, 3) + b"\x01\x21\x00\x02\x11\x00\x03\x11\x00"
    return head + b"\xff\xda" + struct.pack(">HB", 12, 3) + b"\x01\x00\x02\x11\x03\x11\x00\x3f\x00" + scan + b"\xff\xd9", np.array(coefficients)


def test_decoder_against_brute_force():
    own = jpeg.encode_frames(avi._levels(bytes(random.Random(1).choices([108, 108, 108, 108, 1, 250, 120], k=3000))), avi.FRAME_BLOCKS, avi.WIDTH, avi.HEIGHT)
    colours = [colour_frame(s) for s in range(4)]
    found = jpeg.Decoder().luma([*own, *[f for f, _ in colours]])
    for frame, (_, blocks) in zip([*own, *[f for f, _ in colours]], found):
        assert (blocks == brute_blocks(frame)).all()
    for (_, expected), (layout, blocks) in zip(colours, found[len(own) :]):
        assert (blocks == expected).all()
        k = np.arange(8)
        basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
        flat = np.zeros((len(blocks), 64))
        flat[:, jpeg.ZIGZAG] = blocks * np.array(struct.unpack(">64H", layout.quantiser))
        exact = np.einsum("ux,nuv,vy->nxy", basis, flat.reshape(-1, 8, 8), basis).reshape(-1, 64) + 128
        assert np.abs(jpeg.pixels(layout, blocks).astype(float) - np.clip(exact, 0, 255)).max() <= 0.6


def test_shots_and_clips(spark):
    flat = lambda level: np.concatenate([np.full((avi.FRAME_BLOCKS, 1), level * 8), np.zeros((avi.FRAME_BLOCKS, 63), int)], axis=1)
    rng = np.random.default_rng(0)
    blocks = np.concatenate([flat(level) for level in [*[-60] * 8, *[40] * 6, *[0] * 7]])
    blocks[:, 1] += rng.integers(-2, 3, len(blocks))
    file = avi.write_avi(jpeg.encode_frames(blocks, avi.FRAME_BLOCKS, avi.WIDTH, avi.HEIGHT), avi.WIDTH, avi.HEIGHT)
    files = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"junk")), (4, bytearray(file[:100]))], "id long, media binary").withColumn("clip", F.lit("taken"))
    every = avi.clips(files).orderBy("id", "first_frame").collect()
    assert [(r.id, r.status) for r in every if r.status != "shot"] == [(2, "empty"), (3, "unreadable"), (4, "empty")]
    rows = [r for r in every if r.status == "shot"]
    assert [(r.id, r.clip, r.clip_, r.first_frame, r.frames) for r in rows] == [(1, "taken", 0, 0, 8), (1, "taken", 1, 8, 6), (1, "taken", 2, 14, 7)]
    assert rows[1].begin_s == pytest.approx(0.32) and rows[1].mean_luma > rows[2].mean_luma > rows[0].mean_luma
    assert avi.clips(files.limit(0)).count() == 0


def test_media_digests(spark):
    rows = avi.digests(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id is not None:
            raw = (ODD[r.doc_id] or "").encode()
            data = avi.pad(raw)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
            assert len(data) % 64 == 0 and data
    same = [tuple(r)[1:] for r in rows if r.doc_id == 9]
    assert len(same) == 2 and same[0] == same[1]


# very long texts


def test_stretches_of_long_texts_change_no_result(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["thé", "and", "a", "tion", "é字"], k=k)) for k in (0, 1, 2, 3, 50, 400)]
    ratio = quality_rules.Ratio(np.random.default_rng(0).normal(0, 1, quality_rules.BUCKETS), 0)
    plain = [simhash.fingerprint(t) for t in texts], [sorted(np.concatenate(list(quality_rules.grams(t)))) for t in texts]
    means = [ratio.mean(t) for t in texts]
    monkeypatch.setattr(simhash, "STRETCH", 20)
    monkeypatch.setattr(quality_rules, "STRETCH", 20)
    assert [simhash.fingerprint(t) for t in texts] == plain[0] == [brute_fingerprint(t) for t in texts]
    for text, expected, mean in zip(texts, plain[1], means):
        assert sorted(np.concatenate([[], *quality_rules.grams(text)])) == expected
        assert ratio.mean(text) == pytest.approx(mean)


# pipeline and registry


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = common.table(spark, sf_dir, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        out = common.cut_lineage(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids
        ids, docs = now, out
    packed = {r.doc_id for r in p.run(spark, sf_dir).select("doc_id").distinct().collect()}
    assert packed == ids


def test_pipeline_on_odd_rows(spark, sf_dir):
    import corpus_pipeline as p

    docs = odd_docs(spark)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        stage(spark, docs, sf_dir).count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_registry():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(names)


def _riff(kind, *chunks):
    body = kind + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def _named(name, data):
    return name + len(data).to_bytes(4, "little") + data + bytes(len(data) & 1)


def _list(kind, *chunks):
    return _named(b"LIST", kind + b"".join(chunks))


def test_dropped_frames_further_parts_and_other_streams():
    heads = _list(b"hdrl", _named(b"avih", (40000).to_bytes(4, "little") + bytes(52)), _list(b"strl", _named(b"strh", b"auds" + bytes(52))), _list(b"strl", _named(b"strh", b"vids" + bytes(52))))
    first = _list(b"movi", _named(b"01dc", b""), _named(b"01dc", b"one"), _named(b"00wb", b"sound"), _named(b"02dc", b"other"), _named(b"01dc", b""), _list(b"rec ", _named(b"01db", b"two")))
    more = _riff(b"AVIX", _list(b"movi", _named(b"01dc", b"three"), _named(b"01dc", b"")))
    rate, frames, _ = avi.read_avi(_riff(b"AVI ", heads, first) + more)
    assert rate == 40000 and frames == [b"one", b"one", b"one", b"two", b"three", b"three"]
    plain = _list(b"movi", _named(b"00dc", b"ab"), _named(b"00dc", b""), _named(b"00dc", b"cd"))
    index = _named(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 16, at, n) for at, n in ((4, 2), (14, 0), (22, 2))))
    assert avi.read_avi(_riff(b"AVI ", plain, index) + _riff(b"AVIX", _list(b"movi", _named(b"00dc", b"ef"))))[1] == [b"ab", b"ab", b"cd", b"ef"]
    assert avi.read_avi(_riff(b"AVI ", _list(b"movi", _named(b"00dc", b""))))[1] == []
