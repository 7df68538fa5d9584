"""Brown class-based bigram language model.

Word counts cover all training documents.  The VOCABULARY most frequent words are clustered; every other word stays a word
of its own, with its own count, in one of four classes by its characters.  A text's probability is the product of
P(class | class before) P(word | class); a document's end is a token with a class of its own, which also stands before
the first word.  Transitions are smoothed towards class frequencies and emissions by a constant, with room for one
unknown word in each class, so that probabilities add up to one.

Exchange clustering maximises the likelihood of the class bigrams.  The SEEDS most frequent words are exchanged one by
one on the driver, over their own bigram counts (a matrix of fixed size), until none moves or SWEEPS times.  Then all words take part in rounds: a pass
over the encoded corpus counts each word's neighbours by class; the counts of a block of words meet in one task, which
finds the best class of each of its words, given all others; counts are added up among neighbouring tasks first.  Moves that are good one by one can be bad together, so
those of the highest gain are made, as long as no class gains or loses over a SHARE of its tokens; a round that lowers
the likelihood is taken back and tried with a quarter of that.  Rounds end when the likelihood rises by less than GAIN
of its value, or after ROUNDS.

The corpus is tokenised twice, for the counts and for the encoding in two bytes a token, which later passes read.
Scoring knows the counts of the COUNTS_HELD most frequent words; those of the others, few tokens, come from the full
count table by a join.
So no frequent word is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm import bpe, common

#: Clustered words, at most; with the end and the four kinds of other words, ids fit two bytes.
VOCABULARY = 65_500
#: Words, at most, whose counts tasks hold; the others, few tokens, meet theirs in a join.
COUNTS_HELD = 1 << 18
SEEDS = 2048
#: Class 0 is a document's end, 1 to 4 hold the words that aren't clustered.
CLASSES = 64
SWEEPS = 6
ROUNDS, GAIN, SHARE = 6, 1e-4, 0.2
ADDED = 0.1
#: Class-frequency weight in transitions.
BACKOFF = 2.0
FOLDS, HELD_OUT = 10, 0
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 300_000
#: Tokens that are counted at a time, words whose counts meet in one task, and words whose moves are tried at a time.
COUNTED, BLOCK, TRIED = 1 << 21, 256, 32
#: Counts of 2^FAN_BITS neighbouring tasks are added up before they meet all others.
FAN_BITS = 9

IDS = 1 << 16
#: Ids of words that aren't clustered, by kind: not ASCII, with a digit, letters only, other.
KINDS = 4
FIRST_KIND = IDS - KINDS


_BLANK = bytes(32 if b in b" \t\n\r\x0b\x0c" else 0 for b in range(256))


def words_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of all texts, which of them each word is, and each text's first word (and one past the last)."""
    raw = [t.encode().lower() for t in texts]  # of bytes: ASCII only, as wanted
    joined = b"\n".join([b"", *raw, b""])
    blank = np.frombuffer(joined.translate(_BLANK), np.uint8) > 0
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    texts_at = np.cumsum([1, *(len(r) + 1 for r in raw)])
    keys, inverse = bpe.distinct(joined, starts, ends)
    return keys, inverse, np.searchsorted(starts, texts_at)


def kind(word: bytes) -> int:
    """Of a word that isn't clustered: 0 to 3."""
    return 0 if not word.isascii() else 2 if word.isalpha() else 1 if any(48 <= c <= 57 for c in word) else 3


def _kind(word: Column) -> Column:
    text = word.cast("string")
    return F.when(text.rlike(r"[^\x00-\x7F]"), 0).when(text.rlike("^[a-z]+$"), 2).when(text.rlike("[0-9]"), 1).otherwise(3)


def _training(docs: DataFrame) -> DataFrame:
    kept = F.coalesce(common.crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True))
    return docs.where(kept).select(F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all training documents; an empty word stands for a document's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for _, texts in common.steps(batches, "text"):
            keys, inverse, _ = words_of(texts)
            held.update(dict(zip(keys, np.bincount(inverse, minlength=len(keys)).tolist())))
            held[b""] += len(texts)
            if len(held) > HELD_WORDS:
                yield rows()
        yield rows()

    return _training(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Words:
    """word -> id: 0 is a document's end, then clustered words by rank, and at the end the kinds of other words."""

    ids: dict[bytes, int]

    def of(self, words: list[bytes]) -> np.ndarray:
        own = self.ids.get
        return np.array([own(w) or FIRST_KIND + kind(w) for w in words], np.uint16)


def vocabulary(counts: DataFrame, most: int = VOCABULARY, held: int = 0) -> dict[bytes, int]:
    """Counts of the ``most`` most frequent words, by rank (ties by word), and of more, as long as words of about the same
    count are ``held`` or fewer together with those before them."""
    words = counts.where(F.octet_length("word") > 0)
    step = F.floor(F.log2("c") * 16).cast("int")
    total, least, wanted, cut = 0, None, [], None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.min("c").alias("c")).collect(), reverse=True):  # 16 rows for each doubling
        if total + r["v"] > max(most, held):
            cut = r["step"] if total < most else None
            break
        total, least = total + r["v"], r["c"]
    if least is not None:
        wanted.append(words.where(F.col("c") >= least))  # at most ``held`` rows, or ``most``
    if cut is not None:
        wanted += _first(words.where(step == cut), most - total)
    pairs = sorted((-c, w) for df in wanted for t in [df.select("c", "word").toArrow()] for c, w in zip(t["c"].to_pylist(), t["word"].to_pylist()))
    return {w: -c for c, w in pairs[: max(most, total)]}


def _first(words: DataFrame, n: int) -> list[DataFrame]:
    """Rows among which are the ``n`` first by count, descending, and word, and as many others at most.

    They are cut off by count, then by the words' first two bytes, first four and so on, until few enough words are in
    the group that the cut goes through; so ties of any number don't gather anywhere.
    """
    out, left, depth = [], n, 0
    while True:
        key = F.substring("word", 1, 2 * depth) if depth else -F.col("c")
        groups = words.groupBy(key.alias("key")).agg(F.count("*").alias("v")).collect()  # 2^16 for two bytes more; counts of a step
        for at, v in sorted((bytes(r["key"]) if depth else r["key"], r["v"]) for r in groups):
            if v >= left:
                break
            left -= v
        if v <= n:
            return [*out, words.where(key <= F.lit(at))]
        out.append(words.where(key < F.lit(at)))
        words, depth = words.where(key == F.lit(at)), depth + 1


def neighbours(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, here) of every token, ends included: ``values`` of the texts' words, 0 for a text's end."""
    return np.insert(values, firsts[:-1], 0), np.insert(values, firsts[1:], 0)


def encoded(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(ids): the training documents' tokens in rows of a step each, two bytes a token, 0 after each document."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)  # at most VOCABULARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(shared.value)
        for _, texts in common.steps(batches, "text"):
            words, inverse, firsts = words_of(texts)
            yield pa.RecordBatch.from_arrays([pa.array([neighbours(own.of(words)[inverse], firsts)[1].astype("<u2").tobytes()], pa.binary())], names=["ids"])

    return _training(docs).mapInArrow(run, "ids binary")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Tokens of about COUNTED at a time, each with an end before it."""
    held, n = [np.zeros(1, "<u2")], 0
    for batch in batches:
        for value in batch.column(0):
            held.append(np.frombuffer(value.as_buffer(), "<u2"))
            n += held[-1].size
            if n >= COUNTED:
                yield np.concatenate(held)
                held, n = [np.zeros(1, "<u2")], 0
    if n:
        yield np.concatenate(held)


def _near() -> Column:
    """One number for up to 2^FAN_BITS neighbouring tasks: their counts are added up first."""
    return F.shiftright(F.spark_partition_id(), FAN_BITS)


def _summed(corpus: DataFrame, index, size: int) -> np.ndarray:
    """``index`` gives numbers below ``size`` for the tokens of a stream; how often each occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for ids in _streams(batches):
            counts += np.bincount(index(ids), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["at", "n"])

    near = corpus.mapInArrow(run, "at long, n long").groupBy("at", _near().alias("near")).agg(F.sum("n").alias("n"))
    summed = near.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[summed["at"].to_numpy()] = summed["n"].to_numpy()
    return out


def seed_bigrams(corpus: DataFrame, seeds: int) -> np.ndarray:
    """Counts of neighbours among the end, the ``seeds`` first words and the kinds of other words; other ids are left out."""
    n = 1 + seeds + KINDS
    unit = np.full(IDS, n, np.int64)
    unit[: 1 + seeds] = np.arange(1 + seeds)
    unit[FIRST_KIND:] = np.arange(1 + seeds, n)

    def index(ids: np.ndarray) -> np.ndarray:
        own = unit[ids]
        a, b = own[:-1], own[1:]
        return (a * n + b)[(a < n) & (b < n)]

    return _summed(corpus, index, n * n).reshape(n, n)


def class_bigrams(corpus: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of neighbouring classes; ``of``: class of each id, ``classes`` for none."""
    wide = classes + 1

    def index(ids: np.ndarray) -> np.ndarray:
        own = of[ids].astype(np.int64)
        return own[:-1] * wide + own[1:]

    return _summed(corpus, index, wide * wide).reshape(wide, wide)[:classes, :classes]


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(table: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray, old: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of some words the class, from ``first`` on, in which the likelihood is highest, and by how much it rises.

    ``table``: class bigrams with all words in their classes; ``out`` and ``into``: counts of a word's neighbours by
    class, the word itself among them, ``own`` times; ``old``: its class, -1 if it has none.  Ties go to the old class,
    then to the lowest.
    """
    m, k = np.arange(len(old)), np.arange(len(table))
    placed = old >= 0
    p, o = m[placed], old[placed]
    out, into, t = out.astype(float), into.astype(float), np.repeat(table[None].astype(float), len(old), 0)
    out[p, o] -= own[p]
    into[p, o] -= own[p]
    t[p, o, :] -= out[p]
    t[p, :, o] -= into[p]
    t[p, o, o] -= own[p]
    f, with_row, with_column = _x_log_x(t), _x_log_x(t + out[:, None, :]), _x_log_x(t + into[:, :, None])
    gain = (with_row - f).sum(2) + (with_column - f).sum(1)
    gain += _x_log_x(t[:, k, k] + out + into + own[:, None]) + f[:, k, k] - with_row[:, k, k] - with_column[:, k, k]
    rows, columns = t.sum(2) + into, t.sum(1) + out
    gain -= _x_log_x(rows + (out.sum(1) + own)[:, None]) - _x_log_x(rows) + _x_log_x(columns + (into.sum(1) + own)[:, None]) - _x_log_x(columns)
    gain[:, :first] = -np.inf
    new = gain.argmax(1)
    rise = gain[m, new]
    rise[placed] -= gain[p, o]
    new[placed] = np.where(rise[placed] > 1e-9, new[placed], o)
    return new, rise


def exchange(pairs: np.ndarray, fixed: dict[int, int], classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit, one move after the other; ``fixed`` units keep theirs, and no other unit joins them."""
    total, first = pairs.sum(0) + pairs.sum(1), 1 + max(fixed.values())
    order = [u for u in np.argsort(-total, kind="stable").tolist() if u not in fixed]
    of = np.zeros(len(pairs), np.int64)
    for rank, u in enumerate(order):
        of[u] = first + rank % (classes - first)
    for u, c in fixed.items():
        of[u] = c
    member = np.eye(classes)[of]
    table = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            out, into, own = np.bincount(of, pairs[u], classes), np.bincount(of, pairs[:, u], classes), pairs[u, u]
            new = int(best_classes(table, out[None], into[None], np.array([own]), of[u : u + 1], first)[0][0])
            if new != of[u]:
                old = of[u]
                out[old] -= own
                into[old] -= own
                for c, sign in ((old, -1), (new, 1)):
                    table[c] += sign * out
                    table[:, c] += sign * into
                    table[c, c] += sign * own
                of[u] = new
                moved += 1
        if not moved:
            break
    return of


def _moves(corpus: DataFrame, of: np.ndarray, table: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, classes, rises): the best class of each ``chosen`` id that isn't in it, given the classes of all others, and
    by how much the likelihood rises."""
    classes = len(table)
    wide, first = classes + 1, 1 + KINDS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before, own = np.zeros(IDS * wide, np.int64), np.zeros(IDS * wide, np.int64), np.zeros(IDS, np.int64)
        for ids in _streams(batches):
            a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
            after += np.bincount((a * wide + of[b])[chosen[a]], minlength=after.size)
            before += np.bincount((b * wide + of[a])[chosen[b]], minlength=before.size)
            own += np.bincount(a[(a == b) & chosen[a]], minlength=IDS)
        held = {}
        for block in range(IDS // BLOCK):
            words = slice(block * BLOCK, (block + 1) * BLOCK)
            cells = slice(block * BLOCK * wide, (block + 1) * BLOCK * wide)
            counts = np.concatenate([after[cells], before[cells], own[words]])
            if counts.any():
                held[block] = counts
        yield packed(held)

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        places, numbers = [], []
        for counts in held.values():
            found = np.flatnonzero(counts)
            places.append(found.astype("<u2").tobytes())
            numbers.append(counts[found].astype("<i8" if counts.max() >> 31 else "<i4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], names=["block", "places", "numbers"])

    def added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        held: dict[int, np.ndarray] = {}  # of IDS / BLOCK blocks at most, of fixed size
        for batch in batches:
            for block, places, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(places, "<u2")
                counts = held.setdefault(block, np.zeros(BLOCK * (2 * wide + 1), np.int64))
                counts[at] += np.frombuffer(numbers, "<i4" if len(numbers) == 4 * at.size else "<i8")
        return held

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(added(batches))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = added(batches)
        for block, counts in held.items():
            after, before = counts[: BLOCK * wide].reshape(BLOCK, wide), counts[BLOCK * wide : 2 * BLOCK * wide].reshape(BLOCK, wide)
            here = np.flatnonzero(after.any(1) | before.any(1))
            for at in range(0, here.size, TRIED):
                some = here[at : at + TRIED]
                ids = block * BLOCK + some
                old = np.where(of[ids] < classes, of[ids].astype(np.int64), -1)
                new, rise = best_classes(table, after[some, :classes], before[some, :classes], counts[2 * BLOCK * wide + some], old, first)
                moved = new != old
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(new[moved]), pa.array(rise[moved])], names=["id", "class", "rise"])

    cells = "block int, places binary, numbers binary"
    near = corpus.mapInArrow(count, cells).repartition("block", _near()).mapInArrow(add, cells)
    found = near.repartition("block").mapInArrow(choose, "id long, class long, rise double").toArrow()  # at most a row for each word
    order = np.lexsort((found["id"].to_numpy(), -np.round(found["rise"].to_numpy(), 3)))
    return tuple(found[c].to_numpy()[order] for c in ("id", "class", "rise"))


def _allowed(ids: np.ndarray, to: np.ndarray, of: np.ndarray, sizes: np.ndarray, classes: int, share: float) -> np.ndarray:
    """Which moves are made: the first ones, as long as no class gains or loses over ``share`` of its tokens (or one word)."""
    most = np.bincount(of, sizes, classes)[:classes] * share
    came, went, out = np.zeros(classes), np.zeros(classes), np.zeros(len(ids), bool)
    for k, (i, c) in enumerate(zip(ids.tolist(), to.tolist())):
        o, n = of[i], sizes[i]
        if (came[c] + n <= most[c] or not came[c]) and (went[o] + n <= most[o] or not went[o]):
            came[c] += n
            went[o] += n
            out[k] = True
    return out


def likelihood(table: np.ndarray) -> float:
    """Natural log of the class bigrams' probability, short of what no move changes."""
    return float(_x_log_x(table).sum() - _x_log_x(table.sum(0)).sum() - _x_log_x(table.sum(1)).sum())


def cluster(corpus: DataFrame, sizes: np.ndarray, classes: int = CLASSES, seeds: int = SEEDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, class bigrams) for clustered words; ``corpus`` as of :func:`encoded`, ``sizes`` the count of each
    id from 1 on."""
    if not 1 + KINDS < classes < 128:
        raise ValueError("classes: from 6 to 127")
    words, counts = len(sizes), np.zeros(IDS)
    counts[1 : 1 + words] = sizes
    of = np.full(IDS, classes, np.uint8)
    of[0], of[FIRST_KIND:] = 0, np.arange(1, 1 + KINDS)
    seeds = min(seeds, words)
    fixed = {0: 0} | {1 + seeds + i: 1 + i for i in range(KINDS)}
    of[1 : 1 + seeds] = exchange(seed_bigrams(corpus, seeds), fixed, classes)[1 : 1 + seeds]
    table = class_bigrams(corpus, of, classes)
    if words > seeds:
        chosen = np.zeros(IDS, bool)
        chosen[1 + seeds : 1 + words] = True
        ids, to, _ = _moves(corpus, of, table, chosen)
        of[ids] = to
        table = class_bigrams(corpus, of, classes)
    chosen = np.zeros(IDS, bool)
    chosen[1 : 1 + words] = True
    share, found = SHARE, None
    for _ in range(rounds if words else 0):
        ids, to, rises = found or _moves(corpus, of, table, chosen)
        made = _allowed(ids, to, of, counts, classes, share)
        moved = of.copy()
        moved[ids[made]] = to[made]
        after = class_bigrams(corpus, moved, classes)
        rise = likelihood(after) - likelihood(table)
        if rise <= 0:  # taken back
            found, share = (ids, to, rises), share / 4
            if share < SHARE / 100:
                break
            continue
        of, table, found = moved, after, None
        if rise < GAIN * abs(likelihood(table)):
            break
    of[of == classes] = 1 + 2
    return of, table


@dataclass
class Model:
    """What scoring needs, of bounded size."""

    #: of clustered words, and of these and more
    counts: dict[bytes, int]
    held: dict[bytes, int]
    #: class of each id
    classes: np.ndarray
    transitions: np.ndarray
    #: log10 of each class's emission denominator
    emitted: np.ndarray
    end_count: int
    tokens: int
    distinct: int

    @property
    def base(self) -> float:
        return log10(self.tokens + ADDED * (self.distinct + 1))


def fit(docs: DataFrame, counts: DataFrame, classes: int = CLASSES, most: int = VOCABULARY, seeds: int = SEEDS) -> Model:
    """``counts`` as of :func:`word_counts`."""
    held = vocabulary(counts, most, COUNTS_HELD)
    known = dict(islice(held.items(), most))
    ids = {w: 1 + i for i, w in enumerate(known)}
    corpus = common.cut_lineage(encoded(docs, ids))
    of, table = cluster(corpus, np.array(list(known.values()), float), classes, seeds)
    class_n, class_v = np.zeros(classes), np.zeros(classes)
    place = F.when(F.octet_length("word") == 0, 0).otherwise(1 + _kind(F.col("word")))
    for r in counts.groupBy(place.alias("class")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect():  # 5 rows
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    tokens, distinct, end_count = int(class_n.sum()), int(class_v.sum()), int(class_n[0])
    for w, c in known.items():
        for at, sign in ((1 + kind(w), -1), (of[ids[w]], 1)):
            class_n[at] += sign * c
            class_v[at] += sign
    return Model(known, held, of, transitions(table, class_n), np.log10(class_n + ADDED * (class_v + 1)), end_count, tokens, distinct)


def transitions(table: np.ndarray, class_n: np.ndarray) -> np.ndarray:
    """log10 P(class | class before)."""
    share = (class_n + ADDED) / (class_n.sum() + ADDED * len(class_n))
    return np.log10((table + BACKOFF * share) / (table.sum(1, keepdims=True) + BACKOFF))


class _Scorer:
    """Scores a step's texts at once."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words({w: 1 + i for i, w in enumerate(model.counts)})

    def score(self, texts: list[str]) -> tuple[list[np.ndarray], tuple[np.ndarray, list[bytes], np.ndarray]]:
        """Per text: tokens, those with a known count here, the sum of their log10(count + ADDED), and the rest of the
        score; then the words whose counts aren't known here: (text, word, times)."""
        model, known = self.model, self.model.held.get
        words, inverse, firsts = words_of(texts)
        before, here = neighbours(model.classes[self.words.of(words)][inverse], firsts)
        begins = firsts[:-1] + np.arange(len(texts))  # a text's end comes after each
        model_part = np.add.reduceat(model.transitions[before, here] - model.emitted[here], begins)
        counts = np.array([known(w, 0) for w in words], np.float64)
        own = counts[inverse]
        text = np.repeat(np.arange(len(texts)), np.diff(firsts))
        n_known = np.bincount(text[own > 0], minlength=len(texts))
        log_c = np.bincount(text, np.where(own > 0, np.log10(own + ADDED), 0), len(texts)) + log10(model.end_count + ADDED)
        rest = own == 0
        pairs, times = np.unique(text[rest] * max(1, len(words)) + inverse[rest], return_counts=True)
        which = (pairs % max(1, len(words))).tolist()
        tokens = np.diff(firsts) + 1
        return [tokens, n_known + (model.end_count > 0), log_c, model_part], (pairs // max(1, len(words)), [words[i] for i in which], times)


_ROWS = "row long, word binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, model double"


def score(docs: DataFrame, classes: int = CLASSES, most: int = VOCABULARY, seeds: int = SEEDS) -> DataFrame:
    """Per row of ``docs``: tokens, known tokens, training tokens, base score, the class model's score and perplexity.

    Null texts are empty (just the end token); rows without an id count as training; repeated rows are scored each.
    Without training documents all counts are 0 and every word is unknown.  An empty table gives no rows.
    """
    counts = common.cut_lineage(word_counts(docs))
    model = fit(docs, counts, classes, most, seeds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, row = _Scorer(shared.value), TaskContext.get().partitionId() << 40
        for part, texts in common.steps(batches, "text"):
            (tokens, known, log_c, model_part), (text, words, times) = scorer.score(texts)
            n, more = len(texts), len(words)
            # the blank keeps a document's own row apart from any word
            marks = pa.array([b" %d" % (row + i) for i in range(n)], pa.binary())
            own = [row + np.arange(n), None, np.zeros(n, np.int64), common.column(part, "doc_id"), common.column(part, "held_out"), tokens, known, log_c, model_part]
            rest = [row + text, None, times]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            arrays = [pa.concat_arrays([marks, pa.array(words, pa.binary())] if i == 1 else [pa.array(c).cast(k) if isinstance(c, np.ndarray) else c, pa.array(rest[i]).cast(k) if i < 3 else pa.nulls(more, k)]) for i, (c, k) in enumerate(zip(own, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _ROWS.split(", ")])
            row += n

    held = F.coalesce(common.crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(run, _ROWS)
    rows = common.cut_lineage(rows)  # numbers are of partitions and places, so no row is made twice
    met = rows.join(counts.where(F.octet_length("word") > 0), "word", "left")
    c = F.coalesce("c", F.lit(0))
    summed = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(c > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("log_c", F.col("times") * F.log10(c + ADDED))).alias("log_c"),
        F.sum("model").alias("model"),
    )
    out = summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("log_c") - F.col("n_tokens") * model.base).alias("base_score"), (F.col("log_c") + F.col("model")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
