"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams (one and two words, 2^20 buckets) are counted in full: one over the trusted
target (the ``benchmark`` passages), one over the raw corpus (all ``documents``).  The target's is smoothed towards the
raw one.  A document's ratio is the mean, over its n-grams, of log p_target - log p_raw.

The threshold is the target's own: each passage's ratio is taken with the passage's counts left out of the target, and a
document below all but QUANTILE of those is rejected.

Counts add up as arrays of fixed size, a part of them in each task; the model is a vector of BUCKETS numbers whatever the
input's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import bpe, common

BUCKETS = 1 << 20
#: Words in an n-gram, at most.
NGRAM = 2
#: Weight of the raw distribution in the target's, as a share of the target's n-grams.
SMOOTHING = 0.1
#: Share of the target's passages that lie below the threshold, which is a multiple of GRID.
QUANTILE, GRID = 0.01, 0.001
MIN_WORDS = 20
#: Percent of words in repeated windows above which a document fails.
MAX_REPEATED = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Texts above so many characters are hashed in parts.
STRETCH = 1 << 21
#: Buckets that are sent and added up together.
PART = 1 << 16
#: Tasks whose counts are added up before all are, as a power of two: reducers grow with the input.
FAN_BITS = 10

_SPACES = re.compile("[\x20\x09-\x0d]")


def base_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()  # bytes split at ASCII white space only
    lines = [line for line in text.split("\n") if line and not _only_space(line)]
    return len(words), len(text) - len(_SPACES.findall(text)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _only_space(line: str) -> bool:
    return not line.strip(" \t\n\r\x0b\x0c")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2 or window & (window - 1):
        return 0 if n < 2 else _repeated_slow(words, window)
    known: dict[bytes, int] = {}
    ranks = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    width = 1
    while width < window:  # ranks of windows twice as wide, exactly
        pairs = ranks[:-width] * (len(words) + 1) + ranks[width:]
        distinct, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    starts = np.flatnonzero(counts[ranks] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _repeated_slow(words: list[bytes], window: int) -> int:
    seen: dict[tuple, list[int]] = {}
    for at in range(len(words) - window + 1):
        seen.setdefault(tuple(words[at : at + window]), []).append(at)
    return len({at + k for places in seen.values() if len(places) > 1 for at in places for k in range(window)})


_MIXERS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    for mixer in _MIXERS:
        x = (x ^ x >> np.uint64(33)) * mixer
    return x ^ x >> np.uint64(33)


def hashed(words: list[bytes], longest: int = NGRAM, begin: int = 0) -> np.ndarray:
    """Buckets of the n-grams of up to ``longest`` words that end at or after word ``begin``."""
    own = _mixed(np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1))
    found, n_gram = [own[begin:]], own
    for n in range(2, longest + 1):
        n_gram = _mixed(n_gram[:-1] * np.uint64(3) + own[n - 1 :])
        found.append(n_gram[max(0, begin - n + 1) :])
    return (np.concatenate(found) >> np.uint64(64 - 20)).astype(np.int64)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, in blocks."""
    if len(text) <= STRETCH:
        yield hashed(text.encode().split())
        return
    carried: list[bytes] = []
    for part in bpe.stretches(text, STRETCH):  # no word is cut; the last words go on to the next stretch
        words = carried + part.encode().split()
        yield hashed(words, begin=len(carried))
        carried = words[max(0, len(words) - NGRAM + 1) :]


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """n-gram counts of all texts, by bucket, added in two steps: those of up to 2^FAN_BITS neighbouring tasks, then all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for _, texts in common.steps(batches, "text"):
            found = [block for text in texts for block in grams(text)]
            counts += np.bincount(np.concatenate(found), minlength=BUCKETS)
        parts = [k for k in range(BUCKETS // PART) if counts[k * PART : (k + 1) * PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([_packed(counts[k * PART : (k + 1) * PART]) for k in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # BUCKETS numbers at most
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held[part] = held.get(part, 0) + _unpacked(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([_packed(c) for c in held.values()], pa.binary())], names=["part", "counts"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part int, counts binary")
    near = counted.repartition("part", F.shiftright(F.spark_partition_id(), FAN_BITS)).mapInArrow(add, "part int, counts binary")
    out = np.zeros(BUCKETS, np.int64)
    for part, counts in near.repartition("part").mapInArrow(add, "part int, counts binary").collect():  # BUCKETS numbers
        out[part * PART : (part + 1) * PART] = _unpacked(counts)
    return out


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype("<u4" if counts.max() >> 32 == 0 else "<i8").tobytes()


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, "<u4" if len(counts) == 4 * PART else "<i8").astype(np.int64)


@dataclass(frozen=True)
class Ratio:
    """log p_target - log p_raw by bucket, and the ratio from which on a text is kept."""

    values: np.ndarray
    threshold: float

    @staticmethod
    def fit(target: DataFrame, raw: DataFrame, smoothing: float = SMOOTHING, quantile: float = QUANTILE) -> Ratio:
        """Null and empty passages have no n-grams and no part in the threshold; without any target nothing is rejected."""
        t, r = bucket_counts(target).astype(float), bucket_counts(raw).astype(float)
        p_raw = (r + 1) / (r.sum() + BUCKETS)
        total = t.sum()
        extra = smoothing * max(total, 1.0)
        values = np.log((t + extra * p_raw) / (total + extra)) - np.log(p_raw)
        shared = target.sparkSession.sparkContext.broadcast((t, p_raw))  # BUCKETS numbers each

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, p_raw = shared.value
            for _, texts in common.steps(batches, "text"):
                found = []
                for text in texts:
                    at, n = np.unique(np.concatenate([*grams(text), np.zeros(0, np.int64)]), return_counts=True)
                    if n.sum():
                        rest = t.sum() - n.sum()
                        extra = smoothing * max(rest, 1.0)
                        ratio = np.log((t[at] - n + extra * p_raw[at]) / (rest + extra)) - np.log(p_raw[at])
                        found.append(int(np.floor((ratio * n).sum() / n.sum() / GRID)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["step"])

        passages = target.select(F.col("text").cast("string").alias("text")).mapInArrow(left_out, "step int")
        steps = sorted(passages.groupBy("step").count().collect())  # a row for each thousandth, some ten thousand at most
        below, threshold = 0, -np.inf
        for step, n in steps:
            if below > quantile * sum(m for _, m in steps):
                break
            below, threshold = below + n, step * GRID
        return Ratio(values, threshold)

    def mean(self, text: str) -> float:
        """Ratio per n-gram; 0 for texts with none."""
        total, n = 0.0, 0
        for block in grams(text):
            total, n = total + float(self.values[block].sum()), n + len(block)
        return round(total / n, 9) if n else 0.0


def judge(texts: list[str], ratio: Ratio) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, ratios, base_failed and kept of texts."""
    stats = [base_stats(t) for t in texts]
    ratios = np.array([ratio.mean(t) for t in texts])
    failed = np.array([s[0] < MIN_WORDS or 100 * s[4] > MAX_REPEATED * s[0] for s in stats], bool)
    return stats, ratios, failed, ~failed & (ratios >= ratio.threshold)


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def score(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """A row for each row of ``docs`` (null text: no words, which fails the base rules); empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.steps(batches, "text"):
            stats, ratios, failed, kept = judge(texts, shared.value)
            columns = [pa.array(c, pa.int64()) for c in zip(*stats)]
            yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), *columns, pa.array(failed), pa.array(ratios), pa.array(kept)], names=[c.split()[0] for c in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def keep(docs: DataFrame, ratio: Ratio, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.steps(batches, text):
            yield part.filter(pa.array(judge(texts, shared.value)[3]))

    return docs.mapInArrow(run, docs.schema)
