"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words.  Every passage is encoded (byte classes, hashed byte n-grams,
word repetition), a hidden layer embeds it, gated attention weighs the embeddings,
``softmax(w . (tanh(V h) * sigmoid(U h)))``, and the weighted sum gives the score.  Only document labels are known; the
attention learns which passages matter.  The fit uses a bounded sample of labelled documents; scoring reads every text
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import common

PASSAGE_WORDS = 64
#: Labelled documents in the fit, at most, and the longest text among them: the sample's bounds.
SAMPLE_DOCUMENTS = 3000
SAMPLE_BYTES = 1 << 15
GRAM_BUCKETS = 64
HIDDEN = 16
ATTENTION = 8
ROUNDS = 160
RATE = 0.03
DECAY = 1e-4
ACCEPTED = 0.7
#: Documents whose crc32(id) modulo FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 4, 2

_CLASSES = 10


def _byte_classes() -> np.ndarray:
    """blank, lower, upper, digit, sentence mark, exclamation, bar, symbol, other ASCII, beyond ASCII."""
    out = np.full(256, 8, np.uint8)
    out[128:] = 9
    for kind, chars in enumerate([b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"|", b"#*$%&<>@^~"]):
        out[list(chars)] = kind
    return out


_KIND = _byte_classes()
FEATURES = _CLASSES + GRAM_BUCKETS + 4


#: Bytes of texts, and of a long one, that are held as arrays at a time.
STEP_BYTES = STRETCH = 1 << 19

_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and each text's first passage (one more at the end); a text without words has one.

    A passage's features depend on its own text only: blanks before a text's first word belong to its first passage, and
    byte n-grams end with the text.  Long texts are read in stretches whose counts add up to the same numbers.
    """
    raw = [t.encode() for t in texts]
    return _long(raw[0]) if len(raw) == 1 and len(raw[0]) > STRETCH else _step(raw)


def _step(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of texts that are held at once."""
    arr = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes + 1)
    kinds = _KIND[arr]
    begins = kinds != 0
    begins[1:] &= kinds[:-1] == 0  # a text's last blank stands before the next text's first byte
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(ends, starts, "right")
    words = np.bincount(doc, minlength=len(raw))
    first_word = np.concatenate([[0], np.cumsum(words)])
    firsts = np.concatenate([[0], np.cumsum(np.maximum(1, -(-words // PASSAGE_WORDS)))])
    text = np.repeat(np.arange(len(raw)), sizes + 1)
    word = np.maximum(np.cumsum(begins) - 1 - first_word[text], 0)  # in its text
    of_byte = firsts[text] + word // PASSAGE_WORDS
    own = np.ones(arr.size, bool)
    own[ends - 1] = False
    counts = _Counts(int(firsts[-1]))
    counts.add(kinds[own], of_byte[own])
    inside = own[:-2] & own[1:-1] & own[2:]
    counts.add_grams(arr, of_byte[:-2], inside)
    hashes = np.zeros(0, np.uint64)
    if starts.size:
        place = np.arange(arr.size) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
        hashes = np.add.reduceat(_mixed(arr, kinds, place), starts)
    return counts.features(hashes, firsts[doc] + (np.arange(starts.size) - first_word[doc]) // PASSAGE_WORDS), firsts


def _long(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Passages of one text, read in stretches: what is held whole is a number for each word."""
    n_words = sum(int(_begins(raw, at)[1].sum()) for at in range(0, len(raw), STRETCH))
    counts = _Counts(max(1, -(-n_words // PASSAGE_WORDS)))
    hashes, seen, place_before = np.zeros(n_words, np.uint64), 0, 0
    for at in range(0, len(raw), STRETCH):
        kinds, begins = _begins(raw, at)
        arr = np.frombuffer(raw, np.uint8, min(len(raw) - at, STRETCH + 2), at)
        here = arr[: kinds.size]
        word = seen - 1 + np.cumsum(begins)  # -1 before the first
        of_byte = np.maximum(word, 0) // PASSAGE_WORDS
        counts.add(kinds, of_byte)
        counts.add_grams(arr, of_byte[: arr.size - 2], np.ones(max(arr.size - 2, 0), bool))
        starts = np.flatnonzero(begins)
        last = np.maximum.accumulate(np.where(begins, np.arange(here.size), -1))
        place = np.where(last < 0, np.arange(here.size) + place_before, np.arange(here.size) - last)
        mixed = _mixed(here, kinds, place)
        if seen and (not starts.size or starts[0]):
            hashes[seen - 1 : seen] += mixed[: starts[0] if starts.size else None].sum(dtype=np.uint64)
        if starts.size:
            hashes[seen : seen + starts.size] = np.add.reduceat(mixed, starts)
        place_before = int(place[-1]) + 1
        seen += starts.size
    return counts.features(hashes, np.arange(n_words) // PASSAGE_WORDS), np.array([0, counts.total])


def _begins(raw: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of the stretch from ``at`` on, and where words begin in it."""
    kinds = _KIND[np.frombuffer(raw, np.uint8, min(STRETCH, len(raw) - at), at)]
    begins = kinds != 0
    begins[1:] &= kinds[:-1] == 0
    begins[0] &= at == 0 or _KIND[raw[at - 1]] == 0
    return kinds, begins


def _mixed(arr: np.ndarray, kinds: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Summands of the words' hashes; ``place`` is that of a byte in its word."""
    return np.where(kinds == 0, np.uint64(0), (arr.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63])


class _Counts:
    """Whole-number counts of passages, and the features that they make."""

    def __init__(self, total: int):
        self.total = total
        self.classes = np.zeros(total * _CLASSES, np.int64)
        self.grams = np.zeros(total * GRAM_BUCKETS, np.int64)

    def add(self, kinds: np.ndarray, of_byte: np.ndarray) -> None:
        self.classes += np.bincount(of_byte * _CLASSES + kinds, minlength=self.classes.size)

    def add_grams(self, arr: np.ndarray, of_byte: np.ndarray, inside: np.ndarray) -> None:
        if arr.size > 2:
            wide = arr.astype(np.uint32)
            gram = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA6B) ^ wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 6)
            self.grams += np.bincount((of_byte * GRAM_BUCKETS + gram)[inside], minlength=self.grams.size)

    def features(self, hashes: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        """``hashes`` of the words, and the passage of each."""
        out = np.zeros((self.total, FEATURES), np.float32)
        classes = self.classes.reshape(self.total, _CLASSES)
        size = np.maximum(classes.sum(1), 1)[:, None]
        out[:, :_CLASSES] = classes / size
        out[:, _CLASSES : _CLASSES + GRAM_BUCKETS] = self.grams.reshape(self.total, GRAM_BUCKETS) / size
        if not hashes.size:
            return out
        found = np.bincount(of_word, minlength=self.total)
        n = np.maximum(found, 1)
        same = np.zeros(hashes.size, bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        order = np.lexsort((hashes, of_word))
        fresh = np.ones(hashes.size, bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
        out[:, -4] = np.bincount(of_word[same], minlength=self.total) / n
        out[:, -3] = np.bincount(of_word[order][fresh], minlength=self.total) / n
        out[:, -2] = np.where(found > 0, size[:, 0] / n / 8, 0)
        out[:, -1] = np.where(found > 0, np.log1p(n) / 4, 0)
        return out


def _grid(x: np.ndarray, bits: int) -> np.ndarray:
    """Multiples of 2^-bits: products of such numbers add up exactly in doubles, so in any order to the same sum."""
    return np.rint(np.asarray(x, float) * (1 << bits)) / (1 << bits)


def _softmax_bags(values: np.ndarray, firsts: np.ndarray, of: np.ndarray) -> np.ndarray:
    weights = np.exp(values - np.maximum.reduceat(values, firsts[:-1])[of])
    return weights / np.add.reduceat(weights, firsts[:-1])[of]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, firsts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Model:
        """Full-batch Adam on the balanced logistic loss of the bags."""
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - mean) / scale, -8, 8)
        w = {
            "E": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "a": rng.normal(0, ATTENTION**-0.5, ATTENTION), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
        }
        of = np.repeat(np.arange(len(labels)), np.diff(firsts))
        positive = max(labels.mean(), 1e-6)
        share = np.where(labels == 1, 0.5 / positive, 0.5 / max(1 - positive, 1e-6)) / len(labels)
        first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        for step in range(1, rounds + 1):
            h = np.tanh(x @ w["E"] + w["e"])
            t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
            att = _softmax_bags((t * s) @ w["a"], firsts, of)
            z = np.add.reduceat(h * att[:, None], firsts[:-1])
            d_out = (_sigmoid(z @ w["c"] + w["b"]) - labels) * share
            d_z = d_out[:, None] * w["c"]
            d_att = (h * d_z[of]).sum(1)
            d_score = att * (d_att - np.add.reduceat(att * d_att, firsts[:-1])[of])
            d_gate = d_score[:, None] * w["a"]
            d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
            d_h = (att[:, None] * d_z[of] + d_t @ w["V"].T + d_s @ w["U"].T) * (1 - h * h)
            grads = {"E": x.T @ d_h, "e": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_s, "a": (t * s).T @ d_score, "c": z.T @ d_out, "b": d_out.sum(keepdims=True)}
            for k, g in grads.items():
                g = g + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return Model(mean, scale, w)

    def attention(self, x: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and weight of each passage, whatever bags are computed together."""
        w = {k: _grid(np.clip(v, -15, 15), 20) for k, v in self.weights.items()}
        h = _grid(np.tanh(_grid(np.clip((x - self.mean) / self.scale, -8, 8), 16) @ w["E"] + w["e"]), 22)
        of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        att = _softmax_bags(_grid(np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"]), 22) @ w["a"], firsts, of)
        return _sigmoid(_grid(np.add.reduceat(h * att[:, None], firsts[:-1]), 22) @ w["c"] + w["b"]), att

    def score(self, texts: list[str]) -> np.ndarray:
        return np.round(self.attention(*passages(texts))[0].astype(float), 6)


def constant(score: float) -> Model:
    """For tables without labels of both kinds: the same score for every text."""
    w = {"E": np.zeros((FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, ATTENTION)), "U": np.zeros((HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "c": np.zeros(HIDDEN), "b": np.array([np.log(score / (1 - score))])}
    return Model(np.zeros(FEATURES), np.ones(FEATURES), w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Learns from at most ``sample`` labelled documents outside the held-out fold, those with the lowest hash of their id.

    They are chosen among the rows of ``docs`` whose text isn't null and has at most SAMPLE_BYTES.  Null labels and ids
    are passed over; of repeated labels the lowest counts, of rows of the same id the least text.  Without labels of
    both kinds the score is 0.9 (1 is all there is, or nothing is known) or 0.1.
    """
    usable = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").where(common.crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    lowest = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(usable.select("doc_id"), "doc_id", "left_semi")
    target = {r["doc_id"]: int(r["quality"]) for r in lowest.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}  # the documented bound
    if not target or len(set(target.values())) == 1:
        return constant(0.1 if target and not any(target.values()) else 0.9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.steps(batches, "text", STEP_BYTES):
            x, firsts = passages(texts)
            yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), pa.array([x[a:b].tobytes() for a, b in zip(firsts, firsts[1:])], pa.binary())], names=["doc_id", "x"])

    ids = docs.sparkSession.createDataFrame([(i,) for i in target], "doc_id long")  # at most ``sample`` rows
    chosen = usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    bags = {r["doc_id"]: np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in chosen.mapInArrow(run, "doc_id long, x binary").collect()}
    used = sorted(bags)
    y = np.array([target[i] for i in used], float)
    firsts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in used])])
    return Model.fit(np.concatenate([bags[i] for i in used]).astype(float), firsts, y)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of ``docs``; null text: empty, which has a score too; null id: not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.steps(batches, "text", STEP_BYTES):
            found = model.score(texts)
            held = common.column(part, "held_out")
            yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), held, pa.array(found), pa.array((found >= ACCEPTED).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(common.crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(run, SCORED)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.steps(batches, text, STEP_BYTES):
            yield part.filter(pa.array(model.score(texts) >= ACCEPTED))

    return docs.mapInArrow(run, docs.schema)
