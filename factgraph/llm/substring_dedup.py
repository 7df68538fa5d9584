"""Removal of repeated word windows: a merged count-min sketch, then exact groups of what it estimates as repeated.

The first pass counts every window of WINDOW words in a sketch of SLICES slots for each window.  Tasks send the slots they
touched, blocks are merged in two steps, and what is left is one bit for each slot: touched twice or more.  It is bounded
(MOST_SLOTS bits), so it is broadcast.  An estimate is never too low: a window with a slot that isn't set occurs once and
goes nowhere.  The second pass groups the others exactly, by 128 bits of hash, and finds where each starts first.  Those
places go back to their documents; what a document's candidate windows cover and isn't first is removed.

Copies repeat many windows in a row, so they are grouped in two steps.  Runs of candidates are cut at windows whose hash
says so, about one in CUT.  Pieces are grouped first, a row each: of equal ones only the first goes on, as each window of the
others starts earlier there.  Then the windows of first pieces are grouped, so rows grow with different windows, not copies.

Windows beyond the sketch's size cost shuffled rows (more unique windows are taken for repeated), never results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import common

WINDOW, SEED = 20, 42
SLICES = 2
#: The sketch has a slot for each byte of text, as a power of two, within these bounds: 128 MiB when broadcast.
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 30
#: Slots of a part of the sketch; parts are merged one by one.
BLOCK = 1 << 17
#: Windows that a task counts before it sends their slots.
COUNTED = 2 << 20
#: Candidate windows in a row are cut into pieces of about so many.
CUT = 32
#: Windows hashed at a time: what is at hand for so many stays in a core's cache.
HASHED = 1 << 13
#: Counting tasks from which blocks are merged in two steps, and bytes of a very long text that are held as words at a time.
MERGED, STRETCH = 256, 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIXERS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_JOIN = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_NO_ID = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    out, high = x, np.empty_like(x)
    for mixer in _MIXERS:
        np.right_shift(out, np.uint64(33), out=high)
        out = np.bitwise_xor(out, high, out=None if out is x else out)
        out *= mixer
    np.right_shift(out, np.uint64(33), out=high)
    out ^= high
    return out


def pieces(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """``text`` in pieces that cut no word."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def _words(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(words of all parts, number of words of each part)."""
    lists = pc.ascii_split_whitespace(pa.array(parts, pa.string()))
    words, counts = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    full = pc.not_equal(words, "")  # what stands before the first space or after the last may be empty
    if not pc.all(full).as_py():
        counts = np.bincount(np.repeat(np.arange(len(parts)), counts)[full.to_numpy(zero_copy_only=False)], minlength=len(parts))
        words = words.filter(full)
    return words, counts


def _hashes(words: pa.Array) -> np.ndarray:
    """Two independent hashes of each word; every different word is hashed once."""
    from xxhash import xxh3_128_digest

    coded = words.dictionary_encode()
    data, ends = coded.dictionary.buffers()[2].to_pybytes() if len(words) else b"", np.frombuffer(coded.dictionary.buffers()[1], "<i4")[: len(coded.dictionary) + 1].tolist() if len(words) else []
    own = b"".join([xxh3_128_digest(data[a:b], SEED) for a, b in zip(ends, ends[1:])])
    return np.ascontiguousarray(np.frombuffer(own, ">u8").astype(np.uint64).reshape(-1, 2).T)[:, coded.indices.to_numpy()]


def word_hashes(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(2 x words of all texts, number of words of each text)."""
    held, of, size, n, out, counts = [], [], 0, 0, [np.zeros((2, 0), np.uint64)], []

    def add() -> None:
        words, each = _words(held)
        out.append(_hashes(words))
        counts.append((of, each))

    for text in texts:
        for piece in pieces(text):
            held.append(piece)
            of.append(n)
            size += len(piece)
            if size > STRETCH:
                add()
                held, of, size = [], [], 0
        n += 1
    add()
    total = np.zeros(n, np.int64)
    for own, each in counts:
        np.add.at(total, np.array(own, np.int64), each)  # a text may have several pieces
    return np.concatenate(out, 1), total


def windows(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Two hashes of each ``window`` consecutive words, from spans of doubling length."""
    out = np.empty((2, max(0, words.shape[1] - window + 1)), np.uint64)
    for at in range(0, out.shape[1], HASHED):
        out[:, at : at + HASHED] = _windows(words[:, at : at + HASHED + window - 1], window)
    return out


def _windows(words: np.ndarray, window: int) -> np.ndarray:
    n = words.shape[1] - window + 1
    joiner, span, length, out, covered = _JOIN[:, None], _mixed(words ^ _JOIN[::-1, None]), 1, None, 0
    while True:
        if window & length:
            here = span[:, covered : covered + n]
            out, covered = here if out is None else _mixed(out * joiner + here), covered + length
        if 2 * length > window:
            return out
        span = _mixed(span[:, :-length] * joiner + span[:, length:])
        length *= 2


def _placed(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text, start of each window that lies within one text, words of each text)."""
    words, counts = word_hashes(texts)
    begins = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(of)) - begins[of]
    every = windows(words, window)
    inside = (start + window <= counts[of])[: every.shape[1]]
    return every[:, inside], of[: every.shape[1]][inside], start[: every.shape[1]][inside], counts


def slots(hashes: np.ndarray, size: int) -> np.ndarray:
    """SLICES x windows: the slots that each window counts in, of ``size``, a power of two."""
    shift = np.uint64(64 - (size.bit_length() - 1))
    step = hashes[1] | np.uint64(1)
    return np.stack([(hashes[0] + np.uint64(k) * step) * _JOIN[0] >> shift for k in range(SLICES)]).astype(np.uint32)


def packed(marks: np.ndarray) -> bytes:
    """Sorted different marks as their steps; a byte of 255 adds to the one after it."""
    gaps = np.diff(marks.astype(np.int64), prepend=0)
    long = gaps // 255
    out = np.full(int(long.sum()) + len(marks), 255, np.uint8)
    out[np.cumsum(long + 1) - 1] = gaps % 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.uint32)[steps != 255]


def merged(marks: list[np.ndarray]) -> np.ndarray:
    """Marks of counts that were added up: twice the slot, and one more if it was touched twice or more."""
    every = np.concatenate([*marks, np.zeros(0, np.uint32)])
    every.sort()
    own = every >> 1
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    twice = np.maximum.reduceat(every & 1, first) | (np.diff(first, append=len(own)) > 1) if len(own) else own
    return 2 * own[first] + twice.astype(np.uint32)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, version, text): ``doc`` orders documents; ``version`` tells texts of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), F.shiftrightunsigned(F.xxhash64(text), 33).alias("version"), text.cast("binary").alias("text"))


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part, texts in common.steps(batches, "text"):
        yield part, [t or b"" for t in texts]


def sketch(texts: DataFrame, window: int = WINDOW, most: int = MOST_SLOTS) -> tuple[bytes, int]:
    """(a bit for each slot, number of slots); set where windows of ``texts`` touch the slot twice or more."""
    held = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    size = max(LEAST_SLOTS, min(most, 1 << int(held).bit_length()))
    blocks = size // BLOCK
    kinds = "block int, salt long, marks binary"

    def rows(own, marks, salt) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([salt] * len(own), pa.int64()), pa.array([packed(m) for m in marks], pa.binary())], names=["block", "salt", "marks"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            marks = merged([np.concatenate(found) << np.uint32(1)])
            found.clear()
            salt = int(marks.sum(dtype=np.int64))
            cuts = np.searchsorted(marks, 2 * BLOCK * np.arange(blocks + 1))
            touched = np.flatnonzero(np.diff(cuts)).tolist()
            yield rows(touched, [marks[cuts[b] : cuts[b + 1]] - 2 * BLOCK * b for b in touched], salt)

        for _, step in _steps(batches):
            own = slots(_placed(step, window)[0], size)
            n += own.shape[1]
            found.append(np.concatenate([own[0], *[own[k][(own[k] != own[:k]).all(0)] for k in range(1, SLICES)]]))  # a window's own slots may meet
            if n >= COUNTED:
                yield from sent()
                n = 0
        if n:
            yield from sent()

    def add(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows(group["block"].to_pylist()[:1], [merged([unpacked(m) for m in group["marks"].to_pylist()])], 0)])

    def bits(group: pa.Table) -> pa.Table:
        marks = merged([unpacked(m) for m in group["marks"].to_pylist()])
        flags = np.zeros(BLOCK, bool)
        flags[marks[marks & 1 == 1] >> 1] = True
        return pa.table([pa.array(group["block"].to_pylist()[:1], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    counted = texts.select("text").mapInArrow(count, kinds)
    tasks = texts.rdd.getNumPartitions()
    if tasks > MERGED:  # a block's rows meet in groups of the square root of the tasks
        counted = counted.withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(isqrt(tasks)))).groupBy("block", "salt").applyInArrow(add, kinds)
    out, made = np.zeros((blocks, BLOCK // 8), np.uint8), common.cut_lineage(counted.groupBy("block").applyInArrow(bits, "block int, bits binary"))
    for row in made.toLocalIterator():  # ``size`` bits
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    common.forget(made)
    return out.tobytes(), size


def _estimated(hashes: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Whether a window may occur twice: all its slots are set."""
    own = slots(hashes, size)
    return np.logical_and.reduce([bits[s >> np.uint32(3)] >> (s & np.uint32(7)).astype(np.uint8) & 1 == 1 for s in own])


def _first_inside(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether no earlier window of the same text is equal; windows come in order."""
    key = _mixed(hashes[0] ^ of.astype(np.uint64) * _JOIN[1])
    order = np.argsort(key, kind="stable")
    same = (np.diff(of[order]) == 0) & (np.diff(hashes[0][order]) == 0) & (np.diff(hashes[1][order]) == 0)
    if (same != (np.diff(key[order]) == 0)).any():  # different windows of one key
        order = np.lexsort((hashes[1], hashes[0], of))  # stable
        same = (np.diff(of[order]) == 0) & (np.diff(hashes[0][order]) == 0) & (np.diff(hashes[1][order]) == 0)
    out = np.ones(len(of), bool)
    out[order[1:][same]] = False
    return out


def _pieces(hashes: np.ndarray, of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first window of each piece, two hashes of its windows in order) of candidates that come in order."""
    if not len(of):
        return np.zeros(0, np.int64), np.zeros((2, 0), np.uint64)
    begins = np.ones(len(of), bool)
    begins[1:] = (np.diff(of) != 0) | (np.diff(start) != 1) | (_mixed(hashes[0][1:]) % np.uint64(CUT) == 0)
    first = np.flatnonzero(begins)
    place = (np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))).astype(np.uint64) + np.uint64(1)
    return first, np.stack([np.add.reduceat(_mixed(hashes[k] ^ place * _JOIN[k]), first) for k in range(2)])


def _firsts(found: DataFrame) -> DataFrame:
    """(doc, version, starts) of the rows (h1, h2, doc, start) that come first among those of equal hashes."""
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("f"))
    placed = first.select("f.doc", F.shiftright("f.start", 32).alias("version"), F.col("f.start").bitwiseAND(0xFFFFFFFF).cast("int").alias("start"))
    return common.cut_lineage(placed.groupBy("doc", "version").agg(F.collect_list("start").alias("starts")))  # a document's own


def _rows(part: pa.RecordBatch, hashes: np.ndarray, of: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    doc, version = (common.column(part, c).to_numpy()[of] for c in ("doc", "version"))
    return pa.RecordBatch.from_arrays([pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), pa.array(doc), pa.array(version << 32 | start)], names=["h1", "h2", "doc", "start"])


def _listed(part: pa.RecordBatch, begins: np.ndarray) -> np.ndarray:
    """Places, among all words of a step, of each row's ``starts``."""
    lists = common.column(part, "starts")
    return np.repeat(begins, lists.value_lengths().fill_null(0).to_numpy()) + lists.flatten().to_numpy()


def deduplicate(docs: DataFrame, window: int = WINDOW, most_slots: int = MOST_SLOTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each row's words that no repeated window covers.

    A window is removed if its word sequence starts earlier: in a document of smaller id, or earlier in the same one.  Null
    texts have no words; null ids come after all others.  Rows of the same id and text are one document, so they get equal
    results; several texts of one id are documents that follow each other in the order of a hash of the text.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    merged_bits, size = sketch(texts, window, most_slots)
    shared = spark.sparkContext.broadcast(merged_bits)  # at most MOST_SLOTS bits

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bits = np.frombuffer(shared.value, np.uint8)
        for part, step in _steps(batches):
            hashes, of, start, counts = _placed(step, window)
            may = _estimated(hashes, bits, size)
            yield part, step, hashes[:, may], of[may], start[may], counts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, hashes, of, start, _ in candidates(batches):
            first, own = _pieces(hashes, of, start)
            yield _rows(part, own, of[first], start[first])

    def among_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, hashes, of, start, counts in candidates(batches):
            begins = np.cumsum(counts) - counts
            first, _ = _pieces(hashes, of, start)
            kept = np.isin((begins[of] + start)[first], _listed(part, begins))
            inside = np.repeat(kept, np.diff(first, append=len(of))) & _first_inside(hashes, of)
            yield _rows(part, hashes[:, inside], of[inside], start[inside])

    kinds, own = "h1 long, h2 long, doc long, start long", ["doc", "version"]
    of_pieces = _firsts(texts.select(*own, "text").mapInArrow(cut, kinds))
    firsts = _firsts(texts.join(of_pieces, own).select(*own, "text", "starts").mapInArrow(among_first, kinds))
    common.forget(of_pieces)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, step, hashes, of, start, counts in candidates(batches):
            begins = np.cumsum(counts) - counts
            stays = _first_inside(hashes, of) & np.isin(begins[of] + start, _listed(part, begins))
            at, n = (begins[of] + start)[~stays], int(counts.sum()) + 1
            covered = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + window, minlength=n))[:-1] > 0
            kept = [_kept(text, covered[b : b + n]) for text, b, n in zip(step, begins.tolist(), counts.tolist())]
            away = np.add.reduceat(np.append(covered, False), begins) * (counts > 0) if len(counts) else counts
            yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), pa.array(counts), pa.array(away.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return texts.join(firsts, own, "left").select("doc_id", "text", "starts").mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _kept(text: bytes, covered: np.ndarray) -> bytes:
    """The words that aren't covered, joined by one space."""
    out, at = [], 0
    for piece in pieces(text):
        words = piece.split()
        own = covered[at : at + len(words)]
        out += words if not own.any() else [w for w, c in zip(words, own.tolist()) if not c]
        at += len(words)
    return b" ".join(out)


_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ')) AS h FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(s) WHERE len(w) >= {WINDOW}),
r AS (SELECT doc_id, s FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
c AS (SELECT DISTINCT doc_id, s + k AS i FROM r, range({WINDOW}) AS t(k)),
x AS (SELECT doc_id, w[i] AS word, i FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
k AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
