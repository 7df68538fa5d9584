"""Cost-balanced packing of token ids into sequences.

A document's ids (with an end id) give full sequences first.  What is left of each document goes to a window of bounded
size in its task.  A window opens as many sequences as its tokens fill exactly: full ones, and for the rest ones of
power-of-two lengths, so nothing is padded.  Estimated cost of n tokens in one document's piece is linear plus quadratic
(attention within the piece); pieces are taken in descending order and each goes to the sequence of the lowest cost that
still has room for it.  A piece that no sequence can hold whole is cut: it fills up the sequence of the lowest cost that
has any room, and so on.

Ids are those of the JSON vocabulary, but come from the rank library, which is several times as fast: before anything is
packed, the driver holds the two files' tokens and merges against each other, and the special tokens' strings and ids are
read from the JSON file and looked for first, as its library does.  Texts with a very long run without a break go to :mod:`factgraph.llm.bpe`, as the library's
time grows with the square of a run.

Nothing is shuffled: windows follow the input's own partitions, so a hot source or key can't gather in one task.
"""

from __future__ import annotations

import base64
import functools
import json
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import bpe, common

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Tokens of document rests that a window holds.
WINDOW_TOKENS = 1 << 21
#: Cost of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 2048.0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def cost(n: float, quadratic: float = QUADRATIC) -> float:
    return n + n * n / quadratic


def rooms_for(tokens: int, size: int) -> list[int]:
    """Lengths of sequences that so many tokens fill exactly."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], size: int = SEQUENCE_TOKENS, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, begin in it, length, sequence, offset there) for pieces of these lengths; ties go to the first."""
    room = np.array(rooms_for(sum(lengths), size), np.int64)
    spent, used, out = np.zeros(len(room)), np.zeros(len(room), np.int64), []

    def put(piece: int, begin: int, n: int, at: int) -> None:
        out.append((piece, begin, n, at, int(used[at])))
        used[at] += n
        room[at] -= n
        spent[at] += cost(n, quadratic)

    cut = []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[piece]
        at = int(np.where(room >= n, spent, np.inf).argmin())
        if room[at] >= n:
            put(piece, 0, n, at)
        else:
            cut.append(piece)
    for piece in cut:
        begin = 0
        while begin < lengths[piece]:
            at = int(np.where(room > 0, spent, np.inf).argmin())
            n = min(lengths[piece] - begin, int(room[at]))
            put(piece, begin, n, at)
            begin += n
    return out


#: Runs of that many characters without a break are too long for the rank library.
LONG_RUN = 2048


@functools.lru_cache(2)
def _library(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_pattern(), mergeable_ranks=ranks, special_tokens={})


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def has_long_run(text: str) -> bool:
    if len(text) < LONG_RUN:
        return False
    words = text.split()
    return max(map(len, words), default=0) >= LONG_RUN or len(text) - sum(map(len, words)) - len(words) >= LONG_RUN


def text_ids(text: str, library, special: dict[str, int], coder: Callable[[], bpe.Encoder]) -> Iterator[np.ndarray]:
    """The text's ids in blocks."""
    parts = [text]
    for token in special:
        if token in text:
            parts = [x for part in parts for x in (part.split(token) if part not in special else [part])]
            parts = [x for i, part in enumerate(parts) for x in ((token, part) if i else (part,))]
    for part in parts:
        if part in special:
            yield np.array([special[part]], "<u4")
            continue
        for stretch in bpe.stretches(part):
            ids = next(coder().encode([stretch])) if has_long_run(stretch) else library.encode_ordinary(stretch)
            yield np.frombuffer(array("I", ids), "<u4")


class _Packer:
    """Rows of one task."""

    def __init__(self, size: int, window: int, quadratic: float, part: int):
        self.size, self.window, self.quadratic = size, window, quadratic
        self.sequence = part << 40
        self.rows: list[tuple] = []
        self.rests: list[tuple] = []
        self.held = 0

    def add(self, doc_id: int | None, blocks: Iterator[np.ndarray]) -> None:
        """A document, its ids in blocks."""
        full, held, start = [], np.zeros(0, "<u4"), 0
        for block in blocks:
            held = np.concatenate([held, block]) if held.size else block
            whole = held.size // self.size * self.size
            for at in range(0, whole, self.size):
                full.append((start + at, crc32(held[at : at + self.size].tobytes())))
            start, held = start + whole, held[whole:]
        total = start + held.size
        for begin, digest in full:
            self.rows.append((doc_id, begin, self.size, digest, total, self.sequence, 0, self.size))
            self.sequence += 1
        if held.size:
            self.rests.append((doc_id, start, held.copy(), total))
            self.held += held.size

    def flush(self) -> None:
        lengths = [rest[2].size for rest in self.rests]
        rooms = rooms_for(sum(lengths), self.size)
        for piece, begin, n, at, offset in assign(lengths, self.size, self.quadratic):
            doc_id, start, ids, total = self.rests[piece]
            self.rows.append((doc_id, start + begin, n, crc32(ids[begin : begin + n].tobytes()), total, self.sequence + at, offset, rooms[at]))
        self.sequence += len(rooms)
        self.rests, self.held = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])


@functools.lru_cache(2)
def special_tokens(vocabulary: str, ranks: str) -> dict[str, int]:
    """Special tokens of the JSON vocabulary; ValueError if the ranks file has other tokens or merges others first."""
    path, other = common.tokenizer_path(vocabulary), common.tokenizer_path(ranks)
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    with open(other, "rb") as lines:
        ranked = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    plain = {t: i for t, i in data["model"]["vocab"].items() if t not in special}
    to_byte = bpe.printable()
    if {bytes(map(to_byte.__getitem__, t)): i for t, i in plain.items()} != ranked:
        raise ValueError(f"{ranks} has other tokens than {vocabulary}")
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
    if [plain[m] for m in merged] != sorted(plain[m] for m in merged):
        raise ValueError(f"{vocabulary} doesn't merge in the order of its ids")
    return special


def pack(docs: DataFrame, vocabulary: str = bpe.JSON_VOCABULARY, ranks: str = bpe.RANK_VOCABULARY, size: int = SEQUENCE_TOKENS, end_id: int = END_ID, window: int = WINDOW_TOKENS, quadratic: float = QUADRATIC) -> DataFrame:
    """One row for each piece: where it is in its document and in its sequence.

    Null and empty texts have just the end id; repeated rows are packed each; null ids stay null; an empty table gives
    no rows.  ``sequence_id`` is unique; its upper part is the task's partition, so it follows how the input is split.
    """

    special = special_tokens(vocabulary, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = common.tokenizer_path(ranks)
        library, end = _library(path), np.array([end_id], "<u4")
        coder = functools.lru_cache(1)(lambda: bpe.encoder("ranks", path))
        packer = _Packer(size, window, quadratic, TaskContext.get().partitionId())
        for part, texts in common.steps(batches, "text"):
            for doc_id, text in zip(common.column(part, "doc_id").to_pylist(), texts):
                blocks = chain(text_ids(text, library, special, coder), [end])
                packer.add(doc_id, blocks)
                if packer.held >= packer.window:
                    packer.flush()
            if packer.rows:
                yield packer.take()
        packer.flush()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
