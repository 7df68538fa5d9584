"""Exact token counts at every prefix of a text, by dynamic programming.

A BPE encoding is known from its last token: the encoding of a prefix ends in the one token that may follow the last
token of what stands before it ("may follow": the two tokens' bytes encode to just these two).  So one pass over a
piece finds, for each prefix, the last token and ``count = count before it + 1``.  Pieces of a text are encoded
separately; a prefix that ends in a piece counts the pieces before it and the piece's own prefix.  Two places need care,
because pre-tokenisation looks ahead: white space at the end of a prefix is one piece whatever follows it in the text,
and a cut contraction is an apostrophe and letters.

The stored counts answer "how many tokens have the first n characters" and "how many characters fit" without encoding.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import bpe, common

TOKEN_LIMIT = 512
PAIRS_KEPT = 1_000_000
CONTRACTIONS = frozenset({"'s", "'t", "'m", "'d", "'re", "'ve", "'ll"})


class PrefixCounter:
    """Prefix counts of pieces (cached) and texts for one vocabulary."""

    def __init__(self, vocabulary: bpe.Vocabulary, cached: int = bpe.CACHE_PIECES):
        self.vocabulary, self.cached = vocabulary, cached
        self.coder = bpe.Encoder(vocabulary)
        self.tables: dict[str, bytes | array] = {}
        self.older: dict[str, bytes | array] = {}
        self.held, self.long = 0, []
        self.follows: dict[int, bool] = {}
        #: byte -> [token that ends here or -1, the same for the bytes after it]
        self.trie: dict[int, list] = {}
        for token, i in vocabulary.tokens.items():
            below, node = self.trie, None
            for byte in token:
                node = below.setdefault(byte, [-1, {}])
                below = node[1]
            node[0] = vocabulary.names[i]

    def _encodes_to(self, raw: bytes, ids: tuple[int, ...]) -> bool:
        whole = self.vocabulary.tokens.get(raw) if self.vocabulary.whole else None
        return ((whole,) if whole is not None else self.vocabulary.merge_short(raw)) == ids

    def _may_follow(self, left: int, right: int) -> bool:
        key = left * self.vocabulary.size + right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) >= PAIRS_KEPT:
                self.follows.clear()
            names = self.vocabulary.bytes_of
            known = self.follows[key] = self._encodes_to(names[left] + names[right], (left, right)) if left >= 0 else self._encodes_to(names[right], (right,))
        return known

    def byte_counts(self, raw: bytes) -> list[int]:
        """Token count of every byte prefix of a piece, the empty one included."""
        n, size, follows = len(raw), self.vocabulary.size, self.follows.get
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for begin in range(n):  # what ends here is known by now
            below, left, count = self.trie, last[begin], counts[begin] + 1
            for end in range(begin, n):
                node = below.get(raw[end])
                if node is None:
                    break
                token, below = node
                if token >= 0 and last[end + 1] < 0:
                    ok = follows(left * size + token)
                    if ok or ok is None and self._may_follow(left, token):
                        last[end + 1], counts[end + 1] = token, count
        return counts

    def piece(self, piece: str) -> bytes | array:
        """Token count of the piece's first 1, 2, ... characters."""
        table = self.tables.get(piece)
        if table is None:
            if piece in CONTRACTIONS:
                counts = [1, 2][: len(piece) - 1] + [self.byte_counts(piece.encode())[-1]]
            else:
                raw = piece.encode()
                counts = self.byte_counts(raw)
                if len(raw) == len(piece):
                    counts = counts[1:]
                else:
                    counts = [counts[at] for at in range(1, len(raw) + 1) if at == len(raw) or raw[at] & 0xC0 != 0x80]
            table = self.tables[piece] = bytes(counts) if max(counts) < 256 else array("I", counts)
        return table

    def learn(self, pieces: list[str]) -> dict[str, bytes | array]:
        """Tables that have all of these; later calls may change generations, so callers keep what they get."""
        new = set(pieces).difference(self.tables)
        if len(self.tables) + len(new) > self.cached or self.held > bpe.CACHE_BYTES:
            self.older, self.tables, self.held = self.tables, {}, 0
            new = set(pieces)
        long = [p for p in new if len(p) > bpe.LONG_PIECE]
        self.long += long
        self.held += sum(map(len, new)) - sum(map(len, long))
        for piece in self.older.keys() & new:
            self.tables[piece] = self.older[piece]
            new.discard(piece)
        for piece in new:
            self.piece(piece)
        return self.tables

    def trim(self) -> None:
        """Lets go of long pieces; between steps."""
        self.coder.trim()
        for piece in self.long:
            self.tables.pop(piece, None)
            self.older.pop(piece, None)
        self.long = []

    def _blank(self, piece: str) -> bool:
        return self.vocabulary.classes[ord(piece[-1])] in (bpe.SPACE, bpe.WHITE)

    def _piece_prefixes(self, pieces: list[str], at: int, before: np.ndarray, tables: dict) -> np.ndarray:
        """Counts of the text's prefixes that end in piece ``at``; before[i]: tokens before piece i."""
        counts = before[at] + np.frombuffer(tables[pieces[at]], np.uint8 if isinstance(tables[pieces[at]], bytes) else np.uint32).astype(np.int64)
        first = pieces[at][0]
        if at and self.vocabulary.classes[ord(first)] in (bpe.SPACE, bpe.WHITE) and self._blank(pieces[at - 1]):
            counts[0] = before[at - 1] + self.byte_counts((pieces[at - 1] + first).encode())[-1]
        return counts

    @staticmethod
    def _text_counts(pieces: list[str], tables: dict) -> np.ndarray:
        before = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([tables[p][-1] for p in pieces], out=before[1:])
        return before

    def totals(self, texts: list[str], budget: int) -> Iterator[tuple[int, int]]:
        """Of each text: its token count, and how many characters have at most ``budget`` tokens."""
        special = self.vocabulary.special
        keys, inverse, firsts = self.coder.split([t if not any(s in t for s in special) else "" for t in texts])
        keys = [k.decode() for k in keys]
        tables, firsts = self.learn(keys), firsts.tolist()
        sums = np.concatenate([[0], np.cumsum(np.array([tables[k][-1] for k in keys], np.int64)[inverse])])
        for k, text in enumerate(texts):
            a, b = firsts[k], firsts[k + 1]
            if text and a == b:
                counts = self.prefixes(text)
                yield int(counts[-1]), int(np.flatnonzero(counts <= budget)[-1])
                continue
            total = int(sums[b] - sums[a])
            yield total, len(text) if total <= budget else self._fits([keys[i] for i in inverse[a : min(b, a + budget + 2)].tolist()], budget, tables)

    def _fits(self, pieces: list[str], budget: int, tables: dict) -> int:
        """Characters of the longest prefix within the budget, given that the whole is beyond it."""
        before = self._text_counts(pieces, tables)
        at = int(np.searchsorted(before[:-1], budget, "left")) - 1  # the last piece with fewer tokens before it
        for i in range(min(at + 1, len(pieces) - 1), -1, -1):
            fitting = np.flatnonzero(self._piece_prefixes(pieces, i, before, tables) <= budget)
            if fitting.size:
                return sum(map(len, pieces[:i])) + int(fitting[-1]) + 1
        return 0

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the first 0, 1, ..., all characters of a text."""
        out, base = [np.zeros(1, np.int64)], 0
        parts = self.coder.segments(text)
        for k, (part, token) in enumerate(parts):
            if token is None:
                pieces = self.coder.pieces(part)
                tables = self.learn(pieces)
                before = self._text_counts(pieces, tables)
                out += [base + self._piece_prefixes(pieces, i, before, tables) for i in range(len(pieces))]
                base += int(before[-1])
            else:  # cut, it is ordinary text that continues what stands before it
                held = parts[k - 1][0] if k and parts[k - 1][1] is None else ""
                below = base - (sum(map(len, self.coder.encode([held]))) if held else 0)
                cut = [below + len(next(self.coder.encode([held + part[:n]]))) for n in range(1, len(part))]
                base += 1
                out.append(np.array([*cut, base], np.int64))
        return np.concatenate(out)


@functools.lru_cache(2)
def counter(kind: str, path: str) -> PrefixCounter:
    return PrefixCounter(bpe.Vocabulary.ranked(path) if kind == "ranks" else bpe.Vocabulary.from_json(path))


def _counter(vocabulary: str) -> PrefixCounter:
    return counter(bpe.kind_of(vocabulary), common.tokenizer_path(vocabulary))


def prefix_counts(docs: DataFrame, text: str = "text", vocabulary: str = bpe.JSON_VOCABULARY, counts: str = "prefix_tokens") -> DataFrame:
    """Adds the token count of every prefix: element n + 1 is that of the first n characters (null text: empty)."""
    (counts,) = common.fresh(docs, counts)
    schema = T.StructType([*docs.schema.fields, T.StructField(counts, T.ArrayType(T.IntegerType()))])

    shared = bpe.broadcast_classes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.use_classes(vocabulary, shared)
        known = _counter(vocabulary)
        for part, texts in common.steps(batches, text):
            known.trim()
            found = pa.array([known.prefixes(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, counts])

    return docs.mapInArrow(run, schema)


def tokens_of_prefix(counts: Column, characters: Column | int) -> Column:
    """Tokens of the first so many characters, from stored counts."""
    n = characters if isinstance(characters, Column) else F.lit(characters)
    return F.element_at(counts, F.least(F.greatest(n, F.lit(0)) + 1, F.size(counts)))


def characters_within(counts: Column, budget: int) -> Column:
    """Length of the longest prefix with at most ``budget`` tokens, from stored counts."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= F.lit(budget), i).otherwise(F.lit(0))))


TOTALS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"


def totals(docs: DataFrame, vocabulary: str = bpe.JSON_VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per document (null text: empty): bytes, tokens, whether beyond the limit, and the characters that fit it.

    Equal texts and equal ids stay separate rows; an empty table gives none.
    """

    shared = bpe.broadcast_classes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.use_classes(vocabulary, shared)
        known = _counter(vocabulary)
        for part, texts in common.steps(batches, "text"):
            found = []
            known.trim()
            for text, counted in zip(texts, known.totals([t if len(t) <= bpe.STRETCH else "" for t in texts], limit)):
                found.append(counted if len(text) <= bpe.STRETCH else _long_totals(known, text, limit))
            tokens = np.array([n for n, _ in found], np.int64)
            sizes = pc.binary_length(common.column(part, "text")).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [common.column(part, "doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit), pa.array([c for _, c in found], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOTALS)


def _long_totals(known: PrefixCounter, text: str, limit: int) -> tuple[int, int]:
    """As ``PrefixCounter.totals`` for one very long text, a stretch at a time.

    No prefix within the limit is longer than so many of the longest tokens, so the cut is found in the text's beginning.
    """
    total = 0
    for segment, token in known.coder.segments(text):
        total += 1 if token is not None else sum(next(known.totals([part], limit))[0] for part in bpe.stretches(segment))
    if total <= limit:
        return total, len(text)
    longest = max(map(len, known.vocabulary.bytes_of))
    return total, next(known.totals([text[: (limit + 2) * longest]], limit))[1]
