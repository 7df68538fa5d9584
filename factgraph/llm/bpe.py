"""Byte-level BPE: vectorised pre-tokenisation and cached pair merging.

Pre-tokenisation needs no regex.  Every code point maps to a class through an array that is learnt from the tokenizer
library itself (so Unicode versions agree); class plus a little lookahead gives a symbol; each symbol is a transition
function over eight states, and an associative scan composes those functions: blocks are composed side by side, a
doubling scan joins the blocks, and a second sweep replays each block from its known first state.  The state before a
character and its symbol tell whether a piece begins there.

Pieces are merged pair by pair in rank order and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import common

JSON_VOCABULARY = "byte_bpe_50k.json"
RANK_VOCABULARY = "byte_bpe_50k.tiktoken"

#: Between the texts of one step; no valid text holds a surrogate.
SEPARATOR = "\ud800"
#: A cache holds so many pieces, of so many bytes in all; longer ones than LONG_PIECE only while their step lasts.
CACHE_PIECES, CACHE_BYTES, LONG_PIECE = 450_000, 8 << 20, 256
#: Pieces up to so many bytes are merged side by side, so many at a time; longer ones with a heap.
SHORT = 48
GROUP_PIECES = 20_000
BLOCK = 64
NEVER = 1 << 62

OTHER, LETTER, NUMBER, SPACE, WHITE, END = range(6)
# Symbols: classes after lookahead.  *_LAST: white space before something that is not white space.
(S_OTHER, S_QUOTE, S_LETTER, S_ONE, S_TWO, S_NUMBER, S_SPACE, S_SPACE_LAST, S_WHITE, S_WHITE_LAST, S_END) = range(11)
# States: what is open before a character.
FRESH, LETTERS, NUMBERS, OTHERS, JOINING, BLANKS, QUOTED, QUOTED_MORE = range(8)


def _look_up(table: bytes, index: np.ndarray) -> np.ndarray:
    """``table[index]`` for bytes, by the interpreter's translation, which is several times as fast."""
    return np.frombuffer(index.tobytes().translate(table), np.uint8).reshape(index.shape)


@functools.lru_cache(1)
def _tables() -> tuple[bytes, bytes]:
    """next state and begins-a-piece, by symbol * 8 + state."""
    opened = {S_OTHER: OTHERS, S_QUOTE: QUOTED, S_LETTER: LETTERS, S_ONE: LETTERS, S_TWO: LETTERS, S_NUMBER: NUMBERS, S_SPACE: BLANKS, S_SPACE_LAST: JOINING, S_WHITE: BLANKS, S_WHITE_LAST: FRESH, S_END: FRESH}
    letters, others = {S_LETTER, S_ONE, S_TWO}, {S_OTHER, S_QUOTE}
    after, begins = np.zeros(256, np.uint8), np.ones(256, np.uint8)

    def joins(state: int, symbols: Iterable[int], to: int) -> None:
        for symbol in symbols:
            after[symbol * 8 + state], begins[symbol * 8 + state] = to, 0

    for symbol, to in opened.items():
        after[symbol * 8 : symbol * 8 + 8] = to
    joins(LETTERS, letters, LETTERS)
    joins(NUMBERS, {S_NUMBER}, NUMBERS)
    joins(OTHERS, others, OTHERS)
    joins(JOINING, letters, LETTERS)
    joins(JOINING, {S_NUMBER}, NUMBERS)
    joins(JOINING, others, OTHERS)
    joins(BLANKS, {S_SPACE, S_WHITE}, BLANKS)
    joins(QUOTED, {S_ONE}, FRESH)
    joins(QUOTED, {S_TWO}, QUOTED_MORE)
    joins(QUOTED_MORE, letters, FRESH)
    return after.tobytes(), begins.tobytes()


def _every_codepoint() -> str:
    return "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))


def _class_array(letters: str, numbers: str, blanks: str) -> np.ndarray:
    classes = np.zeros(0x110000, np.uint8)
    for found, kind in ((letters, LETTER), (numbers, NUMBER), (blanks, WHITE)):
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    classes[0x20], classes[ord(SEPARATOR)] = SPACE, END
    return classes


@functools.lru_cache(1)
def rank_library_classes() -> np.ndarray:
    """Code-point classes as the rank library's own regex engine has them: what it doesn't match, it drops."""
    import tiktoken

    def matched(pattern: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return bytes(probe.encode_ordinary(_every_codepoint())).decode()

    return _class_array(matched(r"\p{L}"), matched(r"\p{N}"), matched(r"\s"))


@functools.lru_cache(1)
def json_library_classes() -> np.ndarray:
    """The same from the other library: its splitter removes what doesn't match."""
    from tokenizers import Regex, pre_tokenizers

    everything = _every_codepoint()

    def matched(pattern: str) -> str:
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        return "".join(piece for piece, _ in split.pre_tokenize_str(everything))

    return _class_array(matched(r"\p{L}+"), matched(r"\p{N}+"), matched(r"\s+"))


_GIVEN: dict[str, np.ndarray] = {}


def classes_of(kind: str) -> np.ndarray:
    return _GIVEN[kind] if kind in _GIVEN else rank_library_classes() if kind == "ranks" else json_library_classes()


def broadcast_classes(spark: SparkSession, vocabulary: str):
    """Learning the classes takes seconds, so the driver does it once; an array of one byte for each code point."""
    return spark.sparkContext.broadcast(classes_of(kind_of(vocabulary)))


def use_classes(vocabulary: str, shared) -> None:
    """In a task: takes the driver's classes."""
    if kind_of(vocabulary) not in _GIVEN:
        _GIVEN[kind_of(vocabulary)] = shared.value


def kind_of(vocabulary: str) -> str:
    return "ranks" if vocabulary.endswith(".tiktoken") else "json"


def symbols_of(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``points`` ends with the separator."""
    kinds = classes[points]
    symbols = _look_up(bytes([S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_WHITE, S_END]).ljust(256), kinds).copy()
    blank_end = kinds >= SPACE
    last = (kinds == SPACE) | (kinds == WHITE)
    last[:-1] &= ~blank_end[1:]
    last[-1:] = False
    symbols[last] += 1
    quotes = np.flatnonzero(points[:-1] == ord("'"))
    if quotes.size:
        first = points[quotes + 1]
        second = points[np.minimum(quotes + 2, points.size - 1)]
        one = (first == ord("s")) | (first == ord("t")) | (first == ord("m")) | (first == ord("d"))
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        symbols[quotes[one | two]] = S_QUOTE
        symbols[quotes[one] + 1] = S_ONE
        symbols[quotes[two] + 1] = S_TWO
    return symbols


def states_before(symbols: np.ndarray) -> np.ndarray:
    """State before each symbol, by an associative scan over the symbols' transition functions."""
    after, _ = _tables()
    n = symbols.size
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, S_END, np.uint8)
    padded[:n] = symbols
    rows = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) << np.uint8(3)
    # each block as one function, all blocks and all first states side by side
    function = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1)).T.copy()  # [first state, block]
    for row in rows:
        function = _look_up(after, function | row)
    # doubling scan: function[:, b] becomes the composition of blocks 0..b
    step = 1
    while step < blocks:
        joined = function.copy()
        # first the earlier blocks, then these
        joined[:, step:] = np.take_along_axis(function[:, step:], function[:, :-step], 0)
        function, step = joined, step * 2
    state = np.empty(blocks, np.uint8)
    state[0], state[1:] = FRESH, function[FRESH, :-1]
    out = np.empty((BLOCK, blocks), np.uint8)
    for at, row in enumerate(rows):
        out[at] = state
        state = _look_up(after, state | row)
    return out.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces of separated texts (``points`` ends with a separator)."""
    _, begins = _tables()
    symbols = symbols_of(points, classes)
    edges = np.flatnonzero(_look_up(begins, symbols << np.uint8(3) | states_before(symbols)))
    is_piece = symbols[edges[:-1]] != S_END
    return edges[:-1][is_piece], edges[1:][is_piece]


def byte_places(points: np.ndarray) -> np.ndarray:
    """Where each code point begins in UTF-8, and one past the last."""
    sizes = np.ones(len(points), np.int8)
    for limit in (0x80, 0x800, 0x10000):
        sizes += points >= limit
    out = np.zeros(len(points) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


#: Odd numbers that mix a piece's bytes and length.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def distinct(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct slices of ``raw`` and which of them each slice is.

    Slices up to 16 bytes are two numbers, told apart by a mix of both that is checked afterwards; longer ones, and all
    in the unlikely case of a clash, by a dictionary.
    """
    import pandas as pd

    size = ends - begins
    numbers = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(17), strides=(1,))
    low = numbers[begins] & _MASKS[np.minimum(size, 8)]
    high = numbers[np.minimum(begins + 8, len(raw))] & _MASKS[np.clip(size - 8, 0, 8)]
    short = np.flatnonzero(size <= 16)
    low, high, length = low[short], high[short], size[short].astype(np.uint64)
    mixed = low * _MIX[0] ^ high * _MIX[1] ^ length * _MIX[2]
    codes, found = pd.factorize(mixed ^ mixed >> np.uint64(31))
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if not ((low[first][codes] == low) & (high[first][codes] == high) & (length[first][codes] == length)).all():
        short, first, codes = short[:0], first[:0], codes[:0]
    keys = [raw[a:b] for a, b in zip(begins[short[first]].tolist(), ends[short[first]].tolist())]
    inverse = np.empty(len(begins), np.int64)
    inverse[short] = codes
    rest = np.ones(len(begins), bool)
    rest[short] = False
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(rest).tolist():
        inverse[i] = others.setdefault(raw[begins[i] : ends[i]], len(keys) + len(others))
    return keys + list(others), inverse


@functools.lru_cache(1)
def printable() -> dict[str, int]:
    """The JSON file's characters for bytes: printable bytes are themselves, others count up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, and the pairs that merge: (left id, right id) -> (rank, merged id)."""

    def __init__(self, tokens: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool, classes: np.ndarray, special: dict[str, int]):
        self.tokens, self.whole, self.classes, self.special = tokens, whole, classes, special
        self.bytes_of: list[bytes] = [b""] * (max([*tokens.values(), *special.values()]) + 1)
        for token, i in tokens.items():
            self.bytes_of[i] = token
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.size = len(self.bytes_of)
        #: one object for each id, so that a large cache doesn't hold many
        self.names = list(range(self.size))
        self.byte_names = [self.names[tokens[bytes([b])]] for b in range(256)]
        self.pairs = pairs
        #: left * size + right -> rank * size + merged, which sorts as the rank does
        self.coded = {a * self.size + b: rank * self.size + merged for (a, b), (rank, merged) in pairs.items()}
        self.keys = np.array(sorted(self.coded), np.int64)
        self.values = np.array([self.coded[k] for k in self.keys.tolist()], np.int64)
        self.byte_array = np.array(self.byte_names, np.int64)
        self.byte_pairs = [self.coded.get(a * self.size + b, NEVER) for a in self.byte_names for b in self.byte_names]
        self.pair_array = np.array(self.byte_pairs, np.int64)

    @staticmethod
    @functools.lru_cache(2)
    def ranked(path: str) -> Vocabulary:
        """Ranks file: any two neighbours whose bytes together are a token merge, at that token's rank."""
        with open(path, "rb") as lines:
            tokens = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        pairs = {}
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                left, right = tokens.get(token[:cut]), tokens.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank, rank
        return Vocabulary(tokens, pairs, True, classes_of("ranks"), {})

    @staticmethod
    @functools.lru_cache(2)
    def from_json(path: str) -> Vocabulary:
        """JSON file: the listed merges, in their order; added tokens are found in texts before anything else."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        to_byte, model = printable(), data["model"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = {bytes(map(to_byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        ids = {t: i for t, i in model["vocab"].items()}
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs[ids[left], ids[right]] = rank, ids[left + right]
        return Vocabulary(tokens, pairs, bool(model.get("ignore_merges")), classes_of("json"), special)

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece with a heap: n log n for any length."""
        ids = [self.byte_names[b] for b in piece]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], at, ids[at], ids[at + 1]) for at in range(n - 1) if (found := pairs.get((ids[at], ids[at + 1])))]
        heapq.heapify(heap)
        while heap:
            _, at, left, right = heapq.heappop(heap)
            nxt = after[at] if ids[at] == left else n
            if nxt >= n or ids[nxt] != right:
                continue
            ids[at], ids[nxt] = pairs[left, right][1], -1
            after[at] = after[nxt]
            if after[at] < n:
                before[after[at]] = at
                if found := pairs.get((ids[at], ids[after[at]])):
                    heapq.heappush(heap, (found[0], at, ids[at], ids[after[at]]))
            if (prev := before[at]) >= 0 and (found := pairs.get((ids[prev], ids[at]))):
                heapq.heappush(heap, (found[0], prev, ids[prev], ids[at]))
        return [i for i in ids if i >= 0]

    def merge_short(self, piece: bytes) -> tuple[int, ...]:
        """A short piece: merges the first lowest-ranked pair until none is left."""
        coded, size, names = self.coded, self.size, self.names
        ids = [self.byte_names[b] for b in piece]
        found = [self.byte_pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        while found:
            best = min(found)
            if best == NEVER:
                break
            at = found.index(best)
            ids[at : at + 2] = (names[best % size],)
            del found[at]
            if at:
                found[at - 1] = coded.get(ids[at - 1] * size + ids[at], NEVER)
            if at < len(found):
                found[at] = coded.get(ids[at] * size + ids[at + 1], NEVER)
        return tuple(ids)


    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Short pieces, side by side in groups of like length; each round merges one pair of every piece that has one."""
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        out: list[tuple[int, ...]] = [()] * len(pieces)
        at = 0
        while at < len(order):
            width = len(pieces[order[at]])
            width += width // 4  # like lengths share a group
            end = at
            while end < len(order) and len(pieces[order[end]]) <= width and end - at < GROUP_PIECES:
                end += 1
            width = len(pieces[order[end - 1]])
            group = order[at:end]
            for i, ids in zip(group, self._merge_group([pieces[i] for i in group], width)):
                out[i] = ids
            at = end
        return out

    def _merge_group(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n, size = len(pieces), self.size
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        outside = np.arange(width) >= np.fromiter(map(len, pieces), np.int64, n)[:, None]
        ids = np.where(outside, -1, self.byte_array[raw])
        found = self.pair_array[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        found[outside[:, 1:]] = NEVER
        whole, where = np.full((n, width), -1, np.int64), np.arange(n)
        while ids.shape[1] > 1:
            best = found.argmin(1)
            row = np.arange(len(where))
            value = found[row, best]
            live = value < NEVER
            if not live.all():
                whole[where[~live], : ids.shape[1]] = ids[~live]
                where, ids, found, best, value = where[live], ids[live], found[live], best[live], value[live]
                row = row[: len(where)]
            if not len(where):
                break
            columns = np.arange(ids.shape[1] - 1)
            ids = np.where(columns <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids[row, best] = value % size
            found = np.where(columns[:-1] < best[:, None], found[:, :-1], found[:, 1:])
            for left in (best - 1, best):
                ok = (left >= 0) & (left < found.shape[1])
                r, c = row[ok], left[ok]
                keys = ids[r, c] * size + ids[r, c + 1]
                place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                found[r, c] = np.where((self.keys[place] == keys) & (ids[r, c + 1] >= 0), self.values[place], NEVER)
        whole[where, : ids.shape[1]] = ids
        inside = whole >= 0
        flat = list(map(self.names.__getitem__, whole[inside].tolist()))
        ends = np.cumsum(inside.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts, keeping the ids of pieces seen before: in two generations, the older of which goes when full."""

    def __init__(self, vocabulary: Vocabulary, cached: int = CACHE_PIECES):
        self.vocabulary, self.cached = vocabulary, cached
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}
        self.held, self.long = 0, []

    def split(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pieces of all texts, which of them each piece is, and each text's first piece (and one past the last)."""
        joined = SEPARATOR.join(texts) + SEPARATOR
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = piece_starts(points, self.vocabulary.classes)
        places = byte_places(points)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        keys, inverse = distinct(joined.encode("utf-8", "surrogatepass"), places[starts], places[ends])
        return keys, inverse, np.searchsorted(starts, begins)

    def pieces(self, text: str) -> list[str]:
        """Pieces of one text."""
        keys, inverse, _ = self.split([text])
        own = [k.decode() for k in keys]
        return [own[i] for i in inverse.tolist()]

    def learn(self, pieces: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The cache, with all of these; later calls may change generations."""
        new = set(pieces).difference(self.cache)
        if len(self.cache) + len(new) > self.cached or self.held > CACHE_BYTES:
            self.older, self.cache, self.held = self.cache, {}, 0
            new = set(pieces)
        long = [p for p in new if len(p) > LONG_PIECE]
        self.long += long
        self.held += sum(map(len, new)) - sum(map(len, long))
        vocabulary, cache = self.vocabulary, self.cache
        for piece in self.older.keys() & new:
            cache[piece] = self.older[piece]
            new.discard(piece)
        whole = vocabulary.tokens if vocabulary.whole else {}
        short = []
        for piece in new:
            if (one := whole.get(piece)) is not None:
                cache[piece] = (vocabulary.names[one],)
            elif len(piece) <= SHORT:
                short.append(piece)
            else:
                cache[piece] = tuple(vocabulary.merge_one(piece))
        cache.update(zip(short, vocabulary.merge_many(short)))
        return cache

    def trim(self) -> None:
        """Lets go of long pieces; between steps."""
        for piece in self.long:
            self.cache.pop(piece, None)
            self.older.pop(piece, None)
        self.long = []

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, without regard to special tokens, and where each text's begin (and one past the last)."""
        keys, inverse, firsts = self.split(texts)
        known = list(map(self.learn(keys).__getitem__, keys))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.int64, int(sizes.sum()))
        each = sizes[inverse]
        before = np.zeros(len(inverse) + 1, np.int64)
        np.cumsum(each, out=before[1:])
        begins = np.concatenate([[0], np.cumsum(sizes)])[inverse]
        return flat[np.repeat(begins - before[:-1], each) + np.arange(before[-1])], before[firsts]

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Ordinary stretches and special tokens of a text, leftmost and longest first."""
        special, out, at = self.vocabulary.special, [], 0
        if special:
            for m in re.finditer("|".join(map(re.escape, sorted(special, key=len, reverse=True))), text):
                out += [(text[at : m.start()], None)] * (m.start() > at) + [(m[0], special[m[0]])]
                at = m.end()
        return out + [(text[at:], None)] * (at < len(text) or not out)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        special = self.vocabulary.special
        plain = [t if not any(s in t for s in special) else "" for t in texts] if special else texts
        ids, bounds = self.encode_flat(plain) if texts else (np.zeros(0, np.int64), [0])
        for text, used, a, b in zip(texts, plain, bounds, bounds[1:]):
            yield ids[a:b].tolist() if used is text else self._with_special(text)

    def _with_special(self, text: str) -> list[int]:
        out: list[int] = []
        for part, token in self.segments(text):
            out += [token] if token is not None else self.encode_flat([part])[0].tolist()
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


#: Texts above so many characters are encoded in stretches, cut where a piece surely ends.
STRETCH = 1 << 20


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cuts before a blank that follows something else: no piece crosses that, and nothing after it looks back."""
    at, blank = 0, " \n\t\r"
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] in blank and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(2)
def encoder(kind: str, path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(Vocabulary.ranked(path) if kind == "ranks" else Vocabulary.from_json(path))


def encode_texts(coder: Encoder, texts: list[str]) -> Iterator[list[int]]:
    """As ``coder.encode`` for a step's texts, with very long ones in stretches."""
    coder.trim()
    if max(map(len, texts), default=0) <= STRETCH:
        yield from coder.encode(texts)
        return
    for text in texts:
        if len(text) <= STRETCH:
            yield from coder.encode([text])
            continue
        out: list[int] = []
        for segment, token in coder.segments(text):
            out += [token] if token is not None else chain.from_iterable(coder.encode_flat([part])[0].tolist() for part in stretches(segment))
        yield out


def encode(docs: DataFrame, text: str = "text", vocabulary: str = RANK_VOCABULARY, ids: str = "ids", ends: str = "token_ends") -> DataFrame:
    """Adds the token ids and, for decoding parts, the byte offset at which each token ends.

    Null and empty texts give empty arrays.  Names of new columns that are taken get an underscore.
    """
    ids, ends = common.fresh(docs, ids, ends)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(ends, T.ArrayType(T.LongType()))])

    shared = broadcast_classes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_classes(vocabulary, shared)
        coder = encoder(kind_of(vocabulary), common.tokenizer_path(vocabulary))
        lengths = np.array([len(b) for b in coder.vocabulary.bytes_of])
        for part, texts in common.steps(batches, text):
            found = [np.array(x, np.int64) for x in encode_texts(coder, texts)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([np.cumsum(lengths[x]) for x in found], pa.list_(pa.int64()))],
                names=[*part.schema.names, ids, ends],
            )

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", vocabulary: str = RANK_VOCABULARY, decoded: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids (null ids: null); ids outside the vocabulary raise."""
    (decoded,) = common.fresh(docs, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(decoded, T.BinaryType())])

    shared = broadcast_classes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_classes(vocabulary, shared)
        coder = encoder(kind_of(vocabulary), common.tokenizer_path(vocabulary))
        for batch in batches:
            out = [None if x is None else coder.decode(x) for x in common.column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, decoded])

    return docs.mapInArrow(run, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: str = RANK_VOCABULARY) -> DataFrame:
    """Per document: the ids' count and digest, and the digest of what they decode to (null text: empty)."""

    shared = broadcast_classes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        use_classes(vocabulary, shared)
        coder = encoder(kind_of(vocabulary), common.tokenizer_path(vocabulary))
        decimal = [str(i) for i in range(coder.vocabulary.size)].__getitem__
        for part, texts in common.steps(batches, "text"):
            counts, written, decoded = [], [], []
            for ids in encode_texts(coder, texts):
                counts.append(len(ids))
                written.append(sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                decoded.append(sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [common.column(part, "doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(written), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
