"""Literals of a table of any size, found in texts by an inverted index of rare grams.

A literal of LONG bytes or more and a text that holds it share the least hash of each WINDOW consecutive grams, so a text
gives two of nine grams for these and a literal need be looked up under one only, its rarest.  Shorter literals are looked
up under a gram of their own length, or of GRAM bytes.  What meets is verified on the whole text.

A table of up to HELD bytes goes to all tasks instead, and texts don't move: each place of a text is looked up by its next
bytes, and what begins alike is compared by sums over the literal's length, then byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.shared import cut_lineage

GRAM, WINDOW = 8, 8
LONG = GRAM + WINDOW - 1
LEAST = GRAM + 1  # the class of grams that are least of a window; 1 to GRAM are all grams of that many bytes
BLOCK = 1 << 20  # bytes of a text held as grams at once
BITS_EACH, MOST_BITS = 16, 27  # bits of the filter for a gram, and at most 2^27 (16 MiB), which bounds what is broadcast
HELD, MOST_HELD = 1 << 24, 1 << 18  # bytes and number of literals that are sent to all tasks
SLOTS = 18  # logarithm of the marks that spare most places of a text the look-up
HOT, SALTS = 1024, 64  # grams with 1/HOT of all postings, so HOT of them at most, are dealt to SALTS parts


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def grams(data: bytes, kind: int) -> np.ndarray:
    """Different keys of the grams of ``kind`` (a class, see above), ascending."""
    n = min(kind, GRAM)
    least = np.uint64((kind * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    found = [np.zeros(0, np.uint64)]
    for begin in range(0, len(data), BLOCK):
        part = np.frombuffer(data, np.uint8)[begin : begin + BLOCK + LONG - 1].astype(np.uint64)
        count = len(part) - n + 1
        if count <= 0:
            break
        values = reduce(lambda a, i: a << np.uint64(8) | part[i : i + count], range(n), np.zeros(count, np.uint64))
        keys = _mixed(values ^ least)
        if kind == LEAST:
            windows = count - WINDOW + 1
            if windows <= 0:
                break
            keys = reduce(np.minimum, [keys[i : i + windows] for i in range(WINDOW)])
        found.append(np.unique(keys))
    return np.unique(np.concatenate(found))


def _kind(literal: bytes) -> int:
    return LEAST if len(literal) >= LONG else min(len(literal), GRAM)


def _rows(batch: pa.RecordBatch, keys: Iterable[np.ndarray]) -> pa.RecordBatch:
    """The batch's columns but the last, once for each of a row's keys."""
    every = list(keys)
    at = np.repeat(np.arange(len(every)), [len(k) for k in every])
    flat = np.concatenate([np.zeros(0, np.uint64), *every]).view(np.int64)
    columns = [c.take(pa.array(at)) for c in batch.columns[:-1]]
    return pa.RecordBatch.from_arrays([*columns, pa.array(flat)], names=[*batch.schema.names[:-1], "__key"])


def _filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the keys at two places each, and the logarithm of their number."""
    wanted = keys.agg(F.approx_count_distinct("__key")).first()[0] * BITS_EACH
    size = min(MOST_BITS, max(15, int(wanted).bit_length()))
    places = F.array(F.col("__key").bitwiseAND(F.lit((1 << size) - 1)), F.shiftrightunsigned("__key", 64 - size))
    blocks = keys.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    bits = np.zeros(1 << size - 3, np.uint8)
    for block, part in blocks.collect():  # 16 MiB at most
        bits[block << 12 : block + 1 << 12] = np.frombuffer(bytes(part), np.uint8)
    return bits, size


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))  # of an odd number, so none vanishes


class Table:
    """Literals by their first bytes, GRAM at most."""

    def __init__(self, literals: list[bytes]) -> None:
        self.literals, self.long = literals, np.array([len(x) for x in literals], np.int64)
        self.most = int(self.long.max(initial=1))
        powers = _powers(self.most)
        data = [np.frombuffer(x, np.uint8).astype(np.uint64) for x in literals]
        self.sums = np.array([(x * powers[: len(x)]).sum() for x in data], np.uint64)
        self.kinds, kind = {}, np.minimum(self.long, GRAM)
        for n in np.unique(kind).tolist():
            own = np.flatnonzero(kind == n)
            first = np.array([int.from_bytes(literals[k][:n], "big") for k in own], np.uint64)
            order = np.argsort(first, kind="stable")
            values, begins = np.unique(first[order], return_index=True)
            likely = np.zeros(1 << SLOTS, bool)
            likely[self._slot(values)] = True
            self.kinds[n] = values, np.append(begins, len(own)), own[order], likely

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)

    def _places(self, data: bytes) -> dict[int, int]:
        """Where each literal that ``data`` holds is first."""
        part = np.frombuffer(data, np.uint8).astype(np.uint64)
        powers = _powers(len(part))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers)])
        found: dict[int, int] = {}
        padded = np.concatenate([part, np.zeros(GRAM - 1, np.uint64)])
        every = reduce(lambda a, i: a << np.uint64(8) | padded[i : i + len(part)], range(GRAM), np.zeros(len(part), np.uint64))
        for n, (values, begins, own, likely) in self.kinds.items():
            here = every >> np.uint64(8 * (GRAM - n))  # beyond the end zeros, which the lengths rule out
            places = np.flatnonzero(likely[self._slot(here)])
            at = np.minimum(np.searchsorted(values, here[places]), len(values) - 1)
            met = values[at] == here[places]
            places, at = places[met], at[met]
            each = begins[at + 1] - begins[at]
            literal = own[np.repeat(begins[at] - np.cumsum(each) + each, each) + np.arange(each.sum())]
            place = np.repeat(places, each)
            fits = place + self.long[literal] <= len(part)
            literal, place = literal[fits], place[fits]
            # sums from a place on have its power more than those of the literal itself
            same = sums[place + self.long[literal]] - sums[place] == self.sums[literal] * np.where(place > 0, powers[np.maximum(place, 1) - 1], np.uint64(1))
            for k, p in zip(literal[same].tolist(), place[same].tolist()):  # in the order of places
                if k not in found and data.startswith(self.literals[k], p):
                    found[k] = p
        return found

    def find(self, data: bytes) -> tuple[list[int], list[int]]:
        """Numbers of the literals that ``data`` holds, and their first places, in characters from 1."""
        found: dict[int, int] = {}
        for begin in range(0, len(data), BLOCK):
            found = {k: p + begin for k, p in self._places(data[begin : begin + BLOCK + self.most - 1]).items()} | found
        before = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
        return list(found), before[list(found.values())].tolist() if found else []


def _direct(rows: DataFrame, literals: list[str], ids: Sequence[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Table([x.encode() for x in literals]))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        names = pa.array([x.decode() for x in table.literals], pa.string())
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for low in range(0, len(texts), 256):
                found = [table.find(t.encode()) if t else ([], []) for t in texts[low : low + 256]]
                at = np.repeat(np.arange(low, low + len(found)), [len(k) for k, _ in found])
                numbers = [k for ks, _ in found for k in ks]
                columns = [c.take(pa.array(at)) for c in batch.columns[:-1]]
                columns += [names.take(pa.array(numbers, pa.int64())), pa.array([p for _, ps in found for p in ps], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*ids, "literal", "position"])

    schema = rows.drop("__text").schema
    renamed = rows.select(*[F.col(c).alias(n) for c, n in zip(schema.names, ids)], "__text")
    return renamed.mapInArrow(of_texts, renamed.drop("__text").schema.add("literal", "string").add("position", "integer"))


def find(texts: DataFrame, literals: DataFrame, ids: Sequence[str], text: str = "text", literal: str = "literal") -> DataFrame:
    """(ids, literal, position): each row of ``texts`` with each different literal that its text holds, and where first, from 1.

    Null and empty literals are in no text, and null texts hold none.  Rows that repeat an id, or have none, each give rows of
    their own.  All literals are found, however many and however frequent; the filter and the index only spare work.
    """
    own = literals.select(F.col(literal).cast("string").alias("__literal")).where("__literal <> ''").distinct()
    names = [f"__id{i}" for i in range(len(ids))]
    rows = texts.select(*[F.col(c).alias(n) for c, n in zip(ids, names)], F.col(text).cast("string").alias("__text"))
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("__literal")), F.lit(0)).alias("bytes")).first()
    if 0 < size["n"] <= MOST_HELD and size["bytes"] <= HELD:
        return _direct(rows, [r[0] for r in own.collect()], ids)

    def of_literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [v.encode() for v in batch.column(1).to_pylist()]
            yield _rows(batch, (grams(d, _kind(d)) for d in data))

    pair = own.select("__literal", F.col("__literal").alias("__text"))
    keys = cut_lineage(pair.mapInArrow(of_literals, "__literal string, __key long"))
    long = F.octet_length("__literal")
    kinds = sorted(r[0] for r in own.select(F.when(long >= LONG, LEAST).otherwise(F.least(long, F.lit(GRAM)))).distinct().collect())
    bits, size = _filter(keys)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def likely(found: np.ndarray) -> np.ndarray:
        low, high = found & np.uint64((1 << size) - 1), found >> np.uint64(64 - size)
        held = [shared.value[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 for p in (low, high)]
        return found[(held[0] & held[1]) == 1]

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                value = row.column(batch.num_columns - 1)[0].as_py()
                if value:
                    data = value.encode()
                    yield _rows(row, [np.concatenate([likely(grams(data, kind)) for kind in kinds])] if kinds else [np.zeros(0, np.uint64)])

    schema = rows.drop("__text").schema.add("__key", "long")
    postings = cut_lineage(rows.mapInArrow(of_texts, schema))
    counts = postings.groupBy("__key").agg(F.count("*").alias("__n"))
    total = postings.count()
    n = F.coalesce("__n", F.lit(0))
    rarest = keys.join(counts, "__key", "left").groupBy("__literal").agg(F.min(F.struct(n.alias("n"), F.col("__key").alias("key"))).alias("r")).where("r.n > 0").select("__literal", F.col("r.key").alias("__key"), (F.col("r.n") * HOT >= total).alias("__hot"))
    rarest = cut_lineage(rarest)
    hot = rarest.where("__hot").select("__key", "__hot").distinct()  # HOT rows at most
    dealt = postings.join(F.broadcast(hot), "__key", "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*names), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    asked = rarest.select("__literal", "__key", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("__salt"))
    met = dealt.join(asked, ["__key", "__salt"]).select(*names, "__literal").distinct()
    same = reduce(and_, [F.col(f"t.{c}").eqNullSafe(F.col(f"m.{c}")) for c in names])
    held = rows.alias("t").join(met.alias("m"), same & F.col("__text").contains(F.col("__literal")))
    return held.select(*[F.col(f"t.{x}").alias(c) for x, c in zip(names, ids)], F.col("__literal").alias("literal"), F.instr("__text", F.col("__literal")).alias("position"))
