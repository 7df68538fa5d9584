"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius.  Two fingerprints within the radius share a
variant, and fingerprints that share one are within the radius; so in each variant's group (at most as many members as
the ball has) every member links to the smallest, which keeps all connections without all pairs.  Links are
deduplicated, verified, and joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm import bpe, common
from factgraph.llm.components import components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Shingles whose bits are summed at a time, and characters whose words are held at a time.
BLOCK = 1 << 15
STRETCH = 1 << 21


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64 bits: a bit is 1 if it is set in over half the shingles' hashes; no words: 0."""
    n, set_bits, carried = 0, np.zeros(64, np.int64), []
    for part in bpe.stretches(text, STRETCH):  # no word is cut; the last words go on to the next stretch
        words = carried + part.encode().lower().split()  # of bytes: ASCII only, as wanted
        found = len(words) - shingle_words + 1
        if found > 0:
            n, set_bits = n + found, set_bits + _set_bits(words, found, seed)
        carried = words[-(shingle_words - 1) :] if shingle_words > 1 else []
        if not n:
            carried = words
    if not n and carried:
        n, set_bits = 1, _set_bits(carried, 1, seed)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0]) if n else 0


def _set_bits(words: list[bytes], n: int, seed: int) -> np.ndarray:
    """How often each bit is set in the hashes of the first n shingles, which all words together make."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    begins, ends, out = starts[:n].tolist(), ends[-n:].tolist(), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(begins[at : at + BLOCK], ends[at : at + BLOCK])
        hashes = np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in pairs], "<u8", min(BLOCK, n - at))
        out += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, version, fp), fp as a signed long, version a hash of the text as it is; null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.steps(batches, "text"):
            found = np.array([fingerprint(t, shingle_words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([common.column(part, "doc_id"), common.column(part, "version"), pa.array(found)], names=["doc_id", "version", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.withColumn("version", F.xxhash64("text")).mapInArrow(run, "doc_id long, version long, fp long")


def ball(radius: int) -> list[int]:
    """Masks of up to so many bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp) that differ in 1 to ``radius`` bits; connects all such, by stars."""
    if radius % 2:
        raise ValueError("the radius must be even: members of a variant's group are within twice half of it")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    near = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    pairs = near.where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like others.  A component's id is its smallest doc_id;
    null ids are passed over, and a component of such rows only has none.  An empty table gives no rows.
    """
    return _owned(docs, shingle_words, radius, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def _owned(docs: DataFrame, shingle_words: int, radius: int, seed: int) -> DataFrame:
    """(doc_id, version, fp, first) of each row: ``first`` is the least (doc_id, version) of its component."""
    prints = common.cut_lineage(fingerprints(docs, shingle_words, seed))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "version"))).alias("first")
    classes = common.cut_lineage(prints.groupBy("fp").agg(first))
    roots = components(links(classes.select("fp"), radius))
    linked = common.cut_lineage(classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "first"))
    least = linked.groupBy("root").agg(F.min("first").alias("of_all"))
    owned = linked.join(least, "root").select("fp", "of_all")
    owners = classes.join(owned, "fp", "left").select("fp", F.coalesce("of_all", "first").alias("first"))
    return common.join_owners(prints, owners, "fp")


def deduplicate(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of its smallest id (and least text) stays.

    Of rows of the same id and text one stays; rows without an id are no group's member and stay.
    """
    found = _owned(docs.where("doc_id IS NOT NULL"), shingle_words, radius, seed)
    return common.keep_rows(docs, found.where(F.struct("doc_id", "version") == F.col("first")).select("doc_id", "version").distinct())
