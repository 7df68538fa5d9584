"""A Bloom filter of a key set, as bitmaps, so that only likely rows are shuffled.

A key has one block of 32,768 bits and sets PROBES bits in it, so a row is tested by one join with the blocks.  Blocks are
built by partial aggregates; their number follows the keys' count up to MOST blocks (16 MiB), which bounds what is broadcast.
Beyond that more rows pass, and none is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, PROBES, EACH, MOST = 1 << 15, 4, 12, 1 << 12


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")


def _place(keys: Sequence[str], probe: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe + 1), *keys), F.lit(BITS)).cast("int")


def build(targets: DataFrame, keys: Sequence[str], most: int = MOST) -> tuple[DataFrame, int]:
    """((block, bits), number of blocks); ``keys`` of ``targets``, nulls left out."""
    n = targets.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    blocks = max(1, min(most, -(-n * EACH // BITS)))
    kept = targets.select(*keys).dropna()
    bits = kept.select(_block(keys, blocks).alias("block"), F.explode(F.array(*[_place(keys, p) for p in range(PROBES)])).alias("place"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits")), blocks


def likely(rows: DataFrame, keys: Sequence[str], filter_: tuple[DataFrame, int], mark: str = "likely") -> DataFrame:
    """``rows`` with ``mark``: false where no target has their keys, which is certain; nulls have none."""
    built, blocks = filter_

    def held(probe: int) -> Column:
        place = _place(keys, probe)
        byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, place.bitwiseAND(7)) == 1

    met = rows.withColumn("__block", _block(keys, blocks)).join(F.broadcast(built.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))), "__block", "left")
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return met.withColumn(mark, known & F.col("__bits").isNotNull() & F.coalesce(reduce(and_, [held(p) for p in range(PROBES)]), F.lit(False))).select(*rows.columns, mark)


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``; rows that the filter excludes don't move."""
    marked = likely(left, keys, build(right, keys), "__likely")
    sure, rest = marked.where("NOT __likely").drop("__likely"), marked.where("__likely").drop("__likely")
    return sure.unionByName(rest.join(right.select(*keys).distinct(), list(keys), "left_anti"))
