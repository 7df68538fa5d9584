"""Whole-number vectors and the exact sums that Lloyd rounds over them need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components below this size (in absolute value) keep every distance and partial sum within 64 bits.
LARGEST = 1 << 15
#: Vectors that a task holds as arrays at a time.
STEP = 4096


def quantised(rows: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``q``: floor(scale * x) of each component as little-endian 32-bit integers, and ``dims``.

    Rows whose vector is null or empty, or has a null or non-finite component, go.  A component of LARGEST or more raises: its
    squared distance may not fit the results' longs.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)

    def number(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more")).cast("long")).cast("int")

    whole = kept.withColumn("__q", F.transform(vector, number))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<i4")
            q = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(q, pa.binary()), pa.array(np.diff(ends), pa.int32())], names=[*batch.schema.names[:-1], "q", "dims"])

    rest = [c for c in rows.columns if c != vector]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return whole.select(*rest, "__q").mapInArrow(packed, f"{kinds}, q binary, dims int" if rest else "q binary, dims int")


def steps(batches: Iterable[pa.RecordBatch], rows: int = STEP) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def matrix(batch: pa.RecordBatch, column: str = "q") -> np.ndarray:
    """The vectors of a batch, all of one length, as a matrix of longs."""
    values = batch.column(batch.schema.get_field_index(column)).to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.int64)


def nearest(q: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest centre; ties go to the lower index."""
    best, least = np.zeros(len(q), np.int64), None
    for k, centre in enumerate(centres):
        d = q - centre
        far = np.einsum("ij,ij->i", d, d)
        if least is None:
            least = far
        else:
            nearer = far < least
            best[nearer] = k
            least = np.where(nearer, far, least)
    return best, least


def summed(parts: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Sums of all other columns by ``keys``, a bounded number of groups that every one of ``tasks`` tasks may have.

    The sums are taken in two steps, so a key gets the square root of the tasks' rows at most, as decimals of 38 digits.
    """
    numbers = [c for c in parts.columns if c not in keys]
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).cast("decimal(38,0)").alias(c) for c in numbers]
    salted = parts.withColumn("__salt", F.spark_partition_id() % (isqrt(max(tasks, 1)) + 1))
    return salted.groupBy(*keys, "__salt").agg(*exact).groupBy(*keys).agg(*exact)


def floor_mean(total: list[int], count: int) -> list[int]:
    return [t // count for t in total]
