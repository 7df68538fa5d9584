"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.operators.shared import cut_lineage as cut_lineage
from factgraph.operators.shared import forget as forget

#: Texts that one step of a vectorised operator holds at a time.
STEP_BYTES = 2 << 20
STEP_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; resolved where the code runs, so executors use their own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def steps(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = STEP_BYTES, max_rows: int = STEP_ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Re-cuts Arrow batches so that a step holds few bytes of text; yields the slice and its texts (null: empty).

    A single text above ``max_bytes`` is a step of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        begin, held = 0, 0
        sizes = pc.binary_length(column).fill_null(0).to_pylist() if len(column) else []
        for at, size in enumerate(sizes):
            if at > begin and (held + size > max_bytes or at - begin >= max_rows):
                part = batch.slice(begin, at - begin)
                yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                begin, held = at, 0
            held += size
        if len(sizes) > begin:
            part = batch.slice(begin)
            yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def crc32_mod(id_column, modulus: int):
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(modulus)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Working names that clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that meets by shuffle even where it is small.

    A small side that Spark sends to all tasks is collected and built by the driver, a page of some megabytes each; of loops
    with many joins those pile up there.
    """
    return df.hint("merge")


#: A group with at least 1/HOT_SHARE of all rows is hot: there are at most HOT_SHARE of them.
HOT_SHARE = 1 << 10


def join_owners(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``owners`` has for their key: one row, or none.

    The owners of hot keys, HOT_SHARE rows at most, are broadcast, so that no task gets all rows of such a key.
    """
    mark = "__hot"
    sizes = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = rows.count()
    hot = F.broadcast(sizes.where(F.col("n") * HOT_SHARE >= max(total, 1)).select(key))
    some = rows.join(hot.withColumn(mark, F.lit(True)), key, "left")
    of_hot = owners.join(hot, key, "left_semi")
    return some.where(F.col(mark)).drop(mark).join(F.broadcast(of_hot), key, "left").unionByName(some.where(F.col(mark).isNull()).drop(mark).join(owners, key, "left"))


def keep_rows(docs: DataFrame, kept: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of the text) is in ``kept``, and those without an id.

    Of several rows of the same id and text one stays, the least by a hash of all columns.
    """
    version, wanted, other, rank = fresh(docs, "version", "wanted", "other", "rank")
    named = docs.withColumn(version, F.xxhash64(text))
    met = named.join(kept.select(F.col("doc_id").alias(wanted), F.col("version").alias(other)), (F.col(wanted) == named["doc_id"].cast("long")) & (F.col(other) == F.col(version)))
    ranked = met.withColumn(rank, F.row_number().over(Window.partitionBy(wanted, other).orderBy(F.xxhash64(*[named[c] for c in docs.columns]))))
    return ranked.where(F.col(rank) == 1).select(*[named[c] for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
