"""Product codes of vectors by Lloyd rounds that are maintained by differences.

Vectors are cut into PARTS equal parts, each with a codebook of its own.  What persists between rounds is each vector's
code (written with it to the checkpoint folder) and, for every codebook entry, the running integer sum and number of its
parts.  A round assigns all parts in place and shuffles only the plus and minus contributions of those whose entry
changed, pre-aggregated in each task; sums of whole numbers are exact, so the maintained ones equal those taken anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import common, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def _seeds(state: DataFrame, entries: int, parts: int) -> list[list[list[int]]]:
    """By part and entry the components of the vectors of smallest ids; fewer vectors, fewer entries."""
    first = state.where("vec_id IS NOT NULL").select("vec_id", "q").orderBy("vec_id", "q").limit(entries).collect()
    rows = [np.frombuffer(r["q"], "<i4").reshape(parts, -1).tolist() for r in first]
    return [[row[p] for row in rows] for p in range(parts)]


def _assigned(state: DataFrame, books: list, parts: int) -> DataFrame:
    """``state`` with ``before``: its ``code``, and ``code``: the entries that are nearest now, a byte for each part."""
    centres = [np.array(book, np.int64) for book in books]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.steps(batches):
            q = vectors.matrix(batch).reshape(batch.num_rows, parts, -1)
            found = [vectors.nearest(q[:, p], centres[p]) for p in range(parts)]
            codes = np.stack([best for best, _ in found], 1).astype(np.uint8)
            error = sum(far for _, far in found)
            old = [*batch.columns[:4]]
            yield pa.RecordBatch.from_arrays([*old, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "q", "before", "code", "error"])

    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("vec_id", "label", "q"))
    return state.select("vec_id", "label", "q", F.col("code").alias("before")).mapInArrow(run, f"{kinds}, before binary, code binary, error long")


def _differences(state: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): what the parts whose entry changed add to sums and numbers, a row for each task and
    entry at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = {}  # at most parts * 256 rows
        for batch in vectors.steps(batches):
            q = vectors.matrix(batch).reshape(batch.num_rows, parts, width)
            after = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            known = np.array([b is not None for b in batch.column(1).to_pylist()])
            before = np.zeros_like(after)
            before[known] = np.frombuffer(b"".join(b for b in batch.column(1).to_pylist() if b is not None), np.uint8).reshape(-1, parts)
            changed = (before != after) | ~known[:, None]
            for p in range(parts):
                for sign, codes, rows in ((1, after, changed[:, p]), (-1, before, changed[:, p] & known)):
                    for entry in np.unique(codes[rows, p]).tolist():
                        own = q[rows & (codes[:, p] == entry), p]
                        total = held.setdefault((p, entry), [0] * (1 + width))
                        for k, value in enumerate([len(own), *own.sum(0).tolist()]):
                            total[k] += sign * value
        rows = [(*key, *total) for key, total in held.items()]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * (1 + width)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    moved = state.where("before IS NULL OR before <> code").select("q", "before", "code")
    return moved.mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"s{k} long" for k in range(width)))


def digest(books: list) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for rows of (vec_id, embedding, label).

    ``code`` has two hex digits for each part; ``error`` is the squared distance over all parts, ``label_error`` its sum over
    equal labels, nulls together.  Vectors that are null or hold null or non-finite components go, and so do those of another
    length than the vector of the smallest id (null ids count last), or, if that can't be cut evenly, all.  Codebooks start
    from the ``entries`` smallest ids (of one id by its components), null ids never among them; fewer vectors give fewer
    entries.  Repeated rows count each.  A round in which nothing changes ends the rounds, as no later one would differ.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: from 1 to 256, as a code's byte holds one")
    spark = rows.sparkSession
    read = vectors.quantised(rows.select("vec_id", "embedding", "label"), scale)
    first = read.select("dims", "vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(1).collect()
    dims = first[0]["dims"] if first else 0
    even = dims if dims and dims % parts == 0 and first[0]["vec_id"] is not None else -1
    state = common.cut_lineage(read.where(F.col("dims") == even).select("vec_id", "label", "q", F.lit(None).cast("binary").alias("code")))
    books, width, tasks = _seeds(state, entries, parts), max(even, 0) // parts, state.rdd.getNumPartitions()
    sums = [[[0] * width for _ in book] for book in books]
    counts = [[0] * len(book) for book in books]
    for _ in range(rounds if books[0] else 0):
        old, state = state, common.cut_lineage(_assigned(state, books, parts))
        common.forget(old)
        moved = vectors.summed(_differences(state, parts, width), ["part", "entry"], tasks).collect()  # parts * entries rows at most
        for r in moved:
            p, e = r["part"], r["entry"]
            counts[p][e] += int(r["n"])
            sums[p][e] = [s + int(r[f"s{k}"]) for k, s in enumerate(sums[p][e])]
        if not moved:
            break
        books = [[vectors.floor_mean(sums[p][e], counts[p][e]) if counts[p][e] else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]
    out = _assigned(state, books, parts).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("__label"))
    old, out = state, common.cut_lineage(out)
    common.forget(old)
    by_label = out.groupBy("__label").agg(F.sum("error").alias("label_error"))
    return common.join_owners(out, by_label, "__label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by plain rounds over all parts; no differences are kept."""
    steps = [
        f"q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale}.0 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS s FROM q, range({parts}) AS t(p))",
        f"b0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::BIGINT AS e, s AS c FROM x QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})",
    ]
    far = "list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(s) AS s, min({far} * 256 + e) AS m FROM x JOIN b{r} USING (p) GROUP BY ALL)")
        if r < rounds:
            mean = f"SELECT p, m % 256 AS e, i, sum(s[i])::BIGINT AS t, count(*) AS n FROM a{r}, range(1, len(s) + 1) AS g(i) GROUP BY ALL"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM ({mean}) GROUP BY ALL) u USING (p, e))")
    steps.append(f"o AS (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY ALL)")
    books = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {books} AS codebooks_sha256 FROM o"


ORACLE = _oracle()
