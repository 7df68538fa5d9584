"""Centroid clustering of vectors by Lloyd rounds over the distinct ones, weighted by how often each occurs.

Equal quantised vectors are grouped with their multiplicities by a partial aggregate, so a vector that a third of all
rows have is one row from then on.  Rounds read only those; each task gives the weighted integer sums of the clusters.  At the
end assignments are joined back to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import common, vectors

CLUSTERS, ROUNDS, SCALE, DIMS, SEED = 40, 5, 256, 64, "2:"


def seeds(read: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """Components of the rows whose id has the smallest hashes; of one id by its components."""
    named = read.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    return [np.frombuffer(r["q"], "<i4").tolist() for r in named.orderBy("h", "q").limit(clusters).collect()]


def _sums(distinct: DataFrame, centres: list[list[int]], dims: int) -> DataFrame:
    """(cluster, n, s0, s1, ...) of each task: weighted sums, as text since they may exceed 64 bits."""
    own = np.array(centres, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}  # a row for each centroid at most
        for batch in vectors.steps(batches):
            q, n = vectors.matrix(batch), batch.column(1).to_numpy()
            best, _ = vectors.nearest(q, own)
            weighted = np.column_stack([n, q * n[:, None]]) if int(n.sum()) < 1 << 38 else np.column_stack([n.astype(object), q.astype(object) * n[:, None]])
            for cluster in np.unique(best).tolist():
                total = held.setdefault(cluster, [0] * (1 + dims))
                for k, value in enumerate(weighted[best == cluster].sum(0).tolist()):
                    total[k] += value
        columns = [pa.array(list(held), pa.int32()), *[pa.array([str(t[k]) for t in held.values()], pa.string()) for k in range(1 + dims)]]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *[f"s{k}" for k in range(dims)]])

    return distinct.select("q", "n").mapInArrow(run, "cluster int, n string, " + ", ".join(f"s{k} string" for k in range(dims)))


def _assigned(distinct: DataFrame, centres: list[list[int]]) -> DataFrame:
    """(q, n, cluster, distance)"""
    own = np.array(centres, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.steps(batches):
            best, far = vectors.nearest(vectors.matrix(batch), own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(run, "q binary, n long, cluster int, distance long")


def clusters(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for rows of (vec_id, embedding).

    Vectors without exactly ``dims`` components, or with a null or non-finite one, go.  Centroids start from the rows of the
    smallest hashes of their ids, null ids never among them; fewer rows give fewer centroids, and none gives no rows.
    Repeated rows count each, and rows of equal vectors get equal results.
    """
    spark = rows.sparkSession
    read = vectors.quantised(rows.select("vec_id", "embedding"), scale).where(F.col("dims") == dims)
    centres = seeds(read, clusters, seed)
    distinct = common.cut_lineage(read.groupBy("q").agg(F.count(F.lit(1)).alias("n")) if centres else read.select("q", F.lit(1).cast("long").alias("n")).limit(0))
    tasks = distinct.rdd.getNumPartitions()
    for _ in range(rounds if centres else 0):
        before = list(centres)
        for r in vectors.summed(_sums(distinct, centres, dims), ["cluster"], tasks).collect():  # a row for each centroid at most
            centres[r["cluster"]] = vectors.floor_mean([int(r[f"s{k}"]) for k in range(dims)], int(r["n"]))
        if before == centres:
            break
    found = common.cut_lineage(_assigned(distinct, centres) if centres else distinct.select("q", "n", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    common.forget(distinct)
    total = {r["cluster"]: int(r["inertia"]) for r in vectors.summed(found.select("cluster", (F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("inertia")), ["cluster"], tasks).collect()}
    each = [(c, total.get(c, 0), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centres)]
    named = F.broadcast(spark.createDataFrame(each, "cluster int, cluster_inertia long, centroid_sha256 string"))  # a row for each centroid
    owners = found.select(F.unhex(F.sha2("q", 256)).alias("key"), "cluster", "distance")
    met = common.join_owners(read.select("vec_id", F.unhex(F.sha2("q", 256)).alias("key")), owners, "key") if centres else read.select("vec_id").limit(0).join(found.drop("q", "n"), how="left")
    return met.join(named, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(total.values())).cast("long").alias("inertia"), "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = SEED) -> str:
    """The same by rounds over all rows, without grouping equal vectors."""
    steps = [
        f"q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale}.0 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"b0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1)::BIGINT AS k, v AS c FROM q ORDER BY sha256('{seed}' || vec_id) LIMIT {clusters})",
    ]
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({far} * 64 + k) AS m FROM q, b{r} GROUP BY vec_id)")
        if r < rounds:
            mean = f"SELECT m % 64 AS k, i, sum(v[i])::BIGINT AS t, count(*) AS n FROM a{r}, range(1, {dims} + 1) AS g(i) GROUP BY ALL"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT k, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM ({mean}) GROUP BY k) u USING (k))")
    last = f"SELECT vec_id, (m % 64)::INT AS cluster, m // 64 AS distance FROM a{rounds}"
    return f"""WITH {', '.join(steps)} SELECT vec_id, cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM ({last}) JOIN b{rounds} ON k = cluster"""


ORACLE = _oracle()
