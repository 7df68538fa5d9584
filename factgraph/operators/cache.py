"""Facts kept between runs, by file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from factgraph.functions import columns as C
from factgraph.functions import fixed
from factgraph.operators.shared import cut_lineage
from factgraph.sources import project

#: Goes up whenever facts change their form or meaning.
FORMAT = 2


def lookup(files: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Files with a state: fresh (same size and known time), refreshed (same content), stale, or missing."""
    old = cached.select(*keys, F.col("size").alias("__size"), F.col("mtime_ms").alias("__time"), F.col("content_hash").alias("__hash"))
    met = files.join(old, keys, "left")
    state = F.when(F.col("__hash").isNull(), "missing").when((F.col("size") == F.col("__size")) & (F.col("mtime_ms") == F.col("__time")) & (F.col("mtime_ms") != 0), "fresh").when(F.col("content_hash") == F.col("__hash"), "refreshed").otherwise("stale")
    return met.withColumn("state", state).drop("__size", "__time", "__hash")


def fingerprint(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))


def _mark(settings: dict | None) -> str:
    return json.dumps({"format": FORMAT, "settings": settings or {}}, sort_keys=True)


def _load(spark: SparkSession, folder: str, mark: str) -> DataFrame | None:
    """What the cache at ``folder`` holds; another format or other settings void it."""
    try:
        return spark.read.parquet(folder).where(F.col("mark") == mark)
    except AnalysisException:
        return None


_KEYS = ["project_id", "path"]
_OWN = ("content_hash", "size", "mtime_ms", "mark")


def _save(facts: DataFrame, folder: str, mark: str) -> DataFrame:
    both = cut_lineage(facts.withColumn("mark", F.lit(mark)))
    both.write.mode("overwrite").parquet(folder)
    return both.drop(*_OWN)


def parse_cached(spark: SparkSession, files: DataFrame, folder: str, settings: dict | None = None) -> DataFrame:
    """As :func:`factgraph.sources.project.parse`, but files whose content is in the cache at ``folder`` aren't parsed.

    The cache holds files of the last run only.  It is written anew if any file changed.
    """
    mark = _mark(settings)
    now = fingerprint(files).withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime_ms", F.lit(0).cast("long"))
    return _merged(spark, now, _load(spark, folder, mark), folder, mark, None)


def parse_listed(spark: SparkSession, listed: DataFrame, folder: str, settings: dict | None = None) -> DataFrame:
    """Facts of listed files (:func:`factgraph.sources.project.listing`): those whose size and time are as in the cache
    at ``folder`` are neither read nor hashed, of the others those whose content is as before aren't parsed."""
    mark = _mark(settings)
    wanted = listed.where(C.language(F.col("path")).isin(*fixed.PARSED))
    cached = _load(spark, folder, mark)
    if cached is None:
        return _merged(spark, fingerprint(project.read(wanted)), None, folder, mark, None)
    states = cut_lineage(lookup(wanted.withColumn("content_hash", F.lit(None).cast("string")), cached, _KEYS))
    fresh = cached.join(states.where("state = 'fresh'").select(*_KEYS), _KEYS, "left_semi")
    return _merged(spark, fingerprint(project.read(states.where("state <> 'fresh'"))), cached, folder, mark, fresh)


def _merged(spark: SparkSession, now: DataFrame, cached: DataFrame | None, folder: str, mark: str, fresh: DataFrame | None) -> DataFrame:
    """Facts of ``fresh`` rows of the cache and of the files ``now``, which are parsed unless the cache has their content."""
    now = cut_lineage(now)
    meta = now.select(*_KEYS, "content_hash", "size", "mtime_ms")
    if cached is None:
        return _save(project.parse(now).join(meta, _KEYS), folder, mark)
    known = lookup(meta, cached, _KEYS)
    same = cached.drop("size", "mtime_ms").join(known.where("state IN ('fresh', 'refreshed')").select(*_KEYS, "size", "mtime_ms"), _KEYS)
    parsed = project.parse(now.join(known.where("state IN ('stale', 'missing')").select(*_KEYS), _KEYS, "left_semi")).join(meta, _KEYS).withColumn("mark", F.lit(mark))
    parsed, kept = cut_lineage(parsed), same if fresh is None else fresh.unionByName(same)
    if parsed.isEmpty() and kept.count() == cached.count() and (fresh is None or same.isEmpty()):
        return kept.drop(*_OWN)
    return _save(kept.unionByName(parsed), folder, mark)
