"""A keyed table in hash buckets: a save writes the buckets that change, and a manifest is swapped last.

A version's folder holds the buckets that it wrote; a manifest names, for each bucket, the folder that is current.  A save
that fails leaves the manifest before it, and with it every row, as they were.  The version before the current one stays
readable; older folders that no manifest names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators.shared import cut_lineage, forget

BUCKETS = 64


def _hadoop(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm.org.apache.hadoop.fs.Path


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    fs, path, _ = _hadoop(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _manifest(spark: SparkSession, folder: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest-{version}.json", wholetext=True).first()[0])


def _swap(spark: SparkSession, folder: str, version: int, content: dict) -> None:
    """Writes the manifest aside and renames it, which is all or nothing."""
    fs, path, at = _hadoop(spark, folder)
    aside = at(path, f"_manifest-{version}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.rename(aside, at(path, f"manifest-{version}.json")):
        raise OSError(f"manifest {version} of {folder} exists")


def bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, folder: str, manifest: dict, wanted: Sequence[str]) -> DataFrame | None:
    places = [f"{folder}/{manifest['places'][b]}/bucket={b}" for b in wanted if b in manifest["places"]]
    return spark.read.parquet(*places) if places else None


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """All rows of the current version; None where there is none, or no row."""
    found = _manifests(spark, folder)
    if not found:
        return None
    manifest = _manifest(spark, folder, found[-1])
    return _read(spark, folder, manifest, list(manifest["places"]))


def save(changed: DataFrame, folder: str, keys: Sequence[str], gone: DataFrame | None = None, whole: bool = False, buckets: int = BUCKETS) -> list[int]:
    """Puts the rows of ``changed`` in the place of those of their keys and deletes the keys of ``gone``; gives the buckets
    that were written.  ``whole``: nothing else stays.  A store keeps the number of buckets that it began with.
    """
    spark = changed.sparkSession
    found = _manifests(spark, folder)
    before = {"buckets": buckets, "places": {}} if not found or whole else _manifest(spark, folder, found[-1])
    version, n = (found[-1] if found else 0) + 1, before["buckets"]
    own = cut_lineage(changed.withColumn("bucket", bucket(keys, n)))
    away = own.select(*keys, "bucket") if gone is None else own.select(*keys, "bucket").unionByName(gone.select(*keys, bucket(keys, n).alias("bucket")))
    touched = sorted(r[0] for r in away.select("bucket").distinct().collect())  # a row for each bucket at most
    if not touched and not whole:
        return []
    old = _read(spark, folder, before, [str(b) for b in touched])
    rows = own
    if old is not None:
        rows = own.unionByName(old.select(*changed.columns, bucket(keys, n).alias("bucket")).join(away.select(*keys), list(keys), "left_anti"))
    fs, path, at = _hadoop(spark, folder)
    place = f"version={version}"
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{place}")
    written = {s.getPath().getName()[7:] for s in fs.listStatus(at(path, place)) if s.getPath().getName().startswith("bucket=")}
    places = {b: p for b, p in before["places"].items() if int(b) not in touched} | {b: place for b in written}
    _swap(spark, folder, version, {"buckets": n, "places": places})
    forget(own)
    for stale in found[:-1]:
        fs.delete(at(path, f"manifest-{stale}.json"), False)
    named = set(places.values()) | set(_manifest(spark, folder, found[-1])["places"].values() if found else [])
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and name not in named and name != place:
            fs.delete(status.getPath(), True)
    return touched
