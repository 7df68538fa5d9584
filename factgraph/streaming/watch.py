"""Continuous analysis: what findings come and go as files change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factgraph.functions import columns as C
from factgraph.functions import fixed
from factgraph.operators import relops

TRIGGER = "300 milliseconds"


def keyed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("key", F.concat_ws("|", "rule_id", "project_id", "path", F.col("line").cast("string"), "title"))


def delta(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that are new, and those that are gone."""
    return relops.difference(current, previous, ["key"]), relops.difference(previous, current, ["key"])


def by_file(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(project_id, path, findings): what an editor is to show of each file; files that had findings and have none any
    more come with an empty list, so that theirs are cleared."""
    rank = C.rank(F.col("severity"), fixed.SEVERITIES)
    shown = F.when(rank >= 3, 1).when(rank == 2, 2).when(rank == 1, 3).otherwise(4)
    own = F.struct(F.greatest(F.coalesce("line", F.lit(1)) - 1, F.lit(0)).alias("line"), F.col("start"), F.col("rule_id"), shown.alias("severity"), F.col("title").alias("message"))
    now = current.groupBy("project_id", "path").agg(F.sort_array(F.collect_list(own)).alias("findings"))
    stale = relops.difference(previous.select("project_id", "path").distinct(), current, ["project_id", "path"])
    return now.unionByName(stale.withColumn("findings", F.array().cast(now.schema["findings"].dataType)))


def _files(spark: SparkSession, folder: str):
    """(file system, path) of a folder that Spark reads, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _batches(spark: SparkSession, state: str) -> list[int]:
    """Batches that have a complete state."""
    fs, path = _files(spark, state)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[6:]) for p in found if p.getName().startswith("batch=") and fs.exists(done(p, "_SUCCESS")))


def _delete(spark: SparkSession, folder: str) -> None:
    fs, path = _files(spark, folder)
    fs.delete(path, True)


def watch(spark: SparkSession, changes: DataFrame, analyse: Callable[[], DataFrame], state: str, report: Callable[[int, DataFrame, DataFrame], None], checkpoint: str, trigger: str = TRIGGER) -> StreamingQuery:
    """For each batch of change events analyses anew and reports the difference to the findings kept at ``state``.

    The trigger stands for a debounce: events that come together make one analysis.  State is a folder for each batch
    that had events, so one that is run again after a failure finds the batch before it; empty batches change nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        before = _batches(spark, state)
        keyed(analyse()).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        current = spark.read.parquet(f"{state}/batch={batch_id}")
        last = max((b for b in before if b < batch_id), default=None)
        previous = current.limit(0) if last is None else spark.read.parquet(f"{state}/batch={last}")
        report(batch_id, *delta(previous, current))
        for old in before:
            if last is not None and old < last:
                _delete(spark, f"{state}/batch={old}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
