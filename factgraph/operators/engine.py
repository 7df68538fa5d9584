"""From files to findings."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import fixed
from factgraph.operators import cache, resolve, rules
from factgraph.operators.report import Config, apply_config
from factgraph.operators.shared import cut_lineage
from factgraph.sources import project


def aliases_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Path aliases of all projects: the configuration file of each root, with the one that it extends, wherever that is."""
    preferred = files.where("path IN ('tsconfig.json', 'jsconfig.json') AND content IS NOT NULL")
    root = preferred.groupBy("project_id").agg(F.max(F.struct("path", "content")).alias("own")).select("project_id", "own.path", "own.content")

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [project.parent_config(text, path) for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.string())], names=["project_id", "path", "content", "parent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                texts = {r["path"]: r["content"]} | ({r["parent"]: r["above"] or ""} if r["parent"] else {})
                rows += [(r["project_id"], *a) for a in project.aliases(texts, r["path"])]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in resolve.ALIASES.split(", ")])

    known = root.mapInArrow(parents, "project_id string, path string, content string, parent string")
    above = files.select("project_id", F.col("path").alias("parent"), F.col("content").alias("above"))
    return known.join(above, ["project_id", "parent"], "left").select("project_id", "path", "content", "parent", "above").mapInArrow(run, resolve.ALIASES)


def root_packages(spark: SparkSession, roots: dict[str, str]) -> DataFrame | None:
    rows = [(p, os.path.basename(os.path.abspath(root))) for p, root in roots.items() if os.path.exists(os.path.join(root, "__init__.py"))]
    return spark.createDataFrame(rows, "project_id string, root_package string") if rows else None


def analyze(spark: SparkSession, files: DataFrame, config: Config = Config(), cached: str | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Findings of all projects in ``files`` (project_id, path, content)."""
    return _findings(spark, files, cache.parse_cached(spark, files, cached) if cached else project.parse(files), config, roots)


def _findings(spark: SparkSession, files: DataFrame, facts: DataFrame, config: Config, roots: DataFrame | None) -> DataFrame:
    return apply_config(rules.run_all(rules.context(files, facts, aliases_of(spark, files), roots)), config)


def analyze_folders(spark: SparkSession, roots: dict[str, str], config: Config = Config(), cached: str | None = None) -> DataFrame:
    """Findings of projects on disk.  With a cache, of files whose size and time it knows nothing but these is read."""
    if not cached:
        return analyze(spark, project.scan(spark, roots), config, None, root_packages(spark, roots))
    listed = cut_lineage(project.listing(spark, roots))
    facts = cache.parse_listed(spark, listed, cached)
    # what rules read besides facts: manifests, environment files, configuration
    named = F.col("path").isin("package.json", *fixed.ENV_FILES) | F.col("path").endswith(".json")
    texts = project.read(listed.where(named)).select("project_id", "path", "content")
    files = listed.where(~named).select("project_id", "path", F.lit(None).cast("string").alias("content")).unionByName(texts)
    return _findings(spark, cut_lineage(files), facts, config, root_packages(spark, roots))
