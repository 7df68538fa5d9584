"""``spark.read.format("project").load(folder)``: a project's files as rows, and its imports as a table function."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factgraph.sources import javascript, project, python

#: Files that one task reads.
FILES_PER_TASK = 200


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.project_id = options.get("project_id", os.path.basename(os.path.abspath(self.root)))

    def partitions(self) -> list[_Files]:
        paths = list(project.walk(self.root))
        return [_Files(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files):
        for path in partition.paths:
            try:
                with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                    yield self.project_id, path, f.read()
            except OSError:
                yield self.project_id, path, None


class ProjectFiles(DataSource):
    """Spark's own readers hide names that begin with a dot or an underscore; this one knows what a project hides."""

    @classmethod
    def name(cls) -> str:
        return "project"

    def schema(self) -> str:
        return project.FILES

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


@F.udtf(returnType="specifier string, kind string, names array<string>, line int")
class ExtractImports:
    """``SELECT * FROM extract_imports(text, 'typescript')``; a text that doesn't parse has none."""

    def eval(self, text: str, language: str):
        try:
            facts = (python if language == "python" else javascript).facts(text or "", language)
        except (SyntaxError, ValueError):
            return
        for i in facts["imports"]:
            yield i["specifier"], i["kind"], i["names"], i["line"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProjectFiles)
    spark.udtf.register("extract_imports", ExtractImports)
