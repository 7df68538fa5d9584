"""Planned edits for findings that have a fix, and their guarded application."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIXABLE = ("deps/unused-dependency", "env/unused-env-var")


def plan(findings: DataFrame, rules: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> DataFrame:
    """(project_id, path, rule_id, target, line, edit), a file's lower edits first."""
    rows = findings.where(F.col("rule_id").isin(*FIXABLE) & F.col("target").isNotNull())
    rows = rows.where(F.col("rule_id").isin(*rules)) if rules else rows
    rows = rows.where(F.col("path").isin(*paths)) if paths else rows
    edit = F.when(F.col("rule_id") == FIXABLE[0], "remove_dependency").otherwise("delete_line")
    return rows.select("project_id", "path", "rule_id", "target", "line", edit.alias("edit")).orderBy("project_id", F.split("path", "/"), F.desc("line"), "target")


@dataclass
class Outcome:
    text: str
    applied: int
    skipped: list[str]


def remove_dependency(text: str, name: str) -> str:
    """The file without one dependency, its other lines as they are; raises ValueError if it isn't there."""
    if name not in json.loads(text).get("dependencies", {}):
        raise ValueError(f"{name} is not a dependency")
    block = re.search(r'"dependencies"\s*:\s*\{', text)
    end = text.index("}", block.end())
    inner = text[block.end() : end]
    entry = re.search(rf'[ \t]*"{re.escape(name)}"\s*:\s*"[^"]*"[ \t]*(,)?[ \t]*\n?', inner)
    left = inner[: entry.start()] + inner[entry.end() :]
    if not entry[1]:  # it was the last one: the comma before goes
        left = re.sub(r",(\s*)$", r"\1", left)
    out = text[: block.end()] + left + text[end:]
    json.loads(out)
    return out


def delete_line(text: str, line: int, name: str) -> str:
    """The text without a line, which must still declare the name."""
    lines = text.split("\n")
    if not 0 < line <= len(lines) or not re.match(rf"\s*(export\s+)?{re.escape(name)}\s*=", lines[line - 1]):
        raise ValueError(f"line {line} no longer declares {name}")
    return "\n".join(lines[: line - 1] + lines[line:])


def apply(text: str, edits: list[tuple[str, str, int]]) -> Outcome:
    """A file's edits (edit, target, line), lowest first; what no longer fits is skipped with the reason."""
    done, skipped = 0, []
    for edit, target, line in edits:
        try:
            text = remove_dependency(text, target) if edit == "remove_dependency" else delete_line(text, line, target)
            done += 1
        except (ValueError, AttributeError) as e:
            skipped.append(str(e))
    return Outcome(text, done, skipped)


def apply_all(files: DataFrame, planned: DataFrame) -> DataFrame:
    """(project_id, path, content, applied, skipped) of files with edits, each file in one call."""
    edits = planned.groupBy("project_id", "path").agg(F.sort_array(F.collect_list(F.struct("line", "target", "edit")), asc=False).alias("edits"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            out = [apply(r["content"], [(e["edit"], e["target"], e["line"]) for e in r["edits"]]) for r in rows]
            yield pa.RecordBatch.from_pylist([{"project_id": r["project_id"], "path": r["path"], "content": o.text, "applied": o.applied, "skipped": o.skipped} for r, o in zip(rows, out)], schema=schema)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T._parse_datatype_string("project_id string, path string, content string, applied int, skipped array<string>")
    schema = to_arrow_schema(kind)
    return files.join(edits, ["project_id", "path"]).select("project_id", "path", "content", "edits").mapInArrow(run, kind)


def write(root: str, contents: dict[str, str]) -> None:
    """Writes files (path -> new text), all or none: each is replaced at once, and if one fails the others get back what
    they had."""
    kept: list[tuple[str, str]] = []
    with tempfile.TemporaryDirectory() as saved:
        try:
            for i, (path, text) in enumerate(sorted(contents.items())):
                place, before = os.path.join(root, path), os.path.join(saved, str(i))
                shutil.copy2(place, before)
                kept.append((before, place))
                with open(place + ".new", "w", encoding="utf-8") as f:
                    f.write(text)
                shutil.copymode(place, place + ".new")
                os.replace(place + ".new", place)
        except OSError:
            for before, place in kept:
                shutil.copy2(before, place)
                if os.path.exists(place + ".new"):
                    os.remove(place + ".new")
            raise
