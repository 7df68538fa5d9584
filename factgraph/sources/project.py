"""Project files as rows, and their facts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.functions import columns as C
from factgraph.functions import fixed

FILES = "project_id string, path string, content string"

_SPAN = "line int, start long, end long"
FACTS = f"""project_id string, path string, language string, failure string,
imports array<struct<specifier string, kind string, names array<string>, {_SPAN}>>, exports array<struct<name string, {_SPAN}>>,
symbols array<struct<name string, kind string, exported boolean, params array<string>, is_async boolean, returns_jsx boolean, body_start long, body_end long, body_lines int, extends array<string>, type_refs array<string>, {_SPAN}>>,
calls array<struct<callee string, args int, {_SPAN}>>, env_reads array<struct<name string, {_SPAN}>>, eval_calls array<struct<name string, {_SPAN}>>, dynamic_calls array<struct<name string, {_SPAN}>>,
refs array<string>, secrets array<struct<binding string, preview string, length int, signal string, {_SPAN}>>, directives array<string>"""


def ignore_pattern(line: str) -> tuple[bool, bool, re.Pattern] | None:
    """(negated, folders only, pattern over paths below the file's folder) of a line of an ignore file, if it has any.

    ``*`` and ``?`` stop at a slash, ``**/`` stands for any folders or none, a slash before the end ties the pattern to
    the file's folder.
    """
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folder, line = line.endswith("/"), line.rstrip("/")
    tied, line = "/" in line, line.removeprefix("/")
    out, i = "" if tied else "(?:.*/)?", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1 + (len(line[i:]) - len(line[i:].lstrip("*")) - 1)
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    try:
        return negated, folder, re.compile(out)
    except re.error:
        return None


def _ignored(patterns: list[tuple[str, tuple]], path: str, is_dir: bool) -> bool:
    """The last matching line of the ignore files above a path decides."""
    for base, (negated, folder, pattern) in reversed(patterns):
        if base and not path.startswith(base + "/") or folder and not is_dir:
            continue
        if pattern.fullmatch(path[len(base) + 1 if base else 0 :]):
            return not negated
    return False


#: In a folder, the later ones go before; the first is the project's own.
IGNORE_FILES = (".git/info/exclude", ".gitignore", ".ignore")


def walk(root: str) -> Iterator[str]:
    """Relative paths of a project's files, in order; hidden, ignored and excluded entries are passed over."""
    ignore: list[tuple[str, tuple]] = []
    for folder, names, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        for name in IGNORE_FILES if not rel else IGNORE_FILES[1:]:
            if os.path.isfile(os.path.join(folder, name)):
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    ignore += [(rel, p) for p in map(ignore_pattern, f) if p]
        join = lambda n: f"{rel}/{n}" if rel else n  # noqa: E731, B023
        keep = lambda n, d: n not in fixed.HARD_EXCLUDES and not _ignored(ignore, join(n), d)  # noqa: E731, B023
        names[:] = sorted(n for n in names if not n.startswith(".") and keep(n, True))
        yield from (join(n) for n in sorted(files) if (not n.startswith(".") or n in fixed.ENV_FILES) and keep(n, False))


LISTED = "project_id string, place string, path string, size long, mtime_ms long"


def listing(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Files of projects (id -> folder that all executors see) with their size and time; a task lists a project."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for project, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for path in walk(root):
                    place = os.path.join(root, path)
                    try:
                        found = os.stat(place)
                        rows.append((project, place, path, found.st_size, found.st_mtime_ns // 1_000_000))
                    except OSError:
                        rows.append((project, place, path, 0, 0))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in LISTED.split(", ")])

    projects = spark.createDataFrame([(p, os.path.abspath(r)) for p, r in roots.items()], "project_id string, root string")
    return projects.repartition(max(1, min(len(roots), 1024)), "project_id").mapInArrow(run, LISTED)


def read(listed: DataFrame) -> DataFrame:
    """The listed files with their content (null: unreadable), dealt by path, so one large project isn't one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_HELD):
                part, content = batch.slice(at, FILES_HELD), []
                for place in part.column(1).to_pylist():
                    try:
                        with open(place, encoding="utf-8", errors="replace") as f:
                            content.append(f.read())
                    except OSError:
                        content.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(content, pa.string()), part.column(3), part.column(4)], names=["project_id", "path", "content", "size", "mtime_ms"])

    dealt = listed.select("project_id", "place", "path", "size", "mtime_ms").repartition("project_id", "path")
    return dealt.mapInArrow(run, f"{FILES}, size long, mtime_ms long")


def scan(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(project_id, path, content) of projects (id -> folder that all executors see)."""
    return read(listing(spark, roots)).select("project_id", "path", "content")


#: Files, and characters of them, that a task holds as Python objects at a time.
FILES_HELD, TEXT_HELD = 64, 4 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """Rows of a batch, a few at a time."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index("content"))).fill_null(0).to_pylist() if batch.num_rows else []
    begin, held = 0, 0
    for at, size in enumerate(sizes):
        if at > begin and (held + size > TEXT_HELD or at - begin >= FILES_HELD):
            yield batch.slice(begin, at - begin).to_pylist()
            begin, held = at, 0
        held += size
    if len(sizes) > begin:
        yield batch.slice(begin).to_pylist()


def parse(files: DataFrame) -> DataFrame:
    """One nested row of facts per file that can be parsed; a failure is a row with its reason, never an error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from factgraph.sources import javascript, python

    wanted = files.withColumn("language", C.language(F.col("path"))).where(F.col("language").isin(*fixed.PARSED)).select("project_id", "path", "language", "content")
    schema = T._parse_datatype_string(FACTS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts(batch)):
            rows = []
            for row in part:
                out = {k: row[k] for k in ("project_id", "path", "language")} | {"failure": None}
                try:
                    if row["content"] is None:
                        raise ValueError("unreadable")
                    out |= (python if row["language"] == "python" else javascript).facts(row["content"], row["language"])
                except (SyntaxError, ValueError, RecursionError, IndexError) as e:
                    out["failure"] = f"{type(e).__name__}: {e}"
                rows.append(out)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return wanted.mapInArrow(run, schema)


def package_dependencies(files: DataFrame) -> DataFrame:
    """(project_id, section, name, version) of each project's package.json; a broken one has none."""
    parsed = files.where("path = 'package.json'").select("project_id", F.from_json("content", "struct<dependencies: map<string, string>, devDependencies: map<string, string>>").alias("p"))
    out = [parsed.select("project_id", F.lit(s).alias("section"), F.explode(f"p.{s}").alias("name", "version")) for s in ("dependencies", "devDependencies")]
    return out[0].unionByName(out[1])


def env_declarations(files: DataFrame) -> DataFrame:
    """(project_id, name, path, line) of the environment files' assignments."""
    lines = files.where(F.col("path").isin(*fixed.ENV_FILES)).select("project_id", "path", F.posexplode(F.split("content", "\n")).alias("pos", "raw"))
    text = F.regexp_replace(F.trim("raw"), "^export ", "")
    name = F.trim(F.substring_index(text, "=", 1))
    named = lines.where(~F.trim("raw").startswith("#") & F.col("raw").contains("=")).select("project_id", name.alias("name"), "path", (F.col("pos") + 1).alias("line"))
    return named.where(F.col("name").rlike("^[A-Za-z0-9_]+$"))


def root_entries(files: DataFrame) -> DataFrame:
    """(project_id, entry): what is in a project's root, and one level down in the usual folders."""
    parts = F.split("path", "/")
    top = files.select("project_id", parts[0].alias("entry"))
    inner = files.where((F.size(parts) > 1) & parts[0].isin(*fixed.ENTRY_DIRECTORIES)).select("project_id", F.concat_ws("/", parts[0], parts[1]).alias("entry"))
    return top.unionByName(inner).distinct()


def jsonc(text: str) -> str:
    """JSON of a text with comments and trailing commas; strings stay as they are."""
    kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept)


def parent_config(text: str, path: str = "tsconfig.json") -> str | None:
    """Path of the configuration file that one extends, if it is a local one."""
    try:
        parent = json.loads(jsonc(text)).get("extends")
    except (ValueError, AttributeError):
        return None
    if not isinstance(parent, str) or not parent.startswith("."):
        return None
    at = os.path.normpath(os.path.join(os.path.dirname(path), parent)).replace(os.sep, "/")
    return at if at.endswith(".json") else at + ".json"


def aliases(configs: dict[str, str], path: str = "tsconfig.json") -> list[tuple[int, str, str | None, int, str]]:
    """(priority, prefix, suffix, target_ord, target) of a project's path aliases, from its configuration files' texts.

    Exact patterns come first, then the longest prefix; a pattern's targets keep their order.  One local ``extends`` is
    followed, and a pattern of the child replaces the parent's.  Targets are relative to their file's base folder.  Bad
    files have none.
    """

    def load(at: str) -> dict[str, list[str]]:
        try:
            options = json.loads(jsonc(configs[at])).get("compilerOptions") or {}
            root = os.path.join(os.path.dirname(at), options.get("baseUrl") or ".")
            return {p: [os.path.normpath(os.path.join(root, t)).replace(os.sep, "/") for t in targets] for p, targets in (options.get("paths") or {}).items()}
        except (KeyError, ValueError, AttributeError, TypeError):
            return {}

    parent = parent_config(configs.get(path, ""), path)
    patterns = (load(parent) if parent else {}) | load(path)
    out = []
    for pattern, targets in patterns.items():
        prefix, star, suffix = pattern.partition("*")
        out.append((bool(star), -len(prefix), prefix, suffix if star else None, targets))
    out.sort(key=lambda x: x[:3])
    return [(i, prefix, suffix, k, t) for i, (_, _, prefix, suffix, targets) in enumerate(out) for k, t in enumerate(targets)]
