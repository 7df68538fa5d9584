"""Column expressions on paths, names and literals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factgraph.functions import fixed


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The path without its last part; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def path_key(path: Column) -> Column:
    """Sorts paths part by part."""
    return F.split(path, "/")


def extension(path: Column) -> Column:
    """After the last dot of the name; empty for none or a leading dot only."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def language(path: Column, first_line: Column | None = None) -> Column:
    """By name, then extension, then (if given) the shebang; null if unknown."""
    name, ext = F.lower(file_name(path)), F.lower(extension(path))
    out = F.when((name == "dockerfile") | name.startswith("dockerfile.") | name.endswith(".dockerfile"), F.lit("dockerfile"))
    for found, extensions in fixed.EXTENSIONS.items():
        out = out.when(ext.isin(*extensions), F.lit(found))
    if first_line is not None:
        words = F.split(F.trim(F.regexp_extract(first_line, r"^#!(.*)$", 1)), r"\s+")
        program = F.substring_index(words[0], "/", -1)
        base = F.regexp_replace(F.when(program == "env", F.try_element_at(words, F.lit(2))).otherwise(program), "[0-9.]+$", "")
        for found, names in fixed.SHEBANGS.items():
            out = out.when(base.isin(*names), F.lit(found))
    return out


def excluded(path: Column) -> Column:
    """A part of the path is a directory or file that scans pass over."""
    return F.arrays_overlap(path_key(path), F.array(*map(F.lit, fixed.HARD_EXCLUDES)))


def normalise(path: Column) -> Column:
    """Drops empty parts and ``.``; ``..`` goes up, and stays at the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(fold, "/")


def probe_candidates(base: Column) -> Column:
    """Paths that an import of ``base`` may mean, in order."""
    out = [F.array(base)]
    for ext, others in fixed.ESM_SUBSTITUTES.items():
        stem = F.regexp_replace(base, rf"\.{ext}$", "")
        out.append(F.when(base.endswith(f".{ext}"), F.array(*[F.concat(stem, F.lit(f".{o}")) for o in others])).otherwise(F.array().cast("array<string>")))
    out.append(F.array(*[F.concat(base, F.lit(f".{e}")) for e in fixed.PROBE_EXTENSIONS]))
    out.append(F.array(*[F.concat(base, F.when(base == "", F.lit("")).otherwise(F.lit("/")), F.lit(f"index.{e}")) for e in fixed.PROBE_EXTENSIONS]))
    return F.concat(*out)


def package_name(specifier: Column) -> Column:
    """npm package of a specifier; null for builtins and bare scopes."""
    parts = F.split(specifier, "/")
    first, second = parts[0], F.try_element_at(parts, F.lit(2))
    scoped = F.when((F.length(first) > 1) & (F.length(second) > 0), F.concat_ws("/", first, second))
    return F.when(specifier.startswith("node:") | first.isin(*fixed.NODE_BUILTINS), None).when(first.startswith("@"), scoped).otherwise(first)


def never_imported(path: Column) -> Column:
    """Files that tools or frameworks load, so that no import is no sign of death."""
    name = file_name(path)
    return (
        name.contains(".config.")
        | name.isin(*fixed.UNIMPORTED_NAMES)
        | (name.startswith("test_") & name.endswith(".py"))
        | any_of(name.endswith(s) for s in fixed.UNIMPORTED_SUFFIXES)
        | any_of(path.startswith(d) | path.contains(f"/{d}") for d in fixed.UNIMPORTED_DIRECTORIES)
    )


def placeholder(value: Column) -> Column:
    lower = F.lower(value)
    return value.contains(" ") | any_of(value.startswith(s) for s in fixed.PLACEHOLDER_STARTS) | any_of(lower.contains(f) for f in fixed.PLACEHOLDER_FRAGMENTS)


def secret_signal(binding: Column, value: Column) -> Column:
    """known_prefix, suspicious_name or null."""
    possible = (F.octet_length(value) >= 8) & ~placeholder(value)
    prefixed = (F.octet_length(value) >= 16) & any_of(value.startswith(p) for p in fixed.SECRET_PREFIXES)
    named = any_of(F.lower(binding).contains(f) for f in fixed.SECRET_NAME_FRAGMENTS)
    return F.when(possible & prefixed, F.lit("known_prefix")).when(possible & named, F.lit("suspicious_name"))


def is_hook(name: Column) -> Column:
    return name.rlike("^use[A-Z0-9]")


def react_role(name: Column, returns_jsx: Column) -> Column:
    return F.when(is_hook(name), F.lit("hook")).when(returns_jsx & (name.rlike("^[A-Z]") | (name == "default")), F.lit("component"))


def special_file(path: Column) -> Column:
    """Kind of an App Router file; null for ordinary modules."""
    stem = F.regexp_extract(file_name(path), r"^(.+)\.[^.]*$", 1)
    return F.when(extension(path).isin(*fixed.ROUTE_EXTENSIONS) & stem.isin(*fixed.SPECIAL_STEMS), stem)


def segment_kind(raw: Column) -> Column:
    return (
        F.when(raw.rlike(r"^\[\[\.\.\..*\]\]$"), F.lit("optional_catch_all"))
        .when(raw.rlike(r"^\[\.\.\..*\]$"), F.lit("catch_all"))
        .when(raw.rlike(r"^\[.*\]$"), F.lit("dynamic"))
        .when(raw.rlike(r"^(\(\.\.\.\)|\(\.\.\)|\(\.\))"), F.lit("intercepting"))
        .when(raw.rlike(r"^\(.*\)$"), F.lit("route_group"))
        .when(raw.startswith("@"), F.lit("parallel_slot"))
        .otherwise(F.lit("static"))
    )


def segment_name(raw: Column) -> Column:
    return (
        F.when(raw.rlike(r"^\[\[\.\.\..*\]\]$"), F.regexp_extract(raw, r"^\[\[\.\.\.(.*)\]\]$", 1))
        .when(raw.rlike(r"^\[\.\.\..*\]$"), F.regexp_extract(raw, r"^\[\.\.\.(.*)\]$", 1))
        .when(raw.rlike(r"^\[.*\]$"), F.regexp_extract(raw, r"^\[(.*)\]$", 1))
        .when(raw.rlike(r"^(\(\.\.\.\)|\(\.\.\)|\(\.\))"), F.regexp_replace(raw, r"^(\(\.\.\.\))*(\(\.\.\))*(\(\.\))*", ""))
        .when(raw.rlike(r"^\(.*\)$"), F.regexp_extract(raw, r"^\((.*)\)$", 1))
        .when(raw.startswith("@"), F.substring(raw, 2, 1 << 20))
        .otherwise(raw)
    )


def rank(value: Column, order) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(order):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out
