"""Filtering, ordering, counting, scoring and rendering of findings."""

from __future__ import annotations

import html
import json
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import fixed
from factgraph.operators import relops


@dataclass(frozen=True)
class Config:
    min_severity: str = "info"
    min_confidence: str = "unknown"
    enable: tuple[str, ...] = ()
    disable: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    name: str | None = field(default=None)


def load_config(text: str | None) -> Config:
    """Defaults without a text; unknown keys are errors."""
    if text is None:
        return Config()
    data = tomllib.loads(text)
    allowed = {"project": {"name", "exclude"}, "analysis": {"min_severity", "min_confidence"}, "rules": {"enable", "disable"}}
    for section, values in data.items():
        if section not in allowed or set(values) - allowed[section]:
            raise ValueError(f"unknown key in [{section}]: {sorted(set(values) - allowed.get(section, set()))}")
    flat = {k: tuple(v) if isinstance(v, list) else v for values in data.values() for k, v in values.items()}
    config = Config(**flat)
    if config.min_severity not in fixed.SEVERITIES or config.min_confidence not in fixed.CONFIDENCES:
        raise ValueError("unknown severity or confidence")
    return config


def _matches(rule: Column, patterns: tuple[str, ...]) -> Column:
    """Exactly, or by ``category/*`` on the rule's prefix."""
    return C.any_of(F.substring_index(rule, "/", 1) == p[:-2] if p.endswith("/*") else rule == p for p in patterns)


def apply_config(findings: DataFrame, config: Config) -> DataFrame:
    """Enabled rules stay, disabled ones go, of the rest what reaches both thresholds."""
    rule = F.col("rule_id")
    high = C.rank(F.col("severity"), fixed.SEVERITIES) >= fixed.SEVERITIES.index(config.min_severity)
    sure = C.rank(F.col("confidence"), fixed.CONFIDENCES) >= fixed.CONFIDENCES.index(config.min_confidence)
    out = findings.where(_matches(rule, config.enable) | (~_matches(rule, config.disable) & high & sure))
    return out.where(~C.any_of(F.col("path").startswith(e.rstrip("/") + "/") | (F.col("path") == e) for e in config.exclude)) if config.exclude else out


def _order() -> list[Column]:
    return [C.path_key(F.col("path")), F.col("start"), F.col("rule_id"), F.col("message")]


def ordered(findings: DataFrame) -> DataFrame:
    """By project, path (part by part), place, rule and message."""
    return findings.orderBy("project_id", *_order())


def places(findings: DataFrame) -> DataFrame:
    """Each finding's ``place`` in its project's report, from 1."""
    from factgraph.operators import graph

    return graph.numbered(findings, ["project_id"], _order(), "place").withColumn("place", F.col("place") + 1)


def gate(findings: DataFrame, severity: str) -> DataFrame:
    """One row: whether any finding reaches ``severity`` (``fails``), and the rank of the worst (null without any)."""
    place = C.rank(F.col("severity"), fixed.SEVERITIES)
    return findings.agg(F.coalesce(F.bool_or(place >= fixed.SEVERITIES.index(severity)), F.lit(False)).alias("fails"), F.max(place).alias("worst"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupingSets([["severity"], ["category"], []], "severity", "category").agg(F.count("*").alias("n"))


def first_of_each_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.min_by(F.struct("title", "severity", "category"), F.struct(C.path_key(F.col("path")), "start")).alias("f")).select("rule_id", "f.*")


def report(findings: DataFrame, project_id: str | None = None) -> dict:
    """One project's findings with counts and scores, on the driver: what is rendered is read by a person.

    Counts, scores and points are summed in Spark.  ``findings`` may hold many projects if one is named; for all of them
    at once see :func:`write_reports`.
    """
    own = findings if project_id is None else findings.where(F.col("project_id") == project_id)
    rows = [r.asDict() for r in ordered(own).collect()]
    scores = {r["category"]: r["score"] for r in relops.category_scores(own).collect()}
    points: dict[str, list] = {}
    for r in relops.deductions(own).orderBy("category", F.desc("tenths"), "rule_id").collect():
        points.setdefault(r["category"], []).append({"rule_id": r["rule_id"], "points": r["tenths"] / 10, "findings": r["findings"]})
    counts = summary(own).collect()
    total = (2 * sum(scores.values()) + len(scores)) // (2 * len(scores))
    count = lambda key: dict(sorted((r[key], r["n"]) for r in counts if r[key] is not None))
    card = {"overall": total, "categories": {c: {"score": s, "deductions": points.get(c, [])} for c, s in sorted(scores.items())}}
    return {"diagnostics": rows, "summary": {"total": len(rows), "by_severity": count("severity"), "by_category": count("category")}, "scorecard": card}


def write_reports(findings: DataFrame, folder: str) -> None:
    """Findings of all projects as files, a folder for each project, without passing through the driver."""
    placed = places(findings)
    placed.repartition("project_id").sortWithinPartitions("project_id", "place").write.mode("overwrite").partitionBy("project_id").json(folder)


def to_json(data: dict) -> str:
    return json.dumps(data, indent=2, ensure_ascii=False) + "\n"


def from_json(text: str) -> dict:
    """A report as :func:`to_json` wrote it; ValueError if the text is no such report."""
    data = json.loads(text)
    if not isinstance(data, dict) or set(data) != {"diagnostics", "summary", "scorecard"} or not isinstance(data["diagnostics"], list):
        raise ValueError("not a report")
    for d in data["diagnostics"]:
        if not isinstance(d, dict) or not {"rule_id", "path", "severity", "confidence", "message"} <= set(d):
            raise ValueError("a finding lacks a field")
        if d["severity"] not in fixed.SEVERITIES or d["confidence"] not in fixed.CONFIDENCES:
            raise ValueError("unknown severity or confidence")
    return data


FINDINGS = "project_id string, path string, line int, start long, rule_id string, category string, severity string, confidence string, title string, message string, evidence array<string>, target string"


def read_json(spark: SparkSession, text: str) -> DataFrame:
    """The findings of a report as rows."""
    rows = [tuple(d.get(c.split()[0]) for c in FINDINGS.split(", ")) for d in from_json(text)["diagnostics"]]
    return spark.createDataFrame(rows, FINDINGS)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of many reports, a file each, read in tasks."""
    shape = f"diagnostics array<struct<{FINDINGS.replace(' array', ': array').replace(' string', ': string').replace(' int', ': int').replace(' long', ': long')}>>"
    texts = spark.read.text(folder, wholetext=True)
    return texts.select(F.explode(F.from_json("value", shape)["diagnostics"]).alias("d")).select("d.*")


TEMPLATE = """[project]
exclude = []

[analysis]
min_severity = "info"
min_confidence = "unknown"

[rules]
enable = []
disable = []
"""

_LEVELS = {"critical": "error", "high": "error", "medium": "warning"}


def to_sarif(data: dict) -> str:
    rules, results = {}, []
    for d in data["diagnostics"]:
        rules.setdefault(d["rule_id"], {"id": d["rule_id"], "shortDescription": {"text": d["title"]}, "defaultConfiguration": {"level": _LEVELS.get(d["severity"], "note")}})
        place = {"physicalLocation": {"artifactLocation": {"uri": d["path"]}, "region": {"startLine": max(1, d["line"] or 1)}}}
        results.append({"ruleId": d["rule_id"], "level": _LEVELS.get(d["severity"], "note"), "message": {"text": d["message"]}, "locations": [place]})
    return to_json({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "factgraph", "rules": list(rules.values())}}, "results": results}]})


def to_markdown(data: dict) -> str:
    out = ["# Report", "", f"Health: **{data['scorecard']['overall']}** / 100, findings: {data['summary']['total']}", "", "| Category | Score |", "|---|---|"]
    out += [f"| {c} | {s['score']} |" for c, s in data["scorecard"]["categories"].items()]
    out += ["", "## Findings", ""]
    for d in data["diagnostics"]:
        out.append(f"- **{d['severity']}** ({d['confidence']}) `{d['rule_id']}` {d['path']}:{d['line'] or 1}: {d['message']}")
    return "\n".join(out) + "\n"


def to_html(data: dict) -> str:
    esc = lambda x: html.escape(str(x))
    scores = "".join(f"<tr><td>{esc(c)}</td><td>{s['score']}</td></tr>" for c, s in data["scorecard"]["categories"].items())
    rows = "".join(f"<tr class={esc(d['severity'])}><td>{esc(d['severity'])}</td><td>{esc(d['rule_id'])}</td><td>{esc(d['path'])}:{d['line'] or 1}</td><td>{esc(d['message'])}</td></tr>" for d in data["diagnostics"])
    return f"<!doctype html><meta charset=utf-8><title>Report</title><h1>Health {data['scorecard']['overall']}</h1><table>{scores}</table><table>{rows}</table>\n"


def to_terminal(data: dict) -> str:
    order = lambda s: -fixed.SEVERITIES.index(s)
    counts = ", ".join(f"{n} {s}" for s, n in sorted(data["summary"]["by_severity"].items(), key=lambda x: order(x[0])))
    lines = [f"{d['severity'].upper():8} {d['path']}:{d['line'] or 1} {d['rule_id']}: {d['message']}" for d in data["diagnostics"]]
    return "\n".join([*lines, f"{data['summary']['total']} findings ({counts or 'none'}), health {data['scorecard']['overall']}"]) + "\n"


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a graph's drawing, nodes and edges in order; a writer can store it without collecting it."""
    esc = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    first, last = (edges.sparkSession.createDataFrame([(p, "", "", "", line)], "part int, a string, b string, c string, line string") for p, line in ((0, "digraph factgraph {"), (3, "}")))
    own = nodes.select(F.lit(1).alias("part"), F.col("label").alias("a"), F.lit("").alias("b"), F.col("kind").alias("c"), F.concat(F.lit("  "), esc("label"), F.lit(" [kind="), "kind", F.lit("];")).alias("line"))
    lines = edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("kind").alias("c"), F.concat(F.lit("  "), esc("src"), F.lit(" -> "), esc("dst"), F.lit(' [label="'), "kind", F.lit('"];')).alias("line"))
    return first.unionByName(own).unionByName(lines).unionByName(last).orderBy("part", "a", "b", "c").select("line")


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """One project's graph for drawing, streamed through the driver a partition at a time."""
    return "".join(r["line"] + "\n" for r in dot_lines(nodes, edges).toLocalIterator())


def explain(rule_id: str) -> dict:
    """What is known of a rule; an unknown one raises KeyError with all names."""
    if rule_id not in fixed.RULES:
        raise KeyError(f"unknown rule {rule_id}; known: {', '.join(sorted(fixed.RULES))}")
    return dict(zip(("category", "severity", "confidence", "maturity", "title", "languages"), fixed.RULES[rule_id])) | {"id": rule_id}
