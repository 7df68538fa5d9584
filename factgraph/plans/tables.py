"""Resolution and rules of the library over the driver's tables, in the form of projects.

Pages are modules of a project for each language: their links are imports, relative, by an alias, or of a package, and the
first words of titles are files.  Documents are symbols and files of a project for each source or language.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import fixed
from factgraph.operators import resolve, rules
from factgraph.plans.catalogue import ORACLES, QUERIES, _list, _t, query


def _context(**tables: DataFrame) -> rules.Context:
    """A context of the tables that a rule reads."""
    return rules.Context(**{f.name: tables.get(f.name) for f in fields(rules.Context)})


_SITE = """g AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/[0-9]', 1) AS project_id, regexp_extract_all(html, 'href="/([^"/]+)"', 1) AS words, regexp_extract(html, '<title>(\\w+)', 1) AS title FROM pages),
f AS (SELECT DISTINCT project_id, title, title || CASE WHEN page_id % 2 = 0 THEN '.ts' ELSE '/index.jsx' END AS path FROM g WHERE title <> ''),
i AS (SELECT page_id, project_id, 'site/' || page_id || '.js' AS path, unnest(words) AS word, (generate_subscripts(words, 1) - 1)::INT AS ord FROM g),
r AS (SELECT i.*, CASE WHEN page_id % 5 = 0 AND ord = 0 THEN [] ELSE [substr(word, 1, 1)] END AS names, CASE WHEN ord % 3 <> 2 THEN coalesce(a.path, b.path) END AS target,
  CASE WHEN ord % 3 = 2 THEN 'external' WHEN coalesce(a.path, b.path) IS NULL THEN 'unresolved' ELSE 'project' END AS resolution
  FROM i LEFT JOIN f a ON a.project_id = i.project_id AND a.path = word || '.ts' LEFT JOIN f b ON b.project_id = i.project_id AND b.path = word || '/index.jsx')"""


def _span() -> list[Column]:
    return [F.lit(0).alias("start"), F.lit(0).alias("end")]


def _site(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(project_id, page_id, title, words) of the pages, and the files that titles name."""
    html = F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1))
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([a-z]{2})/[0-9]", 1).alias("project_id"), html.alias("words"), F.regexp_extract("html", r"<title>(\w+)", 1).alias("title"))
    ends = F.when(F.col("page_id") % 2 == 0, ".ts").otherwise("/index.jsx")
    return pages, pages.where("title <> ''").select("project_id", "title", F.concat("title", ends).alias("path")).distinct()


def _resolved(spark, sf_dir) -> DataFrame:
    pages, files = _site(spark, sf_dir)

    def link(word, ord_):
        specifier = F.when(ord_ % 3 == 0, F.concat(F.lit("../"), word)).when(ord_ % 3 == 1, F.concat(F.lit("@/"), word)).otherwise(word)
        names = F.when((F.col("page_id") % 5 == 0) & (ord_ == 0), F.array().cast("array<string>")).otherwise(F.array(F.substring(word, 1, 1)))
        return F.struct(specifier.alias("specifier"), F.lit("import").alias("kind"), names.alias("names"), (ord_ + 1).alias("line"), *_span())

    path = F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".js"))
    facts = pages.select("project_id", path.alias("path"), F.lit("javascript").alias("language"), F.transform("words", link).alias("imports"))
    aliases = pages.select("project_id", F.lit(0).alias("priority"), F.lit("@/").alias("prefix"), F.lit("").alias("suffix"), F.lit(0).alias("target_ord"), F.lit("*").alias("target")).distinct()
    return resolve.resolve(facts, files.select("project_id", "path"), aliases)


@query(f"WITH {_SITE} SELECT path, ord, resolution, target, ord % 3 = 1 AS matched_alias FROM r")
def page_resolution(spark, sf_dir):
    """Links resolved as imports are: probed in order, through an alias, or of a package."""
    return _resolved(spark, sf_dir).select("path", "ord", "resolution", F.try_element_at("targets", F.lit(1)).alias("target"), "matched_alias")


@query(f"""WITH {_SITE} SELECT project_id, dst, kind, count(*) AS importers FROM (SELECT DISTINCT project_id, path AS src, target AS dst, 'imports' AS kind FROM r WHERE resolution = 'project'
UNION ALL SELECT DISTINCT project_id, path, word, 'depends_on' FROM r WHERE resolution = 'external') GROUP BY ALL""")
def page_edges(spark, sf_dir):
    """The file graph of the resolved links: how many modules lead to each file or package."""
    return resolve.edges(_resolved(spark, sf_dir)).groupBy("project_id", "dst", "kind").agg(F.count("*").alias("importers"))


@query(f"""WITH {_SITE}, u AS (SELECT project_id, target AS path, bool_or(len(names) = 0) AS star, count(*) AS importers FROM r WHERE resolution = 'project' GROUP BY ALL),
x AS (SELECT project_id, path, unnest([{{'n': substr(title, 1, 1), 'l': 1}}, {{'n': substr(title, 2, 1), 'l': 2}}, {{'n': substr(title, -1, 1), 'l': 3}}]) AS e FROM f)
SELECT project_id, path, e.l::INT AS line, 'exported `' || e.n || '` isn''t imported by any of the file''s importers' AS message, importers || ' importing bindings' AS evidence FROM x JOIN u USING (project_id, path)
WHERE NOT star AND NOT EXISTS (SELECT 1 FROM r WHERE r.project_id = x.project_id AND r.target = x.path AND resolution = 'project' AND list_contains(r.names, x.e.n))""")
def page_unused_exports(spark, sf_dir):
    """Letters that a file exports and no link to it names; a link without names takes all."""
    letter = lambda at, line: F.struct(F.substring("title", at, 1).alias("name"), F.lit(line).alias("line"), *_span())
    files = _site(spark, sf_dir)[1].select("project_id", "path", F.lit("typescript").alias("language"), F.array(letter(1, 1), letter(2, 2), letter(-1, 3)).alias("exports"))
    found = rules.run_all(_context(facts=files, bindings=resolve.bindings(_resolved(spark, sf_dir))), ("exports/unused-export",))
    return found.select("project_id", "path", "line", "message", F.col("evidence")[0].alias("evidence"))


@query(f"""WITH {_SITE} SELECT CASE ord % 3 WHEN 0 THEN 'imports/unresolved-import' ELSE 'imports/broken-path-alias' END AS rule_id, project_id, path, ord + 1 AS line,
CASE ord % 3 WHEN 0 THEN 'no file answers `../' || word || '`' ELSE '`@/' || word || '` matches a path alias but no file' END AS message FROM r WHERE resolution = 'unresolved'""")
def page_unresolved(spark, sf_dir):
    """Links that no file answers: two rules, their union, admitted by language."""
    found = rules.run_all(_context(resolved=_resolved(spark, sf_dir)), ("imports/broken-path-alias", "imports/unresolved-import"))
    return found.select("rule_id", "project_id", "path", "line", "message")


@query(f"""WITH {_SITE} SELECT DISTINCT project_id, title AS target, '`' || title || '` is a dependency that no file imports' AS message FROM f
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.project_id = f.project_id AND resolution = 'external' AND word = title AND word NOT IN ({_list(fixed.NODE_BUILTINS)}))""")
def page_dependencies(spark, sf_dir):
    """Titles as declared packages that no link of their project is for."""
    declared = _site(spark, sf_dir)[1].select("project_id", F.col("title").alias("name"), F.lit("dependencies").alias("section")).distinct()
    none = spark.createDataFrame([], "project_id string, framework string")
    found = rules.run_all(_context(dependencies=declared, resolved=_resolved(spark, sf_dir), frameworks=none), ("deps/unused-dependency",))
    return found.select("project_id", "target", "message")


@query("""WITH c AS (SELECT page_id, regexp_extract_all(html, '\\b(track|eval)\\(', 1) AS calls FROM pages), s AS (SELECT page_id, unnest(calls) AS name, generate_subscripts(calls, 1)::INT AS line FROM c)
SELECT 'site/' || page_id || '.js' AS path, line, '`' || name || '` runs code from text' AS message FROM s""")
def page_eval(spark, sf_dir):
    """Calls that run code from text."""
    calls = F.transform(F.regexp_extract_all("html", F.lit(r"\b(track|eval)\("), F.lit(1)), lambda c, i: F.struct(c.alias("name"), (i + 1).alias("line"), *_span()))
    facts = _t(spark, sf_dir, "pages").select(F.lit("p").alias("project_id"), F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), calls.alias("eval_calls"))
    return rules.run_all(_context(facts=facts), ("security/no-eval",)).select("path", "line", "message")


@query("""SELECT source AS project_id, lang || '.ts' AS path, max(doc_id) AS start, arg_max(n_chars, doc_id)::INT AS line, '`' || md5(text) || '` is declared ' || count(*) || ' times' AS message
FROM documents GROUP BY source, lang, md5(text) HAVING count(*) > 1""")
def document_duplicates(spark, sf_dir):
    """Texts that a source has twice or more in a language, as declarations of one name."""
    own = _t(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.concat("lang", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), F.md5("text").alias("name"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("line"), F.col("doc_id").alias("start"))
    return rules.run_all(_context(symbols=own), ("typescript/duplicate-declaration",)).select("project_id", "path", "start", "line", "message")


@query(f"""SELECT source AS project_id, doc_id::VARCHAR || '.ts' AS path, '`' || lang || '` has ' || len(string_split(text, chr(10))) || ' lines; the limit is {fixed.LARGE_FUNCTION_LINES}' AS message
FROM documents WHERE len(string_split(text, chr(10))) > {fixed.LARGE_FUNCTION_LINES}""")
def document_bodies(spark, sf_dir):
    """Documents of more lines than a function may have."""
    own = _t(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.lit("function").alias("kind"), F.col("lang").alias("name"), F.size(F.split("text", "\n")).alias("body_lines"), F.lit(1).alias("line"), F.lit(0).alias("start"))
    return rules.run_all(_context(symbols=own), ("complexity/large-function",)).select("project_id", "path", "message")


@query("SELECT lang AS project_id, doc_id::VARCHAR || '.ts' AS path, 'no file imports `' || doc_id || '.ts`' AS message FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def document_dead(spark, sf_dir):
    """Documents as files, of which the labelled ones are imported."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("project_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"))
    edges = docs.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi").select("project_id", F.col("path").alias("dst"), F.lit("imports").alias("kind"))
    return rules.run_all(_context(facts=docs, edges=edges), ("graph/dead-file",)).select("project_id", "path", "message")


@query(f"""SELECT doc_id::VARCHAR || '.ts' AS path, (ord + 1)::INT AS line, 'a literal looks like a credential (' || signal || ')' AS message, 'starts with `' || preview || '`, ' || length || ' characters' AS evidence FROM ({ORACLES["secret_candidates"]})""")
def document_secrets(spark, sf_dir):
    """Credential-like literals as findings, which show no more than a beginning and a length."""
    literal = F.struct("preview", "length", "signal", (F.col("ord") + 1).alias("line"), *_span())
    facts = QUERIES["secret_candidates"](spark, sf_dir).select(F.lit("p").alias("project_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), F.array(literal).alias("secrets"))
    return rules.run_all(_context(facts=facts), ("security/hardcoded-secret",)).select("path", "line", "message", F.col("evidence")[0].alias("evidence"))
