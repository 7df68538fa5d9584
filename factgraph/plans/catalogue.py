"""Registry of the engine's own queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracles.

Family A applies each operator to the driver's tables; family B analyses the fixture projects of
:mod:`factgraph.plans.fixtures`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.functions import columns as C
from factgraph.functions import fixed
from factgraph.operators import graph as G
from factgraph.operators import relops as R
from factgraph.operators import search as S
from factgraph.operators import walks as W
from factgraph.operators.shared import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# literals and paths

_PLACEHOLDER = " OR ".join(["contains(v, ' ')", *[f"starts_with(v, '{s}')" for s in fixed.PLACEHOLDER_STARTS], *[f"contains(lower(v), '{s}')" for s in fixed.PLACEHOLDER_FRAGMENTS]])


@query(f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]+ ?[:=] ?"[^"]*"')) AS lit, generate_subscripts(regexp_extract_all(text, '[A-Za-z_]+ ?[:=] ?"[^"]*"'), 1) AS ord FROM documents),
s AS (SELECT doc_id, ord, regexp_extract(lit, '^([A-Za-z_]+)', 1) AS binding, regexp_extract(lit, '"([^"]*)"', 1) AS v FROM m),
f AS (SELECT *, CASE WHEN strlen(v) < 8 OR {_PLACEHOLDER} THEN NULL WHEN strlen(v) >= 16 AND ({' OR '.join(f"starts_with(v, '{p}')" for p in fixed.SECRET_PREFIXES)}) THEN 'known_prefix'
  WHEN {' OR '.join(f"contains(lower(binding), '{p}')" for p in fixed.SECRET_NAME_FRAGMENTS)} THEN 'suspicious_name' END AS signal FROM s)
SELECT doc_id, (ord - 1)::INT AS ord, binding, substr(v, 1, 4) AS preview, length(v)::INT AS length, signal FROM f WHERE signal IS NOT NULL""")
def secret_candidates(spark, sf_dir):
    """Credential-like literals of documents; only a preview and the length leave."""
    found = F.regexp_extract_all("text", F.lit('[A-Za-z_]+ ?[:=] ?"[^"]*"'), F.lit(0))
    rows = _t(spark, sf_dir, "documents").where(F.col("text").contains('"')).select("doc_id", F.posexplode(found).alias("ord", "lit"))
    rows = rows.select("doc_id", "ord", F.regexp_extract("lit", "^([A-Za-z_]+)", 1).alias("binding"), F.regexp_extract("lit", '"([^"]*)"', 1).alias("v"))
    return rows.withColumn("signal", C.secret_signal(F.col("binding"), F.col("v"))).where("signal IS NOT NULL").select("doc_id", "ord", "binding", F.substring("v", 1, 4).alias("preview"), F.char_length("v").alias("length"), "signal")


_FRAGMENTS = """b AS (SELECT string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b),
f AS (SELECT DISTINCT array_to_string(w[i : i + n - 1], ' ') AS literal FROM i, range(2, 6) r(n) WHERE i + n - 1 <= len(w))"""


@query(f"""WITH {_FRAGMENTS} SELECT literal, count(*) AS documents, min(doc_id) AS first_id, sum(instr(text, literal))::BIGINT AS positions FROM documents JOIN f ON contains(text, literal) GROUP BY literal""")
def literal_table(spark, sf_dir):
    """Every run of two to five words of the benchmark, as a literal of a large pattern table, in all documents."""
    from factgraph.operators import literals

    words = _t(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.split("text", " ").alias("w"))
    at = words.select("w", F.posexplode("w").alias("i", "x")).select("w", "i", F.explode(F.array(*map(F.lit, range(2, 6)))).alias("n"))
    runs = at.where(F.col("i") + F.col("n") <= F.size("w")).select(F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("literal"))
    found = literals.find(_t(spark, sf_dir, "documents"), runs, ["doc_id"])
    return found.groupBy("literal").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.sum("position").cast("long").alias("positions"))


@query("""SELECT page_id, regexp_replace(trim(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), '/+', '/', 'g') || '/z' AS path FROM pages""")
def url_normalize(spark, sf_dir):
    """Lexical normalisation of URL paths with dots, double dots and empty parts added."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return _t(spark, sf_dir, "pages").select("page_id", C.normalise(F.concat(F.lit("../"), path, F.lit("/./x/y/../..//z"))).alias("path"))


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT CASE WHEN starts_with(href, './') OR starts_with(href, '../') THEN 'relative' WHEN starts_with(href, '/') THEN 'rooted' WHEN regexp_matches(href, '^[a-z]+:') THEN 'external' WHEN starts_with(href, '#') THEN 'fragment' ELSE 'bare' END AS kind,
  count(*) AS links, count(DISTINCT page_id) AS pages FROM h GROUP BY 1""")
def url_kind(spark, sf_dir):
    """Links classified as imports are: relative, rooted, external, ..."""
    hrefs = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    h = F.col("href")
    kind = F.when(h.startswith("./") | h.startswith("../"), "relative").when(h.startswith("/"), "rooted").when(h.rlike("^[a-z]+:"), "external").when(h.startswith("#"), "fragment").otherwise("bare")
    return hrefs.groupBy(kind.alias("kind")).agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query("""
WITH s AS (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
r AS (SELECT n_regionkey, min(s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 GROUP BY 1)
SELECT c_custkey, coalesce(s.k, r.k) AS supplier, CASE WHEN s.k IS NOT NULL THEN 'project' WHEN r.k IS NOT NULL THEN 'external' ELSE 'unresolved' END AS kind
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON s.s_nationkey = c_nationkey LEFT JOIN r ON r.n_regionkey = nation.n_regionkey""")
def probe_first_match(spark, sf_dir):
    """Ordered candidates, the first that exists wins: a supplier of the nation, else of the region, else none."""
    nation, supplier = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    suppliers = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    targets = suppliers.where("s_acctbal > 5000").groupBy(F.concat(F.lit("n"), F.col("s_nationkey")).alias("target")).agg(F.min("s_suppkey").alias("supplier"))
    targets = targets.unionByName(suppliers.where("s_acctbal > 9000").groupBy(F.concat(F.lit("r"), F.col("n_regionkey")).alias("target")).agg(F.min("s_suppkey").alias("supplier")))
    wanted = _t(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    candidates = wanted.select("c_custkey", F.posexplode(F.array(F.concat(F.lit("n"), F.col("c_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")))).alias("ord", "target"))
    best = candidates.join(targets, "target", "left").groupBy("c_custkey").agg(F.min(F.when(F.col("supplier").isNotNull(), F.struct("ord", "supplier"))).alias("b"))
    return best.select("c_custkey", F.col("b.supplier").alias("supplier"), F.when(F.col("b.ord") == 0, "project").when(F.col("b.ord") == 1, "external").otherwise("unresolved").alias("kind"))


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages)
SELECT href, count(*) AS links, count(DISTINCT page_id) AS pages FROM h WHERE starts_with(href, '/') AND NOT EXISTS (SELECT 1 FROM p WHERE path = href) GROUP BY href""")
def broken_links(spark, sf_dir):
    """Rooted links that no page's path answers; those that a filter of the paths excludes don't move."""
    from factgraph.operators import bloom

    pages = _t(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).where(F.col("href").startswith("/"))
    paths = pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "").alias("href"))
    return bloom.difference(hrefs, paths, ["href"]).groupBy("href").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


_PATTERNS_OF_PAGES = """u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS plain FROM pages),
a AS (SELECT DISTINCT unnest([{'p': host || '/', 's': '', 't': 'host/*'}, {'p': host || '/', 's': '.html', 't': 'file/*'}, {'p': regexp_extract(plain, '^(.*/)', 1), 's': '', 't': 'folder/*'}, {'p': plain, 's': '', 't': 'page*'}, {'p': plain, 's': NULL, 't': 'exact'}]) AS x FROM u),
p AS (SELECT x.p AS prefix, x.s AS suffix, x.t AS target, row_number() OVER (ORDER BY x.s IS NOT NULL, length(x.p) DESC, length(x.s) DESC, x.p, x.t) AS priority FROM a)"""


@query(f"""WITH {_PATTERNS_OF_PAGES}, s AS (SELECT DISTINCT specifier FROM (SELECT url AS specifier FROM u UNION ALL SELECT host || unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM u JOIN pages USING (page_id)))
SELECT specifier, prefix, CASE WHEN suffix IS NULL THEN target ELSE replace(target, '*', substr(specifier, length(prefix) + 1, length(specifier) - length(prefix) - length(suffix))) END AS resolved
FROM s JOIN p ON CASE WHEN suffix IS NULL THEN specifier = prefix ELSE starts_with(specifier, prefix) AND ends_with(specifier, suffix) AND length(specifier) >= length(prefix) + length(suffix) END
QUALIFY row_number() OVER (PARTITION BY specifier ORDER BY priority) = 1""")
def alias_prefixes(spark, sf_dir):
    """Aliases learnt from the pages (hosts, folders, files and the pages themselves) against all pages and links: exact
    ones first, then the longest prefix."""
    from factgraph.operators.resolve import expand_aliases

    pages = _t(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("url", "^([a-z]+://[^/]*)", 1).alias("host"), F.regexp_replace("url", "[?#].*$", "").alias("plain"))
    pattern = lambda p, s, t: F.struct(p.alias("prefix"), F.lit(s).cast("string").alias("suffix"), F.lit(t).alias("target"))
    top = F.concat("host", F.lit("/"))
    learnt = pages.select(F.explode(F.array(pattern(top, "", "host/*"), pattern(top, ".html", "file/*"), pattern(F.regexp_extract("plain", "^(.*/)", 1), "", "folder/*"), pattern(F.col("plain"), "", "page*"), pattern(F.col("plain"), None, "exact"))).alias("x")).select("x.*").distinct()
    order = [F.col("suffix").isNotNull(), -F.char_length("prefix"), -F.coalesce(F.char_length("suffix"), F.lit(0)), "prefix", "target"]
    aliases = G.numbered(learnt, [], order, "priority")
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).select(F.concat("host", "href").alias("specifier"))
    every = pages.select(F.col("url").alias("specifier")).union(links).distinct()
    return expand_aliases(every, aliases, ["specifier"]).select("specifier", "prefix", F.col("target").alias("resolved"))


# semi and anti joins, grouping


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabeled_documents(spark, sf_dir):
    return R.difference(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _t(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND year(l_shipdate) = 1998)")
def unused_parts(spark, sf_dir):
    used = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_shipdate >= '1998-01-01' AND l_shipdate < '1999-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return R.difference(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%')")
def semi_client(spark, sf_dir):
    urgent = _t(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1-")).select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(doc_id)::BIGINT AS id_sum FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_text(spark, sf_dir):
    """Repeated declarations of the same text; aggregates instead of a list, so a hot text stays small."""
    return _t(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("doc_id").alias("id_sum")).where("copies > 1")


@query("""
WITH u AS (SELECT l_partkey, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS star, list_sort(list(DISTINCT l_linestatus || l_returnflag)) AS used, count(*) AS bindings FROM lineitem GROUP BY 1)
SELECT p_partkey, bindings FROM part JOIN u ON l_partkey = p_partkey WHERE NOT star AND NOT list_contains(used, 'FA')""")
def star_usage(spark, sf_dir):
    """Exports of imported modules that no binding names, where a star binding counts as naming all."""
    use = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("star"), F.collect_set(F.concat("l_linestatus", "l_returnflag")).alias("used"), F.count("*").alias("bindings"))
    return _t(spark, sf_dir, "part").join(use, F.col("p_partkey") == F.col("l_partkey")).where(~F.col("star") & ~F.array_contains("used", "FA")).select("p_partkey", "bindings")


# graphs: each part leads to the parts that follow it within orders; all line items, all distinct edges

_FOLLOW = """o AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) - 1)::INT AS ord FROM (SELECT a AS src, b AS dst, count(*) AS n FROM (
  SELECT l_partkey AS b, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem) WHERE a <> b GROUP BY 1, 2))"""
_EDGES = f"{_FOLLOW}, e AS (SELECT src, dst FROM o)"
_FORWARD = f"{_FOLLOW}, e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM o)"


#: Line items of a task where orders are put in sequence: parts grow with the table, so a task's memory doesn't.
TASK_ROWS = 1 << 19


def _next(spark, sf_dir):
    """(src, dst) for each part that comes next after another in an order, and how many parts pairs should be dealt to."""
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // TASK_ROWS))
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    follow = items.repartition(parts, "l_orderkey").select(F.col("l_partkey").alias("dst"), F.lag("l_partkey").over(at).alias("src"))
    return follow.where("src <> dst").select("src", "dst"), parts


def _follow(spark, sf_dir):
    """(src, dst, n): how often a part comes next after another in an order."""
    follow, parts = _next(spark, sf_dir)
    return follow.repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _edges(spark, sf_dir):
    return _follow(spark, sf_dir).select("src", "dst")


def _forward(spark, sf_dir):
    """The neighbours without direction, each edge from the smaller part to the larger: an acyclic graph of all edges."""
    follow, parts = _next(spark, sf_dir)
    return follow.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).repartition(parts, "src", "dst").distinct()


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def part_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM n")
def part_nodes(spark, sf_dir):
    """Dense node ids."""
    edges = cut_lineage(_edges(spark, sf_dir))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return G.numbered(nodes, [], ["node"], "id")


def _graph(edges):
    """The edges as the file graph's tables: nodes and edges of one project."""
    edges = edges.select(F.lit("p").alias("project_id"), "src", "dst", F.lit("imports").alias("kind"))
    nodes = edges.select("project_id", F.col("src").alias("label")).union(edges.select("project_id", "dst")).distinct()
    return nodes.withColumn("kind", F.lit("file")), edges


@query(f"WITH {_EDGES} SELECT DISTINCT src AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.dst = e.src)")
def part_roots(spark, sf_dir):
    return G.roots(*_graph(cut_lineage(_edges(spark, sf_dir)))).select(F.col("label").alias("node"))


@query(f"WITH {_FORWARD} SELECT DISTINCT src AS node FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.dst = e.src)")
def forward_roots(spark, sf_dir):
    return G.roots(*_graph(cut_lineage(_forward(spark, sf_dir)))).select(F.col("label").alias("node"))


@query(f"WITH RECURSIVE {_EDGES}, c AS (SELECT src AS start, dst AS node FROM e WHERE src % 50 = 0 UNION SELECT c.start, e.dst FROM c JOIN e ON c.node = e.src) SELECT start, node FROM c")
def part_closure(spark, sf_dir):
    """What a stated set of parts, those whose key is divisible by 50, reaches; counts for all are in part_dependents."""
    edges = cut_lineage(_edges(spark, sf_dir))
    return R.closure(edges, edges.where("src % 50 = 0").select(F.col("src").alias("start")))


_DEPENDENTS = """c AS (SELECT src AS start, dst AS node FROM e UNION SELECT c.start, e.dst FROM c JOIN e ON c.node = e.src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT n.node, count(c.start) AS dependents FROM n LEFT JOIN c ON c.node = n.node AND c.start <> n.node GROUP BY 1"""


@query(f"WITH RECURSIVE {_EDGES}, {_DEPENDENTS}")
def part_dependents(spark, sf_dir):
    """Impact analysis: how many nodes reach each node, without a row for each pair."""
    return W.ancestor_counts(_edges(spark, sf_dir)).withColumnRenamed("ancestors", "dependents")


@query(f"WITH RECURSIVE {_FORWARD}, {_DEPENDENTS}")
def forward_dependents(spark, sf_dir):
    """The same on a deep acyclic graph."""
    return W.ancestor_counts(_forward(spark, sf_dir)).withColumnRenamed("ancestors", "dependents")


@query(f"WITH RECURSIVE {_FORWARD}, t AS (SELECT max(dst) AS target FROM e), c AS (SELECT src AS node FROM e JOIN t ON e.dst = t.target UNION SELECT e.src FROM c JOIN e ON c.node = e.dst) SELECT node FROM c JOIN t ON c.node <> t.target")
def part_impact(spark, sf_dir):
    """What reaches one node, the largest."""
    _, edges = _graph(cut_lineage(_forward(spark, sf_dir)))
    target = edges.agg(F.max("dst").alias("t")).first()["t"]
    return G.dependents(edges, "p", target).select(F.col("label").alias("node"))


_SCC = """c AS (SELECT src AS start, dst AS node FROM e UNION SELECT c.start, e.dst FROM c JOIN e ON c.node = e.src),
g AS (SELECT a.start AS node, least(a.start, min(a.node)) AS component FROM c a JOIN c b ON a.start = b.node AND a.node = b.start WHERE a.start <> a.node GROUP BY a.start)"""


@query(f"WITH RECURSIVE {_EDGES}, {_SCC} SELECT node, component FROM g")
def part_scc(spark, sf_dir):
    return R.strong_components(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, {_SCC}, f AS (SELECT DISTINCT coalesce(x.component, src) AS src, coalesce(y.component, dst) AS dst FROM e LEFT JOIN g x ON x.node = src LEFT JOIN g y ON y.node = dst WHERE coalesce(x.component, src) <> coalesce(y.component, dst)),
n AS (SELECT DISTINCT coalesce(component, m) AS node FROM (SELECT src AS m FROM e UNION SELECT dst FROM e) LEFT JOIN g ON g.node = m),
p AS (SELECT node, 0 AS level FROM n UNION SELECT f.dst, p.level + 1 FROM p JOIN f ON p.node = f.src)
SELECT node, max(level)::INT AS level FROM p GROUP BY node""")
def part_topo_level(spark, sf_dir):
    """Levels of the graph with each strong component as one node."""
    return W.component_levels(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_FORWARD}, p AS (SELECT DISTINCT src AS node, 0 AS level FROM e UNION SELECT e.dst, p.level + 1 FROM p JOIN e ON p.node = e.src) SELECT node, max(level)::INT AS level FROM p GROUP BY node")
def forward_levels(spark, sf_dir):
    """Levels of a deep acyclic graph."""
    return W.topological_levels(_forward(spark, sf_dir))


def _chain_sql(deepest: int) -> str:
    """Level by level: the least list of edge orders for each start and node that no level before had."""
    steps = [_FOLLOW, "m AS (SELECT p_partkey FROM part WHERE p_size = 50)", "l0 AS (SELECT DISTINCT src AS start, src AS node, {'o': []::INT[], 'c': [src]} AS w FROM o)"]
    for d in range(deepest):
        seen = " UNION ALL ".join(f"SELECT start, node FROM l{k}" for k in range(d + 1))
        steps.append(f"h{d} AS (SELECT start, min(w) AS w FROM l{d} WHERE node IN (FROM m) GROUP BY start)")
        steps.append(f"s{d} AS (SELECT start, dst AS node, min({{'o': list_append(w.o, ord), 'c': list_append(w.c, dst)}}) AS w FROM l{d} l ANTI JOIN h{d} USING (start) JOIN o ON l.node = o.src GROUP BY ALL)")
        steps.append(f"l{d + 1} AS MATERIALIZED (SELECT s.* FROM s{d} s ANTI JOIN ({seen}) USING (start, node))")
    hits = " UNION ALL ".join(f"SELECT start, w.c[-1] AS hit, {d}::INT AS depth, array_to_string(w.c, '>') AS chain FROM h{d}" for d in range(deepest))
    return f"WITH {', '.join(steps)} {hits}"


@query(_chain_sql(8))
def bfs_chain(spark, sf_dir):
    """From each part the first of the largest parts that a breadth-first search over all successors, frequent ones first,
    meets, and the way there."""
    at = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    edges = _follow(spark, sf_dir).select("src", "dst", (F.row_number().over(at) - 1).alias("ord"))
    marked = _t(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))
    found = S.first_chain(edges, edges.select(F.col("src").alias("start")).distinct(), marked)
    return found.select("start", "hit", "depth", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


_SETTINGS = {"brand": (3, "p_brand"), "type": (4, "p_type"), "size": (5, "p_size"), "name": (7, "p_name")}


@query(f"""WITH RECURSIVE {_FORWARD}, f AS (SELECT dst AS node, max(src) AS parent FROM e GROUP BY dst),
own AS ({' UNION ALL '.join(f"SELECT p_partkey AS node, '{k}' AS name, {c}::VARCHAR AS value FROM part WHERE p_partkey % {m} = 0" for k, (m, c) in _SETTINGS.items())}),
w AS (SELECT p_partkey AS node, p_partkey AS at, 0 AS depth FROM part UNION ALL SELECT w.node, f.parent, depth + 1 FROM w JOIN f ON w.at = f.node)
SELECT w.node, name, arg_min(value, depth) AS value FROM w JOIN own ON own.node = w.at GROUP BY ALL""")
def inherited_settings(spark, sf_dir):
    """Settings of each part and, where it has none, of the nearest above it: its largest smaller neighbour, and so on."""
    from factgraph.operators import inherit

    parents = _forward(spark, sf_dir).groupBy(F.col("dst").alias("p_partkey")).agg(F.max("src").alias("parent"))
    some = [F.when(F.col("p_partkey") % m == 0, F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))) for k, (m, c) in _SETTINGS.items()]
    own = _t(spark, sf_dir, "part").join(parents, "p_partkey", "left").select(F.col("p_partkey").alias("node"), "parent", F.map_from_entries(F.array_compact(F.array(*some))).alias("settings"))
    return inherit.effective(own).select("node", F.explode("settings").alias("name", "value"))


# intervals and priorities


@query("""
WITH s AS (SELECT user_id, ts AS b, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events WHERE event_type IN ('signup', 'purchase')),
i AS (SELECT user_id, b, e FROM s WHERE event_type = 'signup' AND nt = 'purchase')
SELECT event_id, min(epoch_us(b)) AS begin_us FROM events JOIN i USING (user_id) WHERE event_type = 'error' AND ts BETWEEN b AND e GROUP BY event_id""")
def span_enclosure(spark, sf_dir):
    """Errors within a signup-to-purchase span of their user, with the first such span."""
    events = _t(spark, sf_dir, "events")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marks = events.where("event_type IN ('signup', 'purchase')").select("user_id", "event_type", F.col("ts").alias("b"), F.lead("ts").over(at).alias("e"), F.lead("event_type").over(at).alias("nt"))
    spans = marks.where("event_type = 'signup' AND nt = 'purchase'").select("user_id", "b", "e")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return R.span_enclosure(errors, spans, ["user_id"], "ts", "b", "e", ["b"]).select("event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', b)").alias("begin_us"))


_PATTERNS = [(0, "red widget", None, "exact/widget"), (1, "small ", "", "small/*"), (2, "s", "ring", "s/*ring"), (3, "", "bolt", "any/*"), (4, "re", "", "re/*")]


@query(f"""
WITH a(priority, prefix, suffix, target) AS (VALUES {', '.join(f"({p}, '{a}', {'NULL' if b is None else repr(b)}, '{t}')" for p, a, b, t in _PATTERNS)})
SELECT p_partkey, priority::INT AS priority, CASE WHEN suffix IS NULL THEN target ELSE replace(target, '*', substr(p_name, length(prefix) + 1, length(p_name) - length(prefix) - length(suffix))) END AS resolved
FROM part JOIN a ON CASE WHEN suffix IS NULL THEN p_name = prefix ELSE starts_with(p_name, prefix) AND ends_with(p_name, suffix) AND length(p_name) >= length(prefix) + length(suffix) END
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority) = 1""")
def alias_theta(spark, sf_dir):
    """Path-alias expansion: a theta join with a handful of patterns, of which the first match counts."""
    from factgraph.operators.resolve import expand_aliases

    aliases = spark.createDataFrame(_PATTERNS, "priority int, prefix string, suffix string, target string")
    found = expand_aliases(_t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("specifier")), aliases, ["p_partkey"])
    return found.select("p_partkey", "priority", F.col("target").alias("resolved"))


_SIGNALS = [("buyer", 0, "package", 0, "purchase"), ("buyer", 0, "marker", 0, "signup"), ("broken", 1, "package", 0, "error"), ("browser", 2, "package", 0, "view"), ("browser", 2, "marker", 0, "click")]


@query(f"""
WITH g(framework, place, kind, ord, signal) AS (VALUES {', '.join(map(repr, _SIGNALS))}),
u AS (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS project_id, event_type AS signal, max(event_id)::VARCHAR AS version FROM events GROUP BY ALL),
h AS (SELECT project_id, framework, kind, signal, version FROM u JOIN g USING (signal)),
f AS (SELECT project_id, framework, bool_or(kind = 'package') AS dep, bool_or(kind = 'marker') AS mark, max(CASE WHEN kind = 'package' THEN version END) AS version,
  string_agg(CASE kind WHEN 'package' THEN 'depends on ' || signal || ' ' || version ELSE 'has ' || signal END, '; ' ORDER BY kind DESC) AS evidence FROM h GROUP BY ALL)
SELECT project_id, framework, CASE WHEN dep AND mark THEN 'certain' WHEN dep THEN 'likely' ELSE 'possible' END AS confidence, version, evidence FROM f
UNION ALL SELECT DISTINCT project_id, 'node', 'likely', NULL, 'has package.json' FROM u ANTI JOIN f USING (project_id)""")
def signal_detect(spark, sf_dir):
    """Detection from packages and markers, and how sure they make: a user's day is a project that has its events."""
    from factgraph.operators import frameworks

    project = F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("project_id")
    used = _t(spark, sf_dir, "events").groupBy(project, "event_type").agg(F.max("event_id").cast("string").alias("version"))
    dependencies = used.select("project_id", F.col("event_type").alias("name"), "version", F.lit("dependencies").alias("section"))
    signals = spark.createDataFrame(_SIGNALS, frameworks.SIGNALS)
    found = frameworks.detect(dependencies, used.select("project_id", F.col("event_type").alias("entry")), used, signals)
    return found.select("project_id", "framework", "confidence", "version", F.array_join("evidence", "; ").alias("evidence"))


@query("""
WITH s AS (SELECT page_id, unnest(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')) AS raw FROM pages),
d AS (SELECT page_id, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN '[' || raw || ']' WHEN length(raw) = 2 THEN '(' || raw || ')' ELSE raw END AS raw FROM s)
SELECT raw, CASE WHEN raw LIKE '[%' THEN 'dynamic' WHEN raw LIKE '(%' THEN 'route_group' ELSE 'static' END AS kind, trim(raw, '[]()') AS name, count(*) AS pages FROM d GROUP BY 1, 2, 3""")
def segment_kinds(spark, sf_dir):
    """Route segments parsed from URL paths, with numbers as parameters and languages as groups."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    raw = _t(spark, sf_dir, "pages").select(F.explode(F.filter(F.split(path, "/"), lambda x: x != "")).alias("raw"))
    raw = raw.select(F.when(F.col("raw").rlike("^[0-9]+$"), F.concat(F.lit("["), "raw", F.lit("]"))).when(F.length("raw") == 2, F.concat(F.lit("("), "raw", F.lit(")"))).otherwise(F.col("raw")).alias("raw"))
    return raw.groupBy("raw").agg(F.count("*").alias("pages")).select("raw", C.segment_kind(F.col("raw")).alias("kind"), C.segment_name(F.col("raw")).alias("name"), "pages")


@query("""
WITH w AS (SELECT role, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM conversations),
n AS (SELECT CASE WHEN role = 'user' THEN 'use' || upper(substr(word, 1, 1)) || substr(word, 2) ELSE word END AS name, turn % 2 = 1 AS jsx FROM w)
SELECT name, jsx, CASE WHEN regexp_matches(name, '^use[A-Z0-9]') THEN 'hook' WHEN jsx AND (regexp_matches(name, '^[A-Z]') OR name = 'default') THEN 'component' ELSE 'none' END AS react_role, count(*) AS n FROM n GROUP BY 1, 2, 3""")
def role_classify(spark, sf_dir):
    """Every word of the conversations as a function's name."""
    words = _t(spark, sf_dir, "conversations").select("role", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word"))
    name = F.when(F.col("role") == "user", F.concat(F.lit("use"), F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))).otherwise(F.col("word"))
    rows = words.select(name.alias("name"), (F.col("turn") % 2 == 1).alias("jsx")).groupBy("name", "jsx").agg(F.count("*").alias("n"))
    return rows.select("name", "jsx", F.coalesce(C.react_role(F.col("name"), F.col("jsx")), F.lit("none")).alias("react_role"), "n")


# findings: events as diagnostics

_FINDINGS = """f AS (SELECT event_id, user_id, ts, 'r/' || event_type AS rule_id,
  CASE event_type WHEN 'error' THEN 'security' WHEN 'click' THEN 'imports' WHEN 'view' THEN 'performance' WHEN 'signup' THEN 'react' ELSE 'dependencies' END AS category,
  CASE WHEN value > 80 THEN 'critical' WHEN value > 60 THEN 'high' WHEN value > 40 THEN 'medium' WHEN value > 20 THEN 'low' ELSE 'info' END AS severity,
  CASE user_id % 4 WHEN 0 THEN 'certain' WHEN 1 THEN 'likely' WHEN 2 THEN 'possible' ELSE 'unknown' END AS confidence FROM events)"""
_POINTS = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 1 END * CASE confidence WHEN 'certain' THEN 10 WHEN 'likely' THEN 7 WHEN 'possible' THEN 4 ELSE 2 END"


def _findings(spark, sf_dir):
    """Events as diagnostics; a user is a project."""
    e, v, u = F.col("event_type"), F.col("value"), F.col("user_id") % 4
    category = F.when(e == "error", "security").when(e == "click", "imports").when(e == "view", "performance").when(e == "signup", "react").otherwise("dependencies")
    severity = F.when(v > 80, "critical").when(v > 60, "high").when(v > 40, "medium").when(v > 20, "low").otherwise("info")
    confidence = F.when(u == 0, "certain").when(u == 1, "likely").when(u == 2, "possible").otherwise("unknown")
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.concat(F.lit("r/"), e).alias("rule_id"), category.alias("category"), severity.alias("severity"), confidence.alias("confidence"))


@query(f"""WITH {_FINDINGS} SELECT event_id, rule_id, severity, confidence FROM f
WHERE rule_id = 'r/view' OR (rule_id NOT IN ('r/click') AND list_position(['info', 'low', 'medium', 'high', 'critical'], severity) >= 3 AND list_position(['unknown', 'possible', 'likely', 'certain'], confidence) >= 2)""")
def finding_filter(spark, sf_dir):
    from factgraph.operators.report import Config, apply_config

    config = Config(min_severity="medium", min_confidence="possible", enable=("r/view",), disable=("r/click",))
    return apply_config(_findings(spark, sf_dir), config).select("event_id", "rule_id", "severity", "confidence")


_SCORES = f"""{_FINDINGS}, m AS (SELECT user_id, unnest([{_list(fixed.MONITORED)}]) AS category FROM (SELECT DISTINCT user_id FROM f)), p AS (SELECT user_id, category, sum({_POINTS})::BIGINT AS t FROM f GROUP BY 1, 2),
s AS (SELECT coalesce(m.user_id, p.user_id) AS user_id, coalesce(m.category, p.category) AS category, coalesce(t, 0) AS tenths FROM m FULL JOIN p ON m.user_id = p.user_id AND m.category = p.category),
c AS (SELECT user_id, category, ((greatest(0, 1000 - tenths) + 5) // 10)::INT AS score, tenths FROM s)"""


@query(f"WITH {_SCORES} SELECT user_id, category, score, tenths FROM c UNION ALL SELECT user_id, 'overall', ((sum(score) * 2 + count(*)) // (count(*) * 2))::INT, sum(tenths)::BIGINT FROM c GROUP BY 1")
def scorecard(spark, sf_dir):
    """Each project's category scores, and the overall one."""
    scores = R.category_scores(_findings(spark, sf_dir), ["user_id"])
    total = R.overall(scores, ["user_id"]).select("user_id", F.lit("overall").alias("category"), F.col("overall").alias("score"), "tenths")
    return scores.unionByName(total)


@query(f"""WITH {_FINDINGS}, d AS (SELECT user_id, category, rule_id, sum({_POINTS})::BIGINT AS tenths, count(*) AS findings FROM f GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY tenths DESC, rule_id)::INT AS place FROM d""")
def deductions(spark, sf_dir):
    at = Window.partitionBy("user_id", "category").orderBy(F.desc("tenths"), "rule_id")
    return R.deductions(_findings(spark, sf_dir), ["user_id"]).withColumn("place", F.row_number().over(at))


@query(f"WITH {_FINDINGS} SELECT severity, category, count(*) AS n FROM f GROUP BY GROUPING SETS ((severity), (category), ())")
def summary_sets(spark, sf_dir):
    """Counts by severity, by category and in all, in one pass."""
    from factgraph.operators import report

    return report.summary(_findings(spark, sf_dir))


def _as_report(spark, sf_dir):
    """The findings with a report's columns: a user is a project, a second a place."""
    return _findings(spark, sf_dir).select("*", F.col("user_id").alias("project_id"), F.lit("a/b.ts").alias("path"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").alias("start"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("message"), F.col("rule_id").alias("title"))


@query(f"WITH {_FINDINGS} SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, rule_id, event_id)::INT AS place FROM f")
def report_order(spark, sf_dir):
    """Total order of a project's findings."""
    from factgraph.operators import report

    return report.places(_as_report(spark, sf_dir)).select("event_id", "user_id", F.col("place").cast("int").alias("place"))


@query(f"WITH {_FINDINGS} SELECT rule_id, severity, category FROM f QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY ts, event_id) = 1")
def sarif_rules(spark, sf_dir):
    """The first finding of each rule, by a partial aggregate."""
    from factgraph.operators import report

    return report.first_of_each_rule(_as_report(spark, sf_dir)).select("rule_id", "severity", "category")


@query(f"WITH {_FINDINGS} SELECT bool_or(severity IN ('high', 'critical')) AS fails, max(list_position(['info', 'low', 'medium', 'high', 'critical'], severity))::INT - 1 AS worst FROM f")
def threshold_gate(spark, sf_dir):
    """Whether a build fails: any finding of high severity or above."""
    from factgraph.operators import report

    return report.gate(_findings(spark, sf_dir), "high")


_DAYS = "k AS (SELECT DISTINCT event_type || '|' || user_id AS key, date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS day FROM events)"


def _day_keys(spark, sf_dir):
    """Each day's findings."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return _t(spark, sf_dir, "events").select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), day.alias("day")).distinct()


@query(f"WITH {_DAYS} SELECT key, day FROM k EXCEPT SELECT key, day + 1 FROM k")
def watch_new(spark, sf_dir):
    """What each day has that the day before it hadn't."""
    days = _day_keys(spark, sf_dir)
    return R.difference(days, days.withColumn("day", F.col("day") + 1), ["key", "day"])


@query(f"WITH {_DAYS} SELECT key, day + 1 AS day FROM k EXCEPT SELECT key, day FROM k")
def watch_resolved(spark, sf_dir):
    """What the day before each day had and the day itself hasn't."""
    days = _day_keys(spark, sf_dir)
    return R.difference(days.withColumn("day", F.col("day") + 1), days, ["key", "day"])


@query(f"""WITH {_DAYS} SELECT key, day, 'opened' AS change FROM (SELECT key, day FROM k EXCEPT SELECT key, day + 1 FROM k)
UNION ALL SELECT key, day, 'resolved' FROM (SELECT key, day + 1 AS day FROM k EXCEPT SELECT key, day FROM k)""")
def watch_state(spark, sf_dir):
    """The same from a stream with a state for each finding, which comes in three parts and is stopped between them."""
    from factgraph.operators.shared import scratch
    from factgraph.streaming import lifetimes as L

    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    start, day = 1704067200, 86400  # 2024-01-01
    seen = _t(spark, sf_dir, "events").select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), F.timestamp_micros(micros + start * 1_000_000).alias("at"))
    folder = scratch(spark, "watch_state")
    last = seen.agg(F.max(F.unix_seconds("at")).alias("s")).first()["s"] or start
    third = (last - start) // 3 + 1
    closing = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.timestamp_seconds(F.lit(last + 3 * day)).alias("at"))
    own = F.floor((F.unix_seconds("at") - start) / third)
    for part in (seen.where(own <= 0), seen.where(own == 1), seen.where(own >= 2), closing):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("key string, at timestamp").parquet(f"{folder}/in")
        L.advance(L.lifetimes(stream, day), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(L.CHANGES).parquet(f"{folder}/out").select("key", (F.col("period") - start // day).cast("int").alias("day"), "change")


@query("""
WITH c AS (SELECT doc_id, n_chars AS size, n_chars % 5 AS mtime, md5(text) AS hash FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
n AS (SELECT d.doc_id, n_chars + coalesce(toxic, 0) AS size, n_chars % 5 AS mtime, md5(text || CASE WHEN quality = 0 THEN '!' ELSE '' END) AS hash FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT n.doc_id, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN c.size = n.size AND c.mtime = n.mtime AND n.mtime <> 0 THEN 'fresh' WHEN c.hash = n.hash THEN 'refreshed' ELSE 'stale' END AS state FROM n LEFT JOIN c ON c.doc_id = n.doc_id""")
def cache_lookup(spark, sf_dir):
    """Cached files against new ones: equal metadata, equal content, changed, or unknown; labelled documents are cached."""
    from factgraph.operators.cache import lookup

    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    known = docs.join(labels, "doc_id", "left")
    mtime = F.col("n_chars") % 5
    cached = docs.join(labels, "doc_id", "left_semi").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), mtime.alias("mtime_ms"), F.md5("text").alias("content_hash"))
    now = known.select(F.col("doc_id").cast("string").alias("path"), (F.col("n_chars") + F.coalesce("toxic", F.lit(0))).alias("size"), mtime.alias("mtime_ms"), F.md5(F.concat("text", F.when(F.col("quality") == 0, "!").otherwise(""))).alias("content_hash"))
    return lookup(now, cached, ["path"]).select(F.col("path").cast("long").alias("doc_id"), "state")


_VERSIONS = """WITH c AS (SELECT doc_id, md5(text || '|' || coalesce(lang, '')) AS h FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
n AS (SELECT d.doc_id, md5(text || CASE WHEN quality = 0 THEN '!' ELSE '' END || '|' || coalesce(lang, '')) AS h FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(toxic, 0) = 0)"""


def _versions(spark, sf_dir):
    """Two snapshots of the documents: labelled ones; then all but toxic ones, those of low quality with another text."""
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _t(spark, sf_dir, "labels")
    now = docs.join(labels, "doc_id", "left").where("coalesce(toxic, 0) = 0")
    changed = F.concat("text", F.when(F.col("quality") == 0, "!").otherwise(""))
    return docs.join(labels, "doc_id", "left_semi"), now.select("doc_id", changed.alias("text"), "lang")


@query(f"{_VERSIONS} SELECT coalesce(c.doc_id, n.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM c FULL JOIN n ON c.doc_id = n.doc_id WHERE c.h IS DISTINCT FROM n.h")
def fingerprint_changes(spark, sf_dir):
    """What changed between two snapshots, found from the root of their digest trees down."""
    from factgraph.operators import merkle

    return merkle.changes(*_versions(spark, sf_dir), ["doc_id"], ["text", "lang"])


@query(f"{_VERSIONS} SELECT doc_id, h AS hash FROM n")
def cache_save(spark, sf_dir):
    """A cache of the first snapshot, brought to the second by writing the buckets that change."""
    from factgraph.operators import buckets, merkle
    from factgraph.operators.shared import scratch

    hashed = lambda df: df.select("doc_id", F.md5(F.concat_ws("|", "text", F.coalesce("lang", F.lit("")))).alias("hash"))
    before, after = map(hashed, _versions(spark, sf_dir))
    folder = scratch(spark, "cache_save")
    buckets.save(before, folder, ["doc_id"])
    found = cut_lineage(merkle.changes(before, after, ["doc_id"], ["hash"]))
    buckets.save(after.join(found.where("change <> 'removed'"), "doc_id", "left_semi"), folder, ["doc_id"], gone=found.where("change = 'removed'"))
    return buckets.load(spark, folder).select("doc_id", "hash")


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), p AS (SELECT DISTINCT '/' || regexp_extract(title, '^\\w+') AS path FROM (SELECT regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages))
SELECT CASE WHEN path IS NOT NULL THEN 'project' WHEN starts_with(href, '/') THEN 'unresolved' ELSE 'external' END AS kind, count(*) AS imports, count(DISTINCT href) AS targets FROM h LEFT JOIN p ON path = href GROUP BY 1""")
def import_fanout(spark, sf_dir):
    """Links resolved against a set of targets, and counted by outcome."""
    pages = _t(spark, sf_dir, "pages")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    targets = pages.select(F.concat(F.lit("/"), F.regexp_extract(F.regexp_extract("html", "<title>([^<]*)", 1), r"^\w+", 0)).alias("href")).distinct().withColumn("hit", F.lit(True))
    kind = F.when(F.col("hit"), "project").when(F.col("href").startswith("/"), "unresolved").otherwise("external")
    return hrefs.join(targets, "href", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("imports"), F.countDistinct("href").alias("targets"))


@query("""
WITH l(nation, lang, stage) AS (SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN 'ecmascript' WHEN n_regionkey = 2 THEN 'other' END, n_nationkey % 3 FROM nation),
f AS (SELECT c_custkey AS id, c_nationkey AS nation, 'any' AS lang, 0 AS stage, 1 AS rule_seq FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_nationkey, 'ecmascript', 1, 2 FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT o_orderkey, NULL, 'ecmascript', 2, 3 FROM orders WHERE o_totalprice > 450000)
SELECT id, rule_seq::INT AS rule_seq FROM f LEFT JOIN l ON l.nation = f.nation WHERE l.lang IS NULL OR ((f.lang = 'any' OR f.lang = l.lang) AND l.stage >= f.stage)""")
def rule_union(spark, sf_dir):
    """The union of several rules' findings, admitted by the language and stage of what they point at; unknown passes."""
    from factgraph.operators import rules

    nation = _t(spark, sf_dir, "nation")
    family = F.when(F.col("n_regionkey") < 2, "ecmascript").when(F.col("n_regionkey") == 2, "other")
    languages = nation.select(F.col("n_nationkey").cast("string").alias("language"), family.alias("family"), (F.col("n_nationkey") % 3).alias("reach")).where("family IS NOT NULL")
    catalogue = spark.createDataFrame([("1", "any", 0), ("2", "ecmascript", 1), ("3", "ecmascript", 2)], "rule_id string, languages string, stage int")
    found = [
        _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("language"), F.lit("1").alias("rule_id")),
        _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("language"), F.lit("2").alias("rule_id")),
        _t(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("language"), F.lit("3").alias("rule_id")),
    ]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return rules.admit(every, catalogue, languages).select("id", F.col("rule_id").cast("int").alias("rule_seq"))


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<script>.*?</script>')) AS script FROM pages) SELECT page_id, len(regexp_extract_all(script, '\\b(track|eval)\\('))::INT AS calls FROM c WHERE regexp_matches(script, '\\b(track|eval)\\(')""")
def html_script_scan(spark, sf_dir):
    """Calls of watched functions in inline scripts."""
    scripts = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<script>.*?</script>"), F.lit(0))).alias("script"))
    return scripts.select("page_id", F.regexp_count("script", F.lit(r"\b(track|eval)\(")).alias("calls")).where("calls > 0")


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines FROM documents WHERE len(string_split(text, chr(10))) > 50")
def large_documents(spark, sf_dir):
    """Bodies of more lines than a limit."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines")).where(F.col("lines") > fixed.LARGE_FUNCTION_LINES)


@query("""SELECT o_custkey::VARCHAR AS project_id, o_orderpriority AS path, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2""")
def last_write_wins(spark, sf_dir):
    """Modules keyed by project and path: of all writes the last."""
    from factgraph.operators import semantic

    writes = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return semantic.last_write(writes, "seq")


def queries() -> dict[str, Query]:
    from factgraph.plans import fixtures, tables  # noqa: F401  (tables adds its own)

    return QUERIES | fixtures.queries()


def oracle_sql() -> dict[str, str]:
    from factgraph.plans import fixtures, tables  # noqa: F401

    return ORACLES | fixtures.oracle_sql()
