"""Relational operators that both query families share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import fixed
from factgraph.operators.shared import cut_lineage, forget


def first_match(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alias: str) -> DataFrame:
    """For each key the value of the lowest order: a partial aggregate, not a window."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(alias))


def _number(df: DataFrame, c: str) -> Column:
    """A place as a whole number, so that it can be dealt into stretches."""
    kind = df.schema[c].dataType.simpleString()
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{c}`)")
    return F.unix_micros(c) if kind == "timestamp" else F.col(c).cast("long")


def containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, begin: str, end: str) -> DataFrame:
    """Points with all spans of the same key that contain them (begin <= point <= end).

    A span lies in one or two stretches of the least power of two that isn't shorter than it; points are looked up in a
    stretch of each length that occurs, 64 at most.  So a key with very many points and spans is dealt into stretches,
    and a point meets spans near it only.
    """
    long = _number(spans, end) - _number(spans, begin)
    dealt = spans.where(F.col(begin) <= F.col(end)).withColumn("__level", F.greatest(F.ceil(F.log2(F.greatest(long, F.lit(1)).cast("double"))), F.lit(0)).cast("int") + 1)
    levels = sorted(r[0] for r in dealt.select("__level").distinct().collect())
    first, last = (F.call_function("shiftright", _number(spans, c), F.col("__level")) for c in (begin, end))
    dealt = dealt.withColumn("__stretch", F.explode(F.sequence(first, last)))
    lengths = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    asked = points.withColumn("__level", F.explode(lengths)).withColumn("__stretch", F.call_function("shiftright", _number(points, point), F.col("__level")))
    met = asked.join(dealt, [*keys, "__level", "__stretch"]).drop("__level", "__stretch")
    return met.where((F.col(begin) <= F.col(point)) & (F.col(point) <= F.col(end)))


def span_enclosure(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, begin: str, end: str, order: Sequence[str]) -> DataFrame:
    """Points with the first span of the same key that contains them (begin <= point <= end); points outside go."""
    rest = [c for c in spans.columns if c not in keys]
    inside = containing(points.select(*keys, point).distinct(), spans, keys, point, begin, end)
    best = inside.groupBy(*keys, point).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return points.join(best, [*keys, point]).select(*[points[c] for c in points.columns], "__first.*")


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


#: A relation is squared as long as that makes at most so many times the rows at hand.
GROWTH = 4


def _paths(left: DataFrame, right: DataFrame) -> int:
    """Rows of the join of ``left`` (d) with ``right`` (s), without making it."""
    ends = left.select(F.col("d").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(right.select(F.col("s").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("m")))
    met = ends.groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return met.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def _composed(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select(F.col("s").alias("d"), F.col("d").alias("__d")), "d").select("s", F.col("__d").alias("d")).distinct()


def jumps(step: DataFrame) -> Iterator[DataFrame]:
    """Walks of 1, 2, 4, 8, ... edges as pairs (s, d), until there are none, they are as long as the graph, or they get
    too many: long thin graphs have few, and dense graphs need none, as their paths are short."""
    yield step
    most, long, walks = step.count(), 1, step
    while long <= most and 0 < _paths(walks, walks) <= GROWTH * most:
        walks, long = cut_lineage(_composed(walks, walks)), 2 * long
        yield walks


def doubled(step: DataFrame, nodes: int) -> tuple[list[DataFrame], str]:
    """Walks of exactly 1, 2, 4, ... edges between ``nodes`` nodes, and why there are no longer ones: "none" where none
    exist, "circle" where they are longer than there are nodes, "many" where they are too many to be made."""
    walks, most = [step], step.count()
    while most:
        if 1 << len(walks) - 1 >= nodes:
            return walks, "circle"
        paths = _paths(walks[-1], walks[-1])
        if not paths or paths > GROWTH * most:
            return walks, "many" if paths else "none"
        walks.append(cut_lineage(_composed(walks[-1], walks[-1])))
    return walks, "none"


def with_loops(walks: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """(s, d, w): ``walks`` of ``length`` edges, and for each of ``nodes`` (node) the walk of none."""
    return walks.select("s", "d", F.lit(length).alias("w")).unionByName(nodes.select(F.col("node").alias("s"), F.col("node").alias("d"), F.lit(0).alias("w")))


def along(state: DataFrame, looped: DataFrame, moved: Column, merged: Column) -> DataFrame:
    """One step of a value of ``state`` (node, and it) over walks of :func:`with_loops`: ``moved`` is the value where it
    arrives, ``merged`` the aggregate of all that a node has then, its own among them."""
    return looped.join(state, F.col("s") == F.col("node")).select(F.col("d").alias("node"), moved).groupBy("node").agg(merged)


#: Steps that are taken between two checkpoints.
HOPS = 4


#: Rows of a frontier, or of what is known, that may be sent to all tasks (some megabytes), so that edges stay where they are.
SMALL = 1 << 17


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def reachable(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node, depth) for all nodes that a start reaches over one edge or more; shortest depths.

    While walks of 1, 2, 4, ... edges are few, each round doubles how far the known pairs reach.  From then on a
    frontier moves edge by edge; it ends on cycles, as known pairs are left out.
    """
    step = cut_lineage(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    first = starts.select("start", F.col("start").alias("s")).distinct().join(step, "s")
    known, far, n = cut_lineage(first.select("start", F.col("d").alias("node"), F.lit(1).alias("depth")).distinct()), 1, 0
    for walks in jumps(step):
        before, n = n, known.count()
        if n == before or _paths(known.select(F.col("node").alias("d")), walks) > GROWTH * max(n, 1):
            break
        longer = _sent(known, n).join(walks, F.col("node") == F.col("s")).select("start", F.col("d").alias("node"), (F.col("depth") + far).alias("depth"))
        old, known = known, cut_lineage(known.unionByName(longer).groupBy("start", "node").agg(F.min("depth").alias("depth")))
        forget(old)
        far *= 2
    frontier, depth, n = known.where(F.col("depth") == far), far, known.count()
    while front := frontier.count():
        depth += 1
        following = _sent(frontier, front).join(step, F.col("node") == F.col("s")).select("start", F.col("d").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = cut_lineage(following.join(_sent(known, n), ["start", "node"], "left_anti"))
        known = cut_lineage(known.unionByName(frontier)) if depth % 8 == 0 else known.unionByName(frontier)
        n += front
    return known


#: Members of a component that are listed at once for each start; a multiple of eight, so that runs of written columns stay alike.
LISTED = 1 << 10


def closure(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node) for all nodes that a start reaches over one edge or more, without depths.

    Strong components are searched as one node each, from each component of a start once; their members are listed at the end,
    a component dealt to parts of LISTED members, which are one list each.  What is shuffled is a row for each start and part;
    pairs come from the lists and aren't, and all starts of a part come together, so written as columns they repeat a short run.
    """
    step = cut_lineage(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    groups, whole = contracted(step.where("src <> dst").select(F.col("src").alias("s"), F.col("dst").alias("d")))
    groups = cut_lineage(groups)
    nodes = step.select(F.col("src").alias("node")).union(step.select("dst")).distinct()
    members = nodes.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    asked = cut_lineage(members.join(starts.select(F.col("start").alias("node")).distinct(), "node").select(F.col("node").alias("start"), "component"))
    met = reachable(whole, asked.select(F.col("component").alias("start"))).select(F.col("start").alias("component"), F.col("node").alias("to"))
    own = asked.join(groups.select("component").distinct(), "component", "left_semi").select("component", F.col("component").alias("to"))
    loops = step.where("src = dst").select(F.col("src").alias("component")).join(groups.select(F.col("node").alias("component")), "component", "left_anti")
    own = own.union(asked.join(loops, "component", "left_semi").select("component", F.col("component").alias("to")))
    from factgraph.operators.graph import numbered

    placed = cut_lineage(numbered(members, ["component"], ["node"], "__at"))
    dealt = placed.select("node", F.col("component").alias("to"), F.floor(F.col("__at") / LISTED).alias("__part"))
    parts = dealt.groupBy("to").agg(F.max("__part").alias("__last"))
    ways = asked.join(met.unionByName(own).distinct(), "component").join(parts, "to")
    ways = ways.select("start", "to", F.explode(F.sequence(F.lit(0).cast("long"), "__last")).alias("__part"))
    lists = dealt.groupBy("to", "__part").agg(F.sort_array(F.collect_list("node")).alias("__nodes"))
    spark = edges.sparkSession  # rows are few before pairs are made, so parts aren't left to their size
    n = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ways, lists = (x.repartition(n, "to", "__part") for x in (ways, lists))
    return ways.join(lists.hint("merge"), ["to", "__part"]).select("start", F.explode("__nodes").alias("node"))


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by their smallest node.

    Strong pieces within blocks of the graph become one node each, named by their smallest.  Of the rest,
    nodes without an edge in or out go, and what no long walk leads to, or from.  Each round colours nodes with the
    smallest node that reaches them; from each colour's own node, those of the colour that reach it are its component.
    Both go over walks of 1, 2, 4, ... edges, which are made once: rounds grow with the logarithm of the longest path.
    """
    every = cut_lineage(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d").distinct())
    return contracted(every)[0]


def contracted(step: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, component) as :func:`strong_components` gives them, and the edges (src, dst) between components, of different
    edges (s, d) without loops; ``held`` has the strong pieces within blocks where they are known.

    The second contraction starts from what the first has left, so all edges are joined with their pieces once.
    """
    from factgraph.operators import blocks

    held = blocks.strong_pieces(step) if held is None else held
    outer = step.select(F.col("s").alias("src"), F.col("d").alias("dst"))
    if not held.isEmpty():
        outer = cut_lineage(condensed(outer, held))
    found = _strong(outer.select(F.col("src").alias("s"), F.col("dst").alias("d")))
    if found is None:
        return held, outer
    found = cut_lineage(found)
    above = found.select(F.col("node").alias("component"), F.col("component").alias("__of"))
    inside = held.join(above, "component", "left").select("node", F.coalesce("__of", "component").alias("component"))
    return inside.unionByName(found.join(held.select("node"), "node", "left_anti")), condensed(outer, found)


def _strong(left: DataFrame) -> DataFrame | None:
    """(node, component) of different edges (s, d) without loops, or None."""
    left, n = _trimmed(left, TRIMS)
    nodes = left.select(F.col("s").alias("node")).union(left.select("d")).distinct().count() if n else 0
    walks, ended = doubled(left, nodes)
    found = None
    while ended != "none":
        if ended == "circle":  # all that is no part of a long walk, or between two of them
            live = cut_lineage(_both(walks[-1]))
            walks = [left, *_] = [cut_lineage(_among(w, live)) for w in walks]
        else:
            left, _ = _trimmed(left, TRIMS)
            left = cut_lineage(_among(left, _after_circles(left)))
            walks = [left, *[cut_lineage(_among(w, _both(left))) for w in walks[1:]]]
        colours = cut_lineage(_both(left).select("node", F.col("node").alias("colour")))
        state = _marks(colours)
        if not state[0]:
            break
        looped, once = [with_loops(w, colours, 1) for w in walks], len(walks) if ended == "circle" else max(len(walks), HOPS)
        while True:  # forward minimum
            for i in range(once):
                colours = along(colours, looped[i % len(walks)], F.col("colour"), F.min("colour").alias("colour"))
                if i % HOPS == HOPS - 1 or i == once - 1:
                    colours = cut_lineage(colours)
            before, state = state, _marks(colours)
            if ended == "circle" or before == state:
                break
        members, size = cut_lineage(colours.where("node = colour").select("node", "colour")), -1
        while size != (size := members.count()):  # backwards: what reaches the colour's own node has its colour, if any
            for i in range(once):
                back = looped[i % len(walks)].join(members, F.col("d") == F.col("node")).select(F.col("s").alias("node"), "colour").distinct()
                members = back.join(colours, ["node", "colour"], "left_semi")
                if i % HOPS == HOPS - 1 or i == once - 1:
                    members = cut_lineage(members)
            if ended == "circle":
                break
        sizes = members.groupBy("colour").count().where("count > 1").select("colour")
        group = cut_lineage(members.join(sizes, "colour").select("node", F.col("colour").alias("component")))
        found = group if found is None else found.unionByName(group)
        rest = cut_lineage(colours.select("node").join(members.select("node"), "node", "left_anti"))
        walks = [left, *_] = [cut_lineage(_among(w, rest)) for w in walks]
    return found


#: Rounds in which nodes are trimmed by their degrees before walks are made.
TRIMS = 4


def _both(left: DataFrame) -> DataFrame:
    """(node): nodes with an edge in and an edge out."""
    ends = left.select(F.col("s").alias("node"), F.lit(1).alias("out")).unionByName(left.select(F.col("d").alias("node"), F.lit(0).alias("out")))
    return ends.groupBy("node").agg(F.min("out").alias("a"), F.max("out").alias("b")).where("a < b").select("node")


def _after_circles(left: DataFrame) -> DataFrame:
    """(node): nodes that end walks of any length, as far as steps go on taking nodes away."""
    nodes = cut_lineage(left.select(F.col("s").alias("node")).union(left.select("d")).distinct())
    looped, n, reach = with_loops(left, nodes, 1), -1, 0
    levels = nodes.select("node", F.lit(0).alias("level"))
    while n != (n := levels.where(F.col("level") == reach).count()) and n:
        for _ in range(HOPS):
            levels = along(levels, looped, (F.col("level") + F.col("w")).alias("level"), F.max("level").alias("level"))
        levels, reach = cut_lineage(levels), reach + HOPS
    return levels.where(F.col("level") == reach).select("node")


def _trimmed(left: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """``left`` without nodes that lack an edge in or out, again and again (``most`` times), and its size."""
    n, rounds = left.count(), 0
    while n and rounds != most:
        before, old, left, rounds = n, left, cut_lineage(_among(left, _both(left))), rounds + 1
        n = left.count()
        if n == before:
            break
    return left, n


def _among(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The walks between ``nodes`` (node)."""
    return walks.join(nodes.select(F.col("node").alias("s")), "s", "left_semi").join(nodes.select(F.col("node").alias("d")), "d", "left_semi").select("s", "d")


def _marks(colours: DataFrame) -> tuple:
    """Equal for equal colours, which only fall: a count and a sum of hashes."""
    return tuple(colours.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first())


def condensed(edges: DataFrame, groups: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst) between components: each node of ``groups`` (node, component) stands for its component; no circles."""
    a, b = (groups.select(F.col("node").alias(f"__{x}"), F.col("component").alias(f"__{x}c")) for x in "ab")
    met = edges.join(a, F.col(src) == F.col("__a"), "left").join(b, F.col(dst) == F.col("__b"), "left")
    out = met.select(F.coalesce("__ac", F.col(src)).alias("src"), F.coalesce("__bc", F.col(dst)).alias("dst"))
    return out.where("src <> dst").distinct()


def weight(severity: Column, confidence: Column) -> Column:
    """Points of a finding in tenths: whole numbers, so sums are exact."""
    s, c = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, points in fixed.SEVERITY_WEIGHTS.items():
        s = F.when(severity == name, F.lit(points)).otherwise(s)
    for name, tenths in fixed.CONFIDENCE_TENTHS.items():
        c = F.when(confidence == name, F.lit(tenths)).otherwise(c)
    return s * c


def deductions(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tenths of points by (keys, category, rule_id)."""
    return findings.groupBy(*keys, "category", "rule_id").agg(F.sum(weight(F.col("severity"), F.col("confidence"))).cast("long").alias("tenths"), F.count("*").alias("findings"))


def category_scores(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, category, score, tenths): 100 less the points, at least 0; monitored categories always, others where they
    have findings.  Without ``keys`` all findings are one project's, which may have none."""
    points = deductions(findings, keys).groupBy(*keys, "category").agg(F.sum("tenths").alias("tenths"))
    projects = findings.select(*keys).distinct() if keys else findings.sparkSession.range(1).select()
    monitored = projects.withColumn("category", F.explode(F.array(*map(F.lit, fixed.MONITORED)))).withColumn("tenths", F.lit(0).cast("long"))
    every = monitored.unionByName(points).groupBy(*keys, "category").agg(F.sum("tenths").alias("tenths"))
    left = F.greatest(F.lit(0), F.lit(1000) - F.col("tenths"))
    return every.select(*keys, "category", F.floor((left + 5) / 10).cast("int").alias("score"), "tenths")


def overall(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, overall, tenths): the categories' mean, rounded half up."""
    return scores.groupBy(*keys).agg(F.floor((F.sum("score") * 2 + F.count("*")) / (F.count("*") * 2)).cast("int").alias("overall"), F.sum("tenths").alias("tenths"))
