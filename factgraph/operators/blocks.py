"""Graphs in blocks of bounded size: what lies within a block is done by one task, what leads to others moves in rounds.

Blocks are ranges of nodes, so edges between nodes that are near by name cost no round.  Any dealing gives the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.shared import cut_lineage, forget

#: Edges that lead into the nodes of a block, about.
EDGES = 1 << 20
#: So many bytes of bitmaps are merged at a time.
MERGED = 1 << 24
#: Searches for strong pieces of a block, and how many in a row may find none.
PIVOTS, MISSES = 256, 8


def dealt(step: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, d, a, b): the edges with their ends' blocks, and (node, block)."""
    n = max(1, -(-step.count() // EDGES))
    rows = step.where("s IS NOT NULL AND d IS NOT NULL").select(F.col("d").alias("node"), "s", F.lit(True).alias("edge"))
    own = nodes.where("node IS NOT NULL").select("node", F.col("node").alias("s"), F.lit(False).alias("edge"))
    placed = cut_lineage(rows.unionByName(own).repartitionByRange(n, "node").withColumn("block", F.spark_partition_id()))
    blocks = placed.where("NOT edge").select("node", "block").distinct()
    ends = placed.where("edge").join(blocks.select(F.col("node").alias("s"), F.col("block").alias("a")), "s")
    return cut_lineage(ends.select("s", F.col("node").alias("d"), "a", F.col("block").alias("b"))), blocks


def _ranges(at: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from at[k] to before at[k + 1] for each k of ``nodes``, and how many each has."""
    long = at[nodes + 1] - at[nodes]
    return np.repeat(at[nodes] - np.cumsum(long) + long, long) + np.arange(long.sum()), long


def _after(s: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the edges of each node lead, and where its own begin there."""
    return d[np.argsort(s, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))])


#: A block's edges are held as arrays for levels, in blocks of so many times EDGES.
HELD = 4
#: Rounds after which a circle is looked for, as very many may go before one is met.
ASKED = 64


def _range(c: Column, bounds: list) -> Column:
    """How many of ``bounds`` aren't above ``c``, by halves."""

    def of(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c < F.lit(bounds[mid]), of(low, mid)).otherwise(of(mid + 1, high))

    return of(0, len(bounds))


def _packed(edges: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """A block as arrays: its nodes, where its inner edges and those to other blocks lead, levels and edges that are to come."""
    own = own.sort_values("node")
    nodes = own["node"].to_numpy(np.int64)
    s, d, inner = np.searchsorted(nodes, edges["s"].to_numpy(np.int64)), edges["d"].to_numpy(np.int64), edges["inner"].to_numpy(bool)
    to, at = _after(s[inner], np.searchsorted(nodes, d[inner]), len(nodes))
    ends, over = _after(s[~inner], d[~inner], len(nodes))
    arrays = {"nodes": nodes, "at": at, "to": to, "over": over, "ends": ends, "level": own["level"], "waiting": own["waiting"]}
    return pd.DataFrame({"block": [own["block"].iloc[0]], **{k: [np.asarray(v, np.int64).tobytes()] for k, v in arrays.items()}})


def _settled(block: pd.DataFrame, inbox: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    """The block's state (no ``to``) once all nodes are settled that wait for no edge any more, and what their edges bring to
    other blocks: nodes, levels, edges."""
    p = block.iloc[0]
    nodes, at, to, over, ends = (np.frombuffer(p[c], np.int64) for c in ("nodes", "at", "to", "over", "ends"))
    level, waiting = (np.frombuffer(p[c], np.int64).copy() for c in ("level", "waiting"))
    for d, up, n in zip(*(inbox[c] for c in "xyz")):
        places = np.searchsorted(nodes, np.frombuffer(d, np.int64))
        level[places] = np.maximum(level[places], np.frombuffer(up, np.int64))
        waiting[places] -= np.frombuffer(n, np.int64)
    done, front = [np.zeros(0, np.int64)], np.flatnonzero(waiting == 0)
    while len(front):
        waiting[front] = -1
        done.append(front)
        places, long = _ranges(at, front)
        met = to[places]
        np.maximum.at(level, met, np.repeat(level[front] + 1, long))
        met, n = np.unique(met, return_counts=True)
        waiting[met] -= n
        front = met[waiting[met] == 0]
    new = np.concatenate(done)
    places, long = _ranges(over, new)
    order = np.argsort(ends[places], kind="stable")
    d, up = ends[places][order], np.repeat(level[new] + 1, long)[order]
    rows = [(None, p["block"], int((waiting > 0).sum()), level.tobytes(), waiting.tobytes(), None)]
    if len(d):
        begins = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        d, up, n = d[begins], np.maximum.reduceat(up, begins), np.diff(np.append(begins, len(d)))
        cuts = [0, *np.searchsorted(d, bounds), len(d)]
        rows += [(k, p["block"], 0, d[i:j].tobytes(), up[i:j].tobytes(), n[i:j].tobytes()) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
    return pd.DataFrame(rows, columns=["to", "block", "rest", "x", "y", "z"]).astype({"to": "Int32"})


def levels(step: DataFrame, first: DataFrame, circle) -> DataFrame | None:
    """(node, level) of ``step`` (s, d; whole numbers, each edge once) from levels of all nodes that aren't too high; None if there
    is a circle.

    A node is settled when all edges to it have come.  Each round settles what it can within the blocks that got something, and hands
    over what leads to other blocks, so an edge is followed once.  ``circle`` says whether there is a circle; it is asked once,
    when rounds get many.
    """
    step, first = step.where("s IS NOT NULL AND d IS NOT NULL"), first.where("node IS NOT NULL")
    many = max(1, -(-step.count() // (HELD * EDGES)))
    bounds = []
    if many > 1:
        ends = step.select("s").union(first.select("node"))
        found = ends.agg(F.percentile_approx("s", [k / many for k in range(1, many)], 100 * many)).first()[0]
        bounds = sorted(set(found or []))
    block = lambda c: _range(F.col(c), bounds)
    waiting = step.groupBy(F.col("d").alias("node")).agg(F.count(F.lit(1)).alias("waiting"))
    own = first.join(waiting, "node", "left").select(block("node").alias("block"), "node", "level", F.coalesce("waiting", F.lit(0)).alias("waiting"))
    edges = step.select(block("s").alias("block"), "s", "d", (block("s") == block("d")).alias("inner"))
    arrays = "block int, nodes binary, at binary, to binary, over binary, ends binary, level binary, waiting binary"
    packed = cut_lineage(edges.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(_packed, arrays))
    held, state = packed.drop("level", "waiting"), packed.select("block", "level", "waiting", F.lit(0).cast("long").alias("rest"))
    schema, places = "to int, block int, rest long, x binary, y binary, z binary", np.array(bounds, np.int64)
    of = lambda a, b: _settled(a, b, places)
    inbox, rounds, made = step.sparkSession.createDataFrame([], schema), 0, None
    touched = state.select("block")
    while True:
        asked = held.join(state.drop("rest"), "block").join(touched, "block", "left_semi")
        before, made = made, cut_lineage(asked.groupBy("block").cogroup(inbox.groupBy("to")).applyInPandas(of, schema))
        new = made.where("to IS NULL").select("block", F.col("x").alias("level"), F.col("y").alias("waiting"), "rest")
        old, state = state, cut_lineage(state.join(touched, "block", "left_anti").unionByName(new))
        inbox = made.where("to IS NOT NULL")
        touched, rounds = inbox.select(F.col("to").alias("block")).distinct(), rounds + 1
        if before is not None:
            forget(before)
            forget(old)
        if inbox.isEmpty():
            break
        if rounds == ASKED and circle():
            return None
    if not state.where("rest > 0").isEmpty():
        return None

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for nodes, level in zip(batch["nodes"], batch["level"]):
                yield pd.DataFrame({"node": np.frombuffer(nodes, np.int64), "level": np.frombuffer(level, np.int64)})

    found = held.select("block", "nodes").join(state, "block").select("nodes", "level").mapInPandas(listed, "node long, level long")
    return found.select(F.col("node").cast(first.schema["node"].dataType).alias("node"), F.col("level").cast("int").alias("level"))


def _found(after: tuple[np.ndarray, np.ndarray], start: int, free: np.ndarray) -> np.ndarray:
    """Which of the ``free`` nodes a search from ``start`` meets."""
    (to, at), seen = after, np.zeros(len(free), bool)
    seen[start], front = True, np.array([start])
    while len(front):
        ends = to[_ranges(at, front)[0]]
        front = np.unique(ends[free[ends] & ~seen[ends]])
        seen[front] = True
    return seen


def pieces(s: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """For each node the least one of a strongly connected piece that holds it, or -1; large pieces are found, small ones
    may not be."""
    piece, free = np.full(n, -1), np.ones(n, bool)
    ways, back = _after(s, d, n), _after(d, s, n)
    both = np.minimum(np.bincount(s, minlength=n), np.bincount(d, minlength=n))
    misses = 0
    for start in np.argsort(-both, kind="stable"):
        if not both[start] or misses >= MISSES:
            break
        if not free[start]:
            continue
        held = np.flatnonzero(_found(ways, start, free) & _found(back, start, free))
        free[held] = False
        if len(held) > 1:
            piece[held], misses = held[0], 0
        else:
            misses += 1
    return piece


def strong_pieces(step: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): strongly connected pieces of two nodes or more within blocks, named by their least node; ``nodes``
    (node) are all nodes, where they are known."""
    if nodes is None:
        nodes = step.select(F.col("s").alias("node")).union(step.select("d")).distinct()
    edges, _ = dealt(step, nodes)

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        names, numbers = np.unique(np.concatenate([rows["s"].to_numpy(), rows["d"].to_numpy()]), return_inverse=True)
        piece = pieces(numbers[: len(rows)], numbers[len(rows) :], len(names))
        return pd.DataFrame({"node": names[piece >= 0], "component": names[piece[piece >= 0]]})

    kind = nodes.schema["node"].dataType
    schema = nodes.select("node").schema.add("component", kind)
    return cut_lineage(edges.where("a = b").groupBy("a").applyInPandas(lambda rows: of(rows[["s", "d"]]), schema))


def _united(bits: np.ndarray, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The ``rows`` of ``bits`` from each of ``begins`` to the next, united; MERGED bytes at a time."""
    out, ends, most = np.zeros((len(begins), bits.shape[1]), bits.dtype), np.append(begins[1:], len(rows)), max(1, MERGED // (8 * bits.shape[1]))
    at = 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + most, "right")))
        for low in range(begins[at], ends[to - 1], most):  # more than one only for a node of very many edges
            high = min(low + most, ends[to - 1])
            cuts = begins[at:to] - low if to - at > 1 else np.zeros(1, np.int64)
            out[at:to] |= np.bitwise_or.reduceat(bits[rows[low:high]], cuts, axis=0)
        at = to
    return out


class _Stripe:
    """Which of the nodes from ``first`` to before ``to`` are before each later node: a bitmap for nodes that have some of them,
    none for those that have none or all."""

    def __init__(self, first: int, to: int, n: int):
        self.first, self.wide = first, to - first
        own = np.arange(self.wide)
        self.bits = np.zeros((n - first + 1, -(-self.wide // 64)), np.uint64)  # the first is for all nodes before
        self.bits[own + 1, own >> 6] = np.uint64(1) << (own & 63).astype(np.uint64)
        self.held = np.zeros(n - first + 1, np.int32)
        self.held[own + 1] = 1
        self.state = np.minimum(self.held, 1).astype(np.uint8) * (2 if self.wide == 1 else 1)  # none, some, all
        self.heavy, self.more = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def weigh(self, ids: np.ndarray, more: np.ndarray) -> None:
        used = (ids >= self.first) & (ids < self.first + self.wide)
        self.heavy, self.more = np.append(self.heavy, ids[used] - self.first), np.append(self.more, more[used])

    def take(self, ends: np.ndarray, many: np.ndarray, begins: np.ndarray, cuts: np.ndarray) -> None:
        """Edges to ``ends``, ``many`` for each, from ``begins``; from one of ``cuts`` to the next none leads to another."""
        rows, s = np.maximum(ends.astype(np.int64) - self.first + 1, 0), np.maximum(begins.astype(np.int64) - self.first + 1, 0)
        at = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        for i, j in zip(cuts, [*cuts[1:], len(ends)]):
            low, high = at[i], at[j]
            state = self.state[s[low:high]]
            best = np.maximum.reduceat(state, at[i:j] - low)
            full = rows[i:j][best == 2]
            self.state[full], self.held[full] = 2, self.wide
            some = best == 1
            if some.any():
                used = (state == 1) & np.repeat(some, many[i:j])
                each = np.add.reduceat(used, at[i:j] - low, dtype=np.int64)[some]
                own = rows[i:j][some]
                sets = self.bits[own] | _united(self.bits, s[low:high][used], np.cumsum(each) - each)
                self.bits[own] = sets
                self.held[own] = np.bitwise_count(sets).sum(1, dtype=np.int32)
                self.state[own] = np.where(self.held[own] == self.wide, 2, 1)

    def weights(self) -> np.ndarray:
        """For each node from ``first``: the summed sizes of those before it, without its own."""
        total = self.held.astype(np.int64)
        if len(self.heavy):
            total[self.state == 2] += self.more.sum()
            some = np.flatnonzero(self.state == 1)
            for at in range(0, len(some), 1024):
                rows = some[at : at + 1024]
                total[rows] += np.unpackbits(self.bits[rows].view(np.uint8), axis=1, bitorder="little")[:, self.heavy].astype(np.int64) @ self.more
            total[self.heavy + 1] -= self.more
        total[1 : self.wide + 1] -= 1
        return total[1:]


#: Edges of a piece, about; nodes of a stripe, at most, and bytes of its bitmaps; nodes whose sums are added at once.
PIECE, WIDTH, STRIPE, SUMMED = 1 << 17, 4096, 1 << 27, 1 << 16


def _stripes(n: int) -> list[tuple[int, int]]:
    """All nodes in stripes whose bitmaps for all later nodes have STRIPE bytes or 64 places at most."""
    out, at = [], 0
    while at < n:
        wide = max(64, min(WIDTH, 8 * STRIPE // (n - at) // 64 * 64))
        out.append((at, min(n, at + wide)))
        at += wide
    return out


def weights_before(step: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, total): the summed sizes of each node and all before it; ``step`` (s, d) has no circles, ``sizes`` (id, size) numbers
    all nodes from 0, and no edge leads to a smaller number where it has a column ``level``.

    Nodes are cut into stripes.  A task takes some stripes; for each, all edges to later nodes pass in their order, and a bitmap
    of the stripe is kept for those nodes that have some but not all of it before them.  So no sets move between tasks: what is read
    is stripes times edges, what is moved the sums of each task.
    """
    from factgraph.operators.graph import numbered

    spark, n = sizes.sparkSession, sizes.count()
    if "level" not in sizes.columns:
        known = levels(step, sizes.select(F.col("id").alias("node"), F.lit(0).alias("level")), lambda: False)
        if known is None:
            raise ValueError("the graph has a cycle")
        placed = cut_lineage(numbered(sizes.join(known.withColumnRenamed("node", "id"), "id"), [], ["level", "id"], "place"))
        a, b = (placed.select(F.col("id").alias(c), F.col("place").alias(f"__{c}")) for c in "sd")
        ordered = step.join(a, "s").join(b, "d").select(F.col("__s").alias("s"), F.col("__d").alias("d"))
        total = weights_before(ordered, placed.select(F.col("place").alias("id"), "size", "level"))
        return placed.select("id", "place").join(total, F.col("place") == F.col("node")).select(F.col("id").alias("node"), "total")
    many = max(1, step.count())
    each, kind = max(1, n * PIECE // many), np.int32 if n < 1 << 31 else np.int64

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d")
        ends, begins, n_each = np.unique(rows["d"].to_numpy(), return_index=True, return_counts=True)
        s = rows["s"].to_numpy()
        cuts, start = [0], ends[0]
        for k, (end, last) in enumerate(zip(ends, np.maximum.reduceat(s, begins))):
            if last >= start:
                cuts.append(k)
                start = end
        arrays = {"ends": ends, "many": n_each, "begins": s, "cuts": cuts}
        return pd.DataFrame({"piece": [ends[0] // each], "low": [ends[0]], "high": [ends[-1]], **{k: [np.asarray(v, kind if k != "many" else np.int64).tobytes()] for k, v in arrays.items()}})

    def heavy(rows: pd.DataFrame) -> pd.DataFrame:
        arrays = {"ends": rows["id"].to_numpy(kind), "many": rows["size"].to_numpy(np.int64) - 1}
        return pd.DataFrame({"piece": [-1], "low": [rows["id"].min()], "high": [rows["id"].max()], **{k: [v.tobytes()] for k, v in arrays.items()}, "begins": None, "cuts": None})

    schema = "piece long, low long, high long, ends binary, many binary, begins binary, cuts binary"
    pieces = step.groupBy(F.floor(F.col("d") / each)).applyInPandas(packed, schema)
    pieces = pieces.unionByName(sizes.where("size > 1").groupBy(F.floor(F.col("id") / PIECE)).applyInPandas(heavy, schema))
    pieces = cut_lineage(pieces.repartition(1).sortWithinPartitions("piece"))  # in order, as each stripe's task reads them

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(n, np.int64)
        for batch in batches:
            array = lambda c, k, t=kind: np.frombuffer(batch[c][k].as_buffer(), t)  # noqa: B023, E731
            for k, (first, to, piece) in enumerate(zip(*(batch[c].to_pylist() for c in ("first", "to", "piece")))):
                if now is None or now.first != first:
                    if now is not None:
                        total[now.first :] += now.weights()
                    now = None  # its bitmaps go before the next are made
                    now = _Stripe(first, to, n)
                if piece < 0:
                    now.weigh(array("ends", k).astype(np.int64), array("many", k, np.int64))
                else:
                    now.take(array("ends", k), array("many", k, np.int64), array("begins", k), array("cuts", k))
        if now is not None:
            total[now.first :] += now.weights()
            for at in range(0, n, SUMMED):
                yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int64()), "sums": pa.array([total[at : at + SUMMED].tobytes()], pa.binary())})

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in rows["sums"])
        return pd.DataFrame({"node": rows["part"].iloc[0] + np.arange(len(total)), "before": total})

    cut = _stripes(n)
    parts = max(1, min(len(cut), 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    stripes = spark.createDataFrame(cut, "first long, to long").repartition(parts)
    later = F.when(F.col("piece") < 0, (F.col("low") < F.col("to")) & (F.col("high") >= F.col("first"))).otherwise(F.col("high") > F.col("first"))
    met = stripes.join(pieces.hint("shuffle_replicate_nl"), later).mapInArrow(counted, "part long, sums binary")
    sums = cut_lineage(met).groupBy("part").applyInPandas(summed, "node long, before long")
    return sizes.join(sums, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), (F.col("size") + F.coalesce("before", F.lit(0))).alias("total"))
