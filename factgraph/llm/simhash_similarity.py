"""SimHash near-duplicates at a Jaccard similarity of word shingles: ball hashing within blocks, exact verification.

At similarity 0.8 of their shingle sets two texts differ in a seventh of the bits of a SimHash, far beyond any ball that
can be listed around 64 bits.  So the fingerprint is wide (BLOCKS of 32 bits), and each block emits the variants within
half of RADIUS over its UNCERTAIN bits, those whose sums are nearest to a tie and hence the likeliest to differ: 37
variants a block, 370 a text.  Texts that share a variant of a block are candidates.  Those that differ in too many bits
of the whole fingerprint, or of a still wider one, go; every other link is verified on the whole shingle sets.

Of a text of few shingles most bits are near a tie, so it also emits its first shingles by hash: two short texts that are
similar share one of those (the prefix filter of set joins), and bits rule out nothing between them.

Variants meet in one shuffle of 16 bytes each.  In the first two blocks, each member of a variant's group is held against
the one with the most links so far, which connects most of what belongs together.  Of what is left, in all blocks, texts
that collide with a component and are apart from it, each is held against the few that are nearest by their sketches; so a text that belongs there costs few tests, however large the group.  Only what is apart even then is held
against all of the component, once for each pair, so the components are those of all colliding pairs.
A bound spares tests that can't succeed: a text has no link if over a fifth of its shingles are in no other candidate,
and two texts have none to each other if those that they can share are too few.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm import bpe, common
from factgraph.llm.components import components

SHINGLE_WORDS = 5
#: Similarity as a fraction, compared in whole numbers.
SIMILARITY = (4, 5)
BLOCKS, BLOCK_BITS = 10, 32
UNCERTAIN, RADIUS = 8, 4
#: At the threshold 48 of the fingerprint's 320 bits differ, with a deviation of 6.4, and 309 of a sketch's, of 16.2.
FAR = 70
SKETCH_WORDS, SKETCH_FAR = 32, 362
SEED = 42
#: Texts of so few shingles also meet by them: few bits are certain there, so fingerprints rule nothing out.
SHORT = 12
#: Above all variants' keys.
SHORT_KEYS = 1 << 62
#: A text apart from its group is first tested against the nearest one of each of NEAREST parts of it.
NEAREST = 8
#: Members of a group that meet others in one task.
MET = 1 << 12
#: Shingles whose bits are summed at a time (sums of so many fit a byte), and characters whose words are held at a time.
SUMMED = 255
STRETCH = 1 << 21

_WORDS64 = BLOCKS * BLOCK_BITS // 64
#: One for each 64 bits: of the fingerprint, then of the sketch.
_OFFSETS = np.arange(1, _WORDS64 + SKETCH_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_MIXERS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
#: Which of the uncertain bits each variant flips.
_FLIPS = np.array([[i in chosen for i in range(UNCERTAIN)] for n in range(RADIUS // 2 + 1) for chosen in combinations(range(UNCERTAIN), n)], np.int64)


def shingles(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> tuple[bytes, np.ndarray]:
    """Digest of the words, and the sorted distinct hashes of their shingles (fewer words: one; none: none)."""
    from xxhash import xxh3_128, xxh64_intdigest

    digest, carried, found = xxh3_128(seed=seed), [], []
    for part in bpe.stretches(text, STRETCH):  # no word is cut; the last words go on to the next stretch
        new = part.encode().lower().split()  # of bytes: ASCII only, as in simhash
        digest.update(b"".join(w + b" " for w in new))
        words = carried + new
        n = len(words) - shingle_words + 1
        if n > 0:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
            found.append(np.unique(np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins, ends[-n:].tolist())), "<u8", n)))
            carried = words[len(words) - shingle_words + 1 :]
        else:
            carried = words
    if not found and carried:
        found.append(np.array([xxh64_intdigest(b" ".join(carried), seed)], "<u8"))
    hashes = found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, "<u8")
    return digest.digest(), hashes


def _margins(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By how much each bit is set more often than not, doubled."""
    sums = np.zeros(64 * len(offsets), np.int64)
    for at in range(0, len(hashes), SUMMED):
        mixed = hashes[at : at + SUMMED, None] + offsets
        for mixer in _MIXERS:
            mixed = (mixed ^ mixed >> np.uint64(33)) * mixer
        mixed ^= mixed >> np.uint64(33)
        sums += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return 2 * sums - len(hashes)


def fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signed longs of the fingerprint, a signed long for each block with its uncertain bits' places as bytes)."""
    margin = _margins(hashes, _OFFSETS[:_WORDS64])
    places = np.argsort(np.abs(margin).reshape(BLOCKS, BLOCK_BITS), axis=1, kind="stable")[:, :UNCERTAIN]
    return np.packbits(margin > 0, bitorder="little").view("<i8"), places.astype(np.uint8).view("<i8").ravel()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A wider fingerprint, of candidates only."""
    return np.packbits(_margins(hashes, _OFFSETS[_WORDS64:]) > 0, bitorder="little").view("<i8")


def variants(prints: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """Keys of all variants, a row for each text: the block's number above the block's 32 bits."""
    blocks = prints.astype("<i8").view("<u4").astype(np.int64).reshape(-1, BLOCKS, 1)
    places = unsure.astype("<i8").view(np.uint8).reshape(-1, BLOCKS, UNCERTAIN)
    masks = (np.int64(1) << places.astype(np.int64)) @ _FLIPS.T
    return ((blocks ^ masks) | np.arange(BLOCKS).reshape(1, -1, 1) << BLOCK_BITS).reshape(len(blocks), -1)


def prefix(hashes: np.ndarray) -> np.ndarray:
    """Keys by which a short text meets all similar ones: the first of its sorted shingles, as many as leave too few others
    for the similarity."""
    p, q = SIMILARITY
    n = len(hashes) if len(hashes) <= SHORT else 0
    return (hashes[: n - -(-p * n // q) + 1 if n else 0] >> np.uint64(2)).astype(np.int64) | SHORT_KEYS


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, version, node, size, prints, unsure, prefix): node is the digest of the words, size the number of distinct
    shingles; texts without any have no prints, and only short ones a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for part, texts in common.steps(batches, "text"):
            found = [shingles(text) for text in texts]
            prints = [fingerprint(h) if len(h) else (none, none) for _, h in found]
            columns = [common.column(part, "doc_id"), common.column(part, "version"), pa.array([n for n, _ in found], pa.binary()), pa.array([len(h) for _, h in found], pa.int64()), _lists([p for p, _ in prints]), _lists([u for _, u in prints]), _lists([prefix(h) for _, h in found])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "node", "size", "prints", "unsure", "prefix"])

    return _texts(docs).mapInArrow(run, "doc_id long, version long, node binary, size long, prints array<long>, unsure array<long>, prefix array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """(node, hashes, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in common.steps(batches, "text"):
            found = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), _lists([h for _, h in found]), _lists([sketch(h) for _, h in found])], names=["node", "hashes", "sketch"])

    return _texts(docs).mapInArrow(run, "node binary, hashes array<long>, sketch array<long>")


def collisions(classes: DataFrame) -> DataFrame:
    """(key, tag): variants, and shingles of short texts, that two or more texts emit; ``classes`` has tag, size, prints,
    unsure and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.STEP_ROWS):
                part = batch.slice(at, common.STEP_ROWS)
                prints, unsure = (np.array(common.column(part, c).flatten()) for c in ("prints", "unsure"))
                keys = variants(prints, unsure)
                yield pa.RecordBatch.from_arrays([common.column(part, "tag"), pa.FixedSizeListArray.from_arrays(keys.ravel(), keys.shape[1]).cast(pa.list_(pa.int64()))], names=["tag", "keys"])

    emitted = classes.where("size > 0").select("tag", "prints", "unsure").mapInArrow(run, "tag long, keys array<long>").select("tag", F.explode("keys").alias("key"))
    emitted = emitted.unionByName(classes.where(F.col("size").between(1, SHORT)).select("tag", F.explode("prefix").alias("key")))
    group = Window.partitionBy("key")
    return emitted.select("key", "tag", F.min("tag").over(group).alias("low"), F.max("tag").over(group).alias("high")).where("low < high").select("key", "tag")


def _differ(x: str, y: str, bits: str = "sketch", words: int = SKETCH_WORDS) -> Column:
    return sum(F.bit_count(F.col(f"{x}.{bits}")[k].bitwiseXOR(F.col(f"{y}.{bits}")[k])) for k in range(words))


def _far(x: str, y: str, bits: str = "sketch", words: int = SKETCH_WORDS, most: int = SKETCH_FAR) -> Column:
    """Whether sizes or sketches rule the similarity out; it can't exceed the smaller size by the larger."""
    p, q = SIMILARITY
    least, greatest = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")
    return (q * least < p * greatest) | ((_differ(x, y, bits, words) > most) & (least > SHORT))


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    p, q = SIMILARITY
    left, right = (held.select(F.col("tag").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    met = pairs.join(common.shuffled(left), "a").join(common.shuffled(right), "b")
    return met.where((p + q) * F.size(F.array_intersect("ha", "hb")) >= p * (F.size("ha") + F.size("hb"))).select("a", "b")


def _known(found: DataFrame) -> DataFrame:
    """(tag, root, links) of the texts that have links.

    From each text the way goes to its neighbour of the most links, as long as that has more, four times at most.  Texts
    of one root are connected; connected ones may have several, which costs tests and no link.
    """
    links = found.select(F.explode(F.array("a", "b")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("links"))
    both = found.select(F.col("a").alias("x"), F.col("b").alias("tag")).unionByName(found.select(F.col("b").alias("x"), F.col("a").alias("tag")))
    ways = both.join(common.shuffled(links), "tag").unionByName(links.select(F.col("tag").alias("x"), "tag", "links"))
    up = ways.groupBy(F.col("x").alias("tag")).agg(F.max(F.struct("links", "tag")).alias("up"), F.max(F.when(F.col("x") == F.col("tag"), F.col("links"))).alias("links"))
    up = common.cut_lineage(up.select("tag", F.col("up.tag").alias("root"), "links"))
    for _ in range(2):
        above = up.select(F.col("tag").alias("root"), F.col("root").alias("top"))
        up = up.join(common.shuffled(above), "root").select("tag", F.col("top").alias("root"), "links")
    return common.cut_lineage(up)


def _apart(met: DataFrame, known: DataFrame | None) -> DataFrame:
    """``met`` without the groups that are connected as a whole; with each text's root, and the group's ``centre``, the
    member of the most links."""
    if known is None:
        placed = met.withColumn("root", F.col("tag")).withColumn("links", F.lit(0).cast("long"))
    else:
        placed = met.join(common.shuffled(known), "tag", "left").withColumn("root", F.coalesce("root", "tag")).withColumn("links", F.coalesce("links", F.lit(0)))
    group = Window.partitionBy("key")
    wide = placed.select("*", F.min("root").over(group).alias("least"), F.max("root").over(group).alias("most"), F.max(F.struct("links", "tag", "root")).over(group).alias("centre"))
    return wide.where("least < most").drop("least", "most")


def _near(pairs: DataFrame, shapes: DataFrame, *far) -> DataFrame:
    """The distinct pairs (a, b) that sizes and sketches allow."""
    x, y = (shapes.select(F.col("tag").alias(c), F.col("shape").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    return pairs.distinct().join(common.shuffled(x), "a").join(common.shuffled(y), "b").where(~_far("x", "y", *far)).select("a", "b")


def _stars(apart: DataFrame) -> DataFrame:
    """(a, b): each member of a group and its centre, where they aren't connected yet."""
    return apart.where("root <> centre.root").select(F.greatest("tag", "centre.tag").alias("a"), F.least("tag", "centre.tag").alias("b"))


def _across(groups: DataFrame, roots: DataFrame, shapes: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """(x, y, differ): members of a group that aren't connected and that may be similar, each two once, without those of
    ``tested`` (x, ys); ``shape`` has ``own``, the number of the text's shingles that no other text has.

    ``groups``: (group, tag), a group being named by a member of it.  Groups whose names are connected are taken as one,
    so that a pair that meets in many groups is one row.  In it what isn't connected to the name meets what is, and each
    other.  A group of more than MET members is dealt into parts, each of which meets all that is apart.
    """
    p, q = SIMILARITY
    whole = roots.select(F.col("tag").alias("group"), F.col("root").alias("whole"))
    named = groups.join(common.shuffled(whole), "group", "left").select(F.coalesce("whole", "group").alias("group"), "tag").distinct()
    members = common.cut_lineage(named.join(common.shuffled(roots), "tag", "left").select("group", "tag", F.coalesce("root", "tag").alias("root")))
    parts = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("parts"), F.max(F.col("root") != F.col("group")).alias("apart")).where("apart")
    dealt = members.join(common.shuffled(parts), "group").join(common.shuffled(shapes), "tag")
    x = dealt.where("root <> group").select("group", F.col("tag").alias("x"), F.col("root").alias("rx"), F.col("shape").alias("sx"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    y = dealt.select("group", F.col("tag").alias("y"), F.col("root").alias("ry"), F.col("shape").alias("sy"), F.pmod(F.xxhash64("tag"), "parts").cast("int").alias("part"))
    if tested is not None:
        x = x.join(common.shuffled(tested), "x", "left")
    shared = F.least(F.col("sx.size") - F.col("sx.own"), F.col("sy.size") - F.col("sy.own"))  # at most
    able = (p + q) * shared >= p * (F.col("sx.size") + F.col("sy.size"))
    once = (F.col("ry") == F.col("group")) | (F.col("x") > F.col("y"))
    new = F.lit(True) if tested is None else F.col("ys").isNull() | ~F.array_contains("ys", F.col("y"))
    pairs = x.join(common.shuffled(y), ["group", "part"]).where((F.col("rx") != F.col("ry")) & once & able & new & ~_far("sx", "sy"))
    return pairs.select("x", "y", _differ("sx", "sy").alias("differ"))


def _pair(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _connected(found: DataFrame, groups: DataFrame, shapes: DataFrame, held: DataFrame) -> DataFrame:
    """``found`` with what else connects members of ``groups``: the nearest first, then all that are still apart."""
    roots = common.cut_lineage(_roots(found))
    # one for each part of the others, so few rows leave a task, and no text's pairs are gathered
    nearest = _across(groups, roots, shapes).groupBy("x", F.pmod(F.xxhash64("y", F.lit(1)), F.lit(NEAREST)).alias("nth")).agg(F.min(F.struct("differ", "y")).alias("y"))
    tried = common.cut_lineage(nearest.select("x", F.col("y.y").alias("y")))
    if tried.isEmpty():
        return found
    new = common.cut_lineage(_verified(_pair(tried), held))
    stars = roots.select(F.col("tag").alias("a"), F.col("root").alias("b")).unionByName(new)
    roots = common.cut_lineage(_roots(stars))
    tested = tried.groupBy("x").agg(F.collect_list("y").alias("ys"))  # NEAREST of them, or fewer
    return stars.unionByName(_verified(_pair(_across(groups, roots, shapes, tested)), held))


def _own_shingles(held: DataFrame) -> DataFrame:
    """(tag, size, own) of the texts that may have a link; the others have too many shingles that only they have.

    Without them more shingles are single, so this is repeated as long as it takes away a hundredth of the texts; the
    bounds hold wherever it stops.
    """
    p, q = SIMILARITY
    left, before = held.select("tag"), None
    while True:
        each = held.join(common.shuffled(left), "tag").select("tag", F.size("hashes").cast("long").alias("size"), "hashes")
        single = each.select("tag", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("n")).where("n = 1")
        counted = each.drop("hashes").join(common.shuffled(single.groupBy("tag").agg(F.count(F.lit(1)).alias("own"))), "tag", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
        out = common.cut_lineage(counted.where(q * F.col("own") <= (q - p) * F.col("size")))
        n = out.count()
        if before is not None and 100 * (before - n) <= before or not n:
            return out
        left, before = out.select("tag"), n


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) between tags of similar texts, enough to connect all colliding ones that are similar.

    ``classes``: tag, node, least_id, size, prints, unsure, prefix of each different text.
    """
    met = common.cut_lineage(collisions(classes))
    shapes = classes.select("tag", F.struct("size", "prints").alias("shape"))
    # texts are read again only where a candidate is near by its sketch, or more than two texts meet
    group = Window.partitionBy("key")
    pool = met.select("tag", F.min("tag").over(group).alias("low"), F.max("tag").over(group).alias("high"), F.count(F.lit(1)).over(group).alias("n"))
    near = _near(pool.where("n = 2 AND tag = low").select(F.col("high").alias("a"), F.col("low").alias("b")), shapes, "prints", _WORDS64, FAR)
    wanted = near.select(F.explode(F.array("a", "b")).alias("tag")).unionByName(pool.where("n > 2").select("tag")).distinct()
    ids = classes.join(common.shuffled(wanted), "tag", "left_semi").select("tag", "node", "least_id")
    texts = docs.join(common.shuffled(ids.select(F.col("least_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    held = common.cut_lineage(ids.join(common.shuffled(sets(texts).dropDuplicates(["node"])), "node").select("tag", "hashes", "sketch"))
    may = common.cut_lineage(_own_shingles(held))
    met = common.cut_lineage(met.join(common.shuffled(may.select("tag")), "tag", "left_semi"))
    held = held.join(common.shuffled(may), "tag")
    shapes = common.cut_lineage(held.select("tag", F.struct("size", "sketch", "own").alias("shape")))

    found = known = None
    for block in range(2):
        own = met.where(F.col("key").between(block << BLOCK_BITS, ((block + 1) << BLOCK_BITS) - 1))
        new = _verified(_near(_stars(_apart(own, known)), shapes), held)
        found = common.cut_lineage(new if found is None else found.unionByName(new))
        known = _known(found)
    groups = common.cut_lineage(_apart(met, known).select(F.col("centre.root").alias("group"), "tag").distinct())
    return _connected(found, groups, shapes, held)


def _roots(found: DataFrame) -> DataFrame:
    return components(found).select(F.col("node").alias("tag"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, version, component_id, kept), a row for each row of ``docs``; a component's id is its smallest doc_id.

    Texts of the same words are one class, among them those without any.  ``version`` is a hash of the text as it is;
    ``kept`` marks the rows of the component's least (doc_id, version).  Rows without an id are linked to nothing and
    have the component of the rows with their words, or none.
    """
    signed = common.cut_lineage(signatures(docs))
    own = ["node", "size", "prints", "unsure", "prefix"]
    first = F.min(F.struct("doc_id", "version")).alias("first")
    classes = common.cut_lineage(signed.where("doc_id IS NOT NULL").groupBy("node").agg(first, *[F.any_value(c).alias(c) for c in own[1:]]).select(F.xxhash64("node").alias("tag"), "first", F.col("first.doc_id").alias("least_id"), *own))
    roots = _roots(links(docs, classes))
    linked = common.cut_lineage(classes.join(common.shuffled(roots), "tag").select("node", "root", "first"))
    least = linked.groupBy("root").agg(F.min("first").alias("of_all"))
    owned = linked.join(common.shuffled(least), "root").select("node", "of_all")
    owners = classes.select("node", "first").join(common.shuffled(owned), "node", "left").select("node", F.coalesce("of_all", "first").alias("first"))
    out = common.join_owners(signed.select("doc_id", "version", "node"), owners, "node")
    return out.select("doc_id", "version", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "version") == F.col("first")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of its smallest id (and least text) stays.

    Of rows of the same id and text one stays; rows without an id are no group's member and stay.
    """
    found = near_duplicates(docs.where("doc_id IS NOT NULL"))
    return common.keep_rows(docs, found.where("kept").select("doc_id", "version").distinct())
