"""Near-duplicates by a chosen-path set similarity join.

Every text becomes its set of word shingles; equal sets form a class, and the
classes are joined. ``COORDINATES`` minhash values stand for a set. Each of
``TREES`` independent trees sends a set from its root down: a node picks some of
the coordinates at random (``1 / threshold`` of them on average) and the sets go
on to the child that shares the value there. Sets as similar as the threshold
stay together in a critical branching process, others part quickly. A node of
at most ``LEAF`` sets is compared exhaustively, larger nodes branch again, and
what is left after ``LEVELS`` is compared exhaustively as well, or earlier, once
the nodes left are not too large and hold no more pairs than ``LEAF`` a set. A bit sketch and
the set sizes discard pairs that are far from the threshold; the others are
confirmed on the full shingle sets.

Only components are asked for, so pairs that are connected already need no look.
At level ``STARS`` the sets of every node are compared with one of them, which
connects groups of copies by a star each; the exhaustive comparison then takes
the pairs between components. A large node within one component is done. One that a
component fills but for at most ``LEAF`` sets, or to a share of ``1 / DENSE``, does not
branch on: the sets outside are compared with the component, once for all nodes, in
blocks of ``BLOCK`` sets that a task holds at once and of which only links come out. So
a group of thousands of copies makes neither rows for all its pairs nor ever more nodes.

With ``t`` trees a pair just at the threshold is missed with probability
``(1 - s) ** t``, ``s`` being 0.47 for nodes that end on level 2 and 0.37 on
level 3: about 3e-5 and 6e-4 for 16 trees; more similar pairs are missed far less.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.words import grams, hash_words, mix, seeded, signed
from quarry.sources.files import materialize

COORDINATES, TREES, LEAF, STARS, LEVELS = 128, 16, 128, 3, 10
#: A node that one component fills to this part at least ends; sets of a block.
DENSE, BLOCK = 4, 128
#: Shingles whose minhashes are computed at once.
PIECE = 1 << 15
#: Bits of the mask that keeps texts without a candidate from being shingled anew.
MASK = 1 << 25
ROW = ["bucket", "node", "n", "b1", "b2"]
_FLIP = seeded(21, COORDINATES).astype(np.uint32)[:, None]
_FACTOR = (seeded(22, COORDINATES).astype(np.uint32) | np.uint32(1))[:, None]
_PICK = seeded(23, COORDINATES)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a text with fewer words than ``size`` is one shingle."""
    words, rows = hash_words(column)
    n = len(column)
    first = np.searchsorted(rows, np.arange(n + 1))
    g, start = grams(words, rows, size)
    lo = np.searchsorted(start, first)
    out = []
    for i in range(n):
        count = first[i + 1] - first[i]
        if count >= size:
            out.append(np.unique(g[lo[i]:lo[i + 1]]))
        elif count:
            w = words[first[i]:first[i + 1]]
            out.append(grams(w, np.zeros(count, np.int64), int(count))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return (int(np.add.reduce(mix(s)).view(np.int64)), int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A))).view(np.int64)))


def minhashes(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    short = (s >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(short), PIECE):
            out = np.minimum(out, ((short[i:i + PIECE] ^ _FLIP) * _FACTOR).min(axis=1))
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    """One bit of each minhash, as two longs."""
    x = mix(h.astype(np.uint64) + np.uint64(1))
    return np.packbits((x & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.int64)


def _short(h: np.ndarray) -> bytes:
    """Each minhash as 16 bits: equal ones stay equal; another set shares a value by chance once in 65536, which comparing sorts out."""
    return (mix(h.astype(np.uint64) + np.uint64(2)) >> np.uint64(48)).astype(np.uint16).tobytes()


def signatures(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """``row``, ``id`` and the set's n, digest (d1, d2), sketch (b1, b2) and shortened minhashes of each row of ``docs``."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(text_col), size)
            d = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            h = [minhashes(s) for s in sets]
            b = np.array([_bits(x) for x in h], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(b[:, 0]), pa.array(b[:, 1]),
                 pa.array([_short(x) for x in h], pa.binary())], names=["row", "id", "n", "d1", "d2", "b1", "b2", "sig"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, id {kind}, n long, d1 long, d2 long, b1 long, b2 long, sig binary")


def _children(sig: np.ndarray, owner: np.ndarray, path: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, child) of the coordinates that the nodes ``path`` pick; a node that would pick none takes one."""
    limit = np.uint64(min(1.0, 1 / threshold / COORDINATES) * float(1 << 63) * 2 * 0.999999)
    owners, children = [], []
    for i in range(0, len(path), 1 << 12):
        p, o = path[i:i + (1 << 12)], owner[i:i + (1 << 12)]
        draw = mix(p[:, None] ^ _PICK)
        chosen = draw < limit
        none = ~chosen.any(1)
        chosen[none, draw[none].argmin(1)] = True
        at, c = np.nonzero(chosen)
        owners.append(o[at])
        with np.errstate(over="ignore"):
            children.append(mix(mix(p[at] + np.uint64(c.astype(np.uint64) + np.uint64(1))) ^ sig[o[at], c].astype(np.uint64)))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(children)


def branch(sets: DataFrame, threshold: float, trees: int) -> DataFrame:
    """(bucket, node, n, b1, b2): the children of each set's nodes; ``sets`` has node, n, b1, b2, sig and, but for the roots, buckets."""
    roots = seeded(31, trees)
    at_root = "buckets" not in sets.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column("sig")])
            node = batch.column("node").to_numpy(zero_copy_only=False)
            facts = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "b1", "b2")]
            if at_root:
                owner, path = np.repeat(np.arange(len(node)), trees), np.tile(roots, len(node))
            else:
                lists = batch.column("buckets")
                owner = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
                path = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner, child = _children(sig, owner, path, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(signed(child)), pa.array(node[owner]), *[pa.array(x[owner]) for x in facts]],
                                             names=ROW)

    return sets.mapInArrow(run, ", ".join(f"{c} long" for c in ROW))


def _agree(bits: int, threshold: float) -> int:
    """The fewest equal bits that count as near the threshold: four standard deviations below the mean."""
    p = (1 + threshold) / 2
    return int(bits * p - 4 * (bits * p * (1 - p)) ** 0.5)


def pairs_of(left: DataFrame, right: DataFrame, threshold: float, which=None) -> DataFrame:
    """(a, b, agree), a < b, of the pairs within a bucket that sizes and sketches leave; ``which``: a further condition."""
    side = lambda df, k: df.select("bucket", *[F.col(c).alias(k + c) for c in df.columns if c != "bucket"])
    x, y = side(left, "x"), side(right, "y")
    agree = F.lit(COORDINATES) - F.bit_count(F.col("xb1").bitwiseXOR(F.col("yb1"))) - F.bit_count(F.col("xb2").bitwiseXOR(F.col("yb2")))
    fits = F.least("xn", "yn") >= F.greatest("xn", "yn") * threshold
    near = (agree >= _agree(COORDINATES, threshold)) & fits & (F.col("xnode") != F.col("ynode"))
    return x.join(y, (x["bucket"] == y["bucket"]) & (near if which is None else near & which)) \
        .select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b"), agree.alias("agree"))


def confirm(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets have ``q * intersection >= p * union``."""
    p, q = threshold
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            a, b, xs, ys = (batch.column(c) for c in ("a", "b", "x", "y"))
            ok = []
            for u, v in zip(xs, ys, strict=True):
                u, v = np.frombuffer(u.as_py(), np.uint64), np.frombuffer(v.as_py(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(q * both >= p * (len(u) + len(v) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the classes in ``needed`` (node, low, n, d1, d2), made again from the texts that stand for them.

    A bit mask of fixed size tells most texts that nobody needs; the join on
    the digests decides.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MASK))
    words = needed.select(spot("low").alias("h")) \
        .groupBy(F.expr("shiftright(h, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(h & 63 AS INT)))").alias("bits")).toArrow()
    mask = np.zeros(MASK // 64, np.uint64)
    mask[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches):
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            hit = (shared.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1)
            sets = shingle_sets(batch.column("text").filter(pa.array(hit.astype(bool))), size)
            d = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["n", "d1", "d2", "shingles"])

    return docs.select(spot("id").alias("h"), "text").mapInArrow(run, "n long, d1 long, d2 long, shingles binary") \
        .join(needed, ["n", "d1", "d2"]) \
        .groupBy("n", "d1", "d2").agg(F.first("node").alias("node"), F.first("shingles").alias("shingles")).select("node", "shingles")


class _Links:
    """The confirmed links so far, their components, and the pairs that were looked at."""

    def __init__(self, docs: DataFrame, facts: DataFrame, shingle: int, threshold: tuple[int, int]):
        self.docs, self.facts, self.shingle, self.threshold = docs, facts, shingle, threshold
        self.links = self.seen = None
        self.comp = facts.select("node", F.col("node").alias("comp")).limit(0)

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component ``comp`` of their ``node``."""
        return rows.join(self.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are not connected yet."""
        x = self.comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        y = self.comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        return pairs.join(x, "a", "left").join(y, "b", "left") \
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)

    def link(self, new: DataFrame) -> None:
        """Take confirmed pairs (a, b), a written table, into the components."""
        if not new.isEmpty():
            self.links = new if self.links is None else self.links.unionByName(new)
            self.comp = components(self.links)

    def add(self, pairs: DataFrame, met: DataFrame | None = None) -> None:
        """Confirm candidate pairs (a, b, agree): first the best one of each set, then all that these have not connected.

        Before them come the sets that ``met`` (node, met, wide) a component, by blocks.
        """
        found = self.apart(pairs.distinct())
        if self.seen is not None:
            found = found.join(self.seen, ["a", "b"], "left_anti")
        found = materialize(found)
        sides = None if met is None or met.isEmpty() else materialize(_sides(met, self))
        if found.isEmpty() and sides is None:
            return
        ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node")))
        ends = (ends if sides is None else ends.unionByName(sides.select("node"))).distinct()
        needed = materialize(self.facts.join(ends, "node").select("node", "low", "n", "d1", "d2"))
        sets = materialize(full_sets(self.docs, needed, self.shingle))
        if sides is not None:
            self.link(materialize(_block_links(sides, sets, self.threshold)))
        best = found.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
        for some in (best, found.select("a", "b").join(best, ["a", "b"], "left_anti")):
            some = materialize(self.apart(some))
            if some.isEmpty():
                continue
            new = materialize(confirm(some, sets, self.threshold))
            self.seen = some if self.seen is None else self.seen.unionByName(some)
            self.link(new)


def _sides(met: DataFrame, links: _Links) -> DataFrame:
    """(met, node, left, of, others): per component, the sets outside (left) and what they are compared with, dealt into blocks.

    ``of`` is the block of the row on its side, ``others`` the number of blocks on the other one. Sets outside
    that came from nodes with many such sets (``wide``) are compared with each other as well.
    """
    left = met.select("met", "node", F.lit(True).alias("left"))
    members = links.labelled(links.facts.select("node")).join(met.select(F.col("met").alias("comp")).distinct(), "comp")
    right = members.select(F.col("comp").alias("met"), "node").unionByName(met.where("wide").select("met", "node")) \
        .select("met", "node", F.lit(False).alias("left"))
    rows = left.unionByName(right)
    blocks = lambda side: F.ceil(F.sum(F.when(F.col("left") == F.lit(side), 1).otherwise(0)) / BLOCK)
    counts = rows.groupBy("met").agg(blocks(True).alias("lefts"), blocks(False).alias("rights"))
    own, other = (F.when(F.col("left"), F.col(x)).otherwise(F.col(y)) for x, y in (("lefts", "rights"), ("rights", "lefts")))
    return rows.join(counts, "met").select("met", "node", "left", F.pmod(F.xxhash64("node"), own).alias("of"), other.alias("others"))


def _block_links(sides: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b) between the two sides of every pair of blocks: enough to connect what they connect."""
    p, q = threshold

    def compare(block: pa.Table) -> pa.Table:
        left = block.column("left").to_numpy().astype(bool)
        node = block.column("node").to_numpy()
        held = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("shingles")]
        size = np.array([len(x) for x in held])
        right = np.flatnonzero(~left)
        up = np.arange(len(node))  # a forest over the rows

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        a, b = [], []
        if len(right):
            values = np.concatenate([held[i] for i in right])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(np.arange(len(right)), size[right])[order]
            for i in np.flatnonzero(left):
                lo, hi = np.searchsorted(values, held[i]), np.searchsorted(values, held[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(right))
                near = q * both >= p * (size[i] + size[right] - both)
                for j in right[near & (node[right] != node[i])]:
                    if (x := top(i)) != (y := top(j)):
                        up[x] = y
                        a.append(min(node[i], node[j]))
                        b.append(max(node[i], node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = sides.join(sets, "node").withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    i, j = (F.when(F.col("left"), F.col(x)).otherwise(F.col(y)) for x, y in (("of", "meets"), ("meets", "of")))
    return dealt.select("met", i.alias("i"), j.alias("j"), "left", "node", "shingles") \
        .groupBy("met", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _open(large: DataFrame, links: _Links, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the large nodes: the rows of those to branch; pairs of sets outside the component that all but fills a node; who met which component.

    A node within one component is done. One with at most ``LEAF`` sets outside the
    largest component, or where this fills a good part, ends: the sets outside have met
    the component, with which they are compared once however many nodes they share with
    it. They are compared with each other too, in pairs or, when many (``wide``), in blocks.
    """
    rows = links.labelled(large.select(ROW))
    parts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n_part"))
    nodes = parts.groupBy("bucket").agg(F.sum("n_part").alias("total"), F.max("n_part").alias("most"),
                                        F.max_by("comp", "n_part").alias("main")).where("total > most")
    rows = materialize(rows.join(nodes, "bucket"))
    few = F.col("total") - F.col("most") <= LEAF
    ends = few | (F.col("most") * DENSE >= F.col("total"))
    outside = rows.where(ends & (F.col("comp") != F.col("main")))
    met = materialize(outside.groupBy("node", F.col("main").alias("met")).agg(F.max(~few).alias("wide")))
    others = outside.where(few).select(*ROW, "comp")
    pairs = pairs_of(others, others, threshold, (F.col("xcomp") != F.col("ycomp")) & (F.col("xnode") < F.col("ynode")))
    return rows.where(~ends).select(ROW), pairs, met


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    threshold: tuple[int, int] = (4, 5), trees: int = TREES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Texts whose sets of word shingles have a Jaccard similarity of at least
    ``threshold`` (numerator, denominator) are linked; ``component_id`` is the
    smallest id that a row reaches over links, itself included, and a row is
    kept if it is its own. Equal sets (by size and 128-bit digest) are linked
    without a comparison; every other link is confirmed on the full sets.

    Null and empty texts have no shingles and are linked with nothing. Repeated
    rows share their class; ids that are null never become a component id unless
    a component has no other, and its rows are all kept then. Other columns play
    no part; an empty table gives an empty result.
    """
    ratio = threshold[0] / threshold[1]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sigs = materialize(signatures(own.withColumn("row", F.monotonically_increasing_id()), "text", shingle))
    full = sigs.where("n > 0")
    classes = full.groupBy("n", "d1", "d2").agg(F.min("row").alias("node"), F.min("id").alias("low"))
    facts = materialize(classes)
    single = materialize(full.select(F.col("row").alias("node"), "b1", "b2", "sig").join(facts.select("node", "n"), "node"))

    links, sets = _Links(own, facts, shingle, threshold), facts.count()
    rows, levels, ends, crossing, met = branch(single, ratio, trees), [], [], [], None
    for level in range(1, LEVELS + 1):
        rows = materialize(rows)
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).where("size > 1")
        levels.append(materialize(rows.join(sizes, "bucket")))
        if level == STARS:
            stars = reduce(DataFrame.unionByName, [*[y.where(F.col("size") <= LEAF) for y in levels[:-1]], levels[-1]])
            links.add(pairs_of(stars.where("node = pivot").select(ROW), stars.where("node != pivot").select(ROW), ratio))
        large = levels[-1].where(F.col("size") > LEAF).select(ROW)
        if level >= STARS:
            large, pairs, more = _open(large, links, ratio)
            crossing.append(pairs)
            met = more if met is None else met.unionByName(more)
            held = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.sum(F.col("c") * F.col("c"))).first()
            if held[0] is None:
                break
            if level == LEVELS or held[0] <= LEAF * LEAF // 8 and held[1] <= LEAF * sets:
                ends.append(large)
                break
        paths = large.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
        rows = branch(single.join(paths, "node"), ratio, trees)
    ends += [x.where(F.col("size") <= LEAF).select(ROW) for x in levels]
    met = materialize(met.groupBy("node", "met").agg(F.max("wide").alias("wide")))
    crossing.append(_crossing(reduce(DataFrame.unionByName, ends), links, met, ratio))  # no bucket is on two levels
    links.add(reduce(DataFrame.unionByName, crossing), met)

    tree = links.labelled(facts.select("n", "d1", "d2", "node", "low"))
    lows = tree.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = tree.join(lows, "comp").select("n", "d1", "d2", "component_id")
    out = sigs.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    member = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), member.alias("component_id"),
                      F.col("id").eqNullSafe(member).alias("kept"))


def _crossing(rows: DataFrame, links: _Links, met: DataFrame, ratio: float) -> DataFrame:
    """All pairs within a node that no component holds together yet and whose set and component have not met.

    Copies share nodes of many trees and levels; a pair comes out of the first node that it shares only.
    """
    known = met.groupBy("node").agg(F.collect_set("met").alias("met"))
    sets = rows.groupBy("node", "n", "b1", "b2").agg(F.collect_set("bucket").alias("buckets"))
    sets = links.labelled(sets).join(known, "node", "left").withColumn("met", F.coalesce("met", F.array().cast("array<bigint>")))
    rows = sets.withColumn("bucket", F.explode("buckets")).withColumn("here", F.col("bucket"))
    new = ~F.expr("array_contains(xmet, ycomp)") & ~F.expr("array_contains(ymet, xcomp)")
    first = F.col("xhere") == F.array_min(F.array_intersect("xbuckets", "ybuckets"))
    return pairs_of(rows, rows, ratio, (F.col("xcomp") != F.col("ycomp")) & (F.col("xnode") < F.col("ynode")) & new & first)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                         threshold: tuple[int, int] = (4, 5), trees: int = TREES) -> DataFrame:
    """The rows of ``docs`` that stay (one id of each component), with all their columns."""
    keep = near_duplicates(docs, id_col, text_col, shingle, threshold, trees).where("kept") \
        .select(F.col(id_col).alias("__keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi")
