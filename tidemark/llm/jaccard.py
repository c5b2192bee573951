"""Operator 10: exact Jaccard join of 5-word shingle sets by pivots and metric windows.

Jaccard distance is a metric, and sets link that lie within r = 1 - 0.8. Pivots are points of that space, in levels:

1. Single shingles. A set x lies at distance 1 - 1/|x| from each shingle it holds and at 1 from others, so its
   Voronoi region is the first shingle it holds in a global order. Sets within r of x share at least 0.8|x| members
   with it, so x is replicated to the first |x| - ceil(0.8|x|) + 1 of its shingles, the window within which a
   partner's region must lie. Regions of the same members are joined once.
2. Documents. The least member of each region is its pivot; regions of one pivot are one. Members within r of the
   pivot form one component, and need no comparison with each other. Regions whose members lie in several components
   go on: up to SMALL members they are compared pair by pair, larger ones are split into the Voronoi cells of PIVOTS
   of their documents, boundary documents being replicated by the triangle inequality (to every pivot at most 2r
   further than the nearest), and cells are treated as regions again, for as long as that shrinks them.
3. A region that does not shrink (documents that are all somewhat alike, which no pivot tells apart) is cut into
   bounded blocks by distance to its pivot; blocks whose distances differ by more than r do not meet.

Only links between components are sought, and each task gives a forest of its links, so rows stay linear in a
region's members; whole documents alone would be no use as first pivots, since nearly all lie at distance 1 from them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

from .common import components, cut, grams, hashed_words, lists, read, scratch

#: A shingle that lies in this many windows comes last in the global order.
COMMON = 30

#: Up to so many common shingles (8 bytes each) are sent to every executor; beyond that they are joined.
FEW_PIVOTS = 500_000

#: Up to so many ids (8 bytes each) of documents whose whole sets are asked for are broadcast; beyond that they are joined.
FEW_IDS = 1_000_000

#: Regions of up to so many members are compared pair by pair; larger ones are split by so many document pivots at a time.
SMALL = 50
PIVOTS = 4

#: About so many documents, and so many shingles, lie in a block of a region that pivots do not split.
BLOCK = 400
BLOCK_SHINGLES = 500_000


def window_size(n, percent: int):
    """The first n - ceil(percent * n / 100) + 1 = floor((100 - percent) * n / 100) + 1 pivots."""
    return F.floor(n * (100 - percent) / 100).cast("int") + 1


def as_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def table_of(rows: list[tuple], names: tuple[str, ...], narrow: str = "") -> pa.Table:
    """A table of integers; the column narrow has 32 bits. Groups are Arrow tables, so that no worker loads pandas."""
    values = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.table([pa.array(values[:, k], pa.int64()).cast(pa.int32() if c == narrow else pa.int64()) for k, c in enumerate(names)], names=list(names))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(grams(words, width))


def once(udf):
    """The function, called once a row and where it stands: a filter on its result, stated or inferred (not null), would
    otherwise be pushed below a join with the texts that are asked for and call it there for every text, and again above."""
    return udf.asNondeterministic()


def windows_of(width: int, percent: int, late: np.ndarray | None = None):
    """Of each text the hash and size of its set, and its window: pivots by hash, those of the sorted array late last."""
    late = np.zeros(0, np.int64) if late is None else late

    @arrow_udf("struct<cls:binary,n:int,win:array<bigint>>")
    def make(column: pa.Array) -> pa.Array:
        cls, sizes, wins = [], [], []
        for words in hashed_words(column):
            x = shingle_set(words, width)
            k = (100 - percent) * len(x) // 100 + 1
            # late may be far longer than a set, and is sorted
            mask = late[np.minimum(np.searchsorted(late, x), len(late) - 1)] == x if len(late) else None
            cls.append(hashlib.md5(x.tobytes()).digest())
            sizes.append(len(x))
            wins.append(np.concatenate([x[~mask], x[mask]])[:k] if mask is not None and mask.any() else x[:k].copy())
        return pa.StructArray.from_arrays([pa.array(cls, pa.binary()), pa.array(sizes, pa.int32()), as_lists(wins)], names=["cls", "n", "win"])

    return once(make)


def class_of(width: int):
    @arrow_udf("binary")
    def make(column: pa.Array) -> pa.Array:
        return pa.array([hashlib.md5(shingle_set(x, width).tobytes()).digest() for x in hashed_words(column)], pa.binary())

    return make


def classed_sets(width: int):
    """Of each text the hash of its set, and the set."""

    @arrow_udf("struct<cls:binary,sh:array<bigint>>")
    def make(column: pa.Array) -> pa.Array:
        rows = [shingle_set(x, width) for x in hashed_words(column)]
        return pa.StructArray.from_arrays([pa.array([hashlib.md5(x.tobytes()).digest() for x in rows], pa.binary()), as_lists(rows)], names=["cls", "sh"])

    return once(make)


@arrow_udf(IntegerType())
def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(lists(a), lists(b))], pa.int32())


@arrow_udf(IntegerType())
def most_overlap(a: pa.Array, na: pa.Array, b: pa.Array, nb: pa.Array) -> pa.Array:
    """An upper bound of the intersection from two windows of one order: members shared by the windows, and all behind one."""
    out = [
        len(np.intersect1d(x, y)) + max(m - len(x), n - len(y))
        for x, m, y, n in zip(lists(a), na.to_pylist(), lists(b), nb.to_pylist())
    ]
    return pa.array(out, pa.int32())


def asked(ids: DataFrame) -> DataFrame:
    """Distinct ids to join with: up to FEW_IDS of them are broadcast, so that the other side is not shuffled."""
    ids = ids.distinct()
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def paired(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs with n and the given array of both sides."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col(column).alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def verified(pairs: DataFrame, wins: DataFrame, bodies: "Bodies", percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union; windows first, then whole sets of what is left."""
    enough = lambda c: c * 100 >= percent * (F.col("na") + F.col("nb") - c)
    pairs = cut(pairs)
    wins = wins.join(asked(nodes_of(pairs)), "node", "left_semi")
    left = cut(paired(pairs, wins, "win").where(enough(most_overlap("sa", "na", "sb", "nb"))).select("a", "b"))
    return paired(left, bodies.of(nodes_of(left)), "sh").where(enough(overlap("sa", "sb"))).select("a", "b")


def near(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id.

    Null and blank texts have an empty set and link with nothing; documents of equal sets form one class, compared
    once. Repeated rows come back as often as they came; different texts of one id are classes of their own, each
    with its component. A null id gets a null component.
    """
    with scratch(docs.sparkSession):
        classes, named = classified(docs, width, percent, key, text)
        return cut(components_of(classes, named, key), outer=True)


def components_of(classes: DataFrame, named: DataFrame, key: str) -> DataFrame:
    full = classes.where("n > 0").join(named, "cls", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    empty = classes.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")


def classified(docs: DataFrame, width: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, cls, n) of each row, and (cls, rep, part, component_id) of each class of a set that is not empty."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    made = lambda late=None: rows.select("id", windows_of(width, percent, late)("t").alias("s")).select("id", "s.*")
    # copies of a text are put together before the shuffle, so that each class's window moves once
    least = lambda df: df.where("n > 0 and id is not null").groupBy("cls").agg(F.min(F.struct("id", "n", "win")).alias("m")).select("cls", "m.*")
    with scratch(docs.sparkSession):
        every = cut(made())
        classes = cut(every.select("id", "cls", "n"), outer=True)
        # node: a number of the class's own, fixed by the checkpoint
        first = cut(least(every).withColumn("node", F.monotonically_increasing_id()))
        reps = cut(first.select(F.col("id").alias("rep"), "cls", "n", "node"), outer=True)
        bodies = Bodies(rows, reps, width)
        counts = first.select(F.explode("win").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("c"))
        common = cut(counts.where(F.col("c") > COMMON).select("pivot"))
        few = common.limit(FEW_PIVOTS + 1).toArrow().column("pivot").to_numpy()
        if len(few) <= FEW_PIVOTS:
            sets = least(made(np.sort(few))).join(reps.select("cls", "node"), "cls").select("node", "n", "win")
        else:
            sets = reordered(first.select("node", "n", "win"), bodies, common, percent)
        sets = cut(sets, outer=True)
    named = cut(reps.join(joined(sets, bodies, percent), "node", "left").select("cls", "rep", F.coalesce("part", "node").alias("part")))
    return classes, named.join(named.groupBy("part").agg(F.min("rep").alias("component_id")), "part")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, of the least doc_id (of its texts the one of the least hash); rows without an id stay.

    Documents of an empty set are components of their own; of rows that repeat id and set one stays.
    """
    with scratch(docs.sparkSession):
        classes, named = classified(docs.select("doc_id", "text"), width, percent, "doc_id", "text")
        best = cut(chosen_rows(classes, named), outer=True)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(best, "id")
    # only an id of several texts needs to know which of them a row holds
    rows = rows.withColumn("own", F.when(F.col("several"), class_of(width)(F.when(F.col("several"), F.col("row.text")))))
    kept = rows.where(~F.col("several") | F.array_contains("stay", F.col("own"))).dropDuplicates(["id", "own"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def chosen_rows(classes: DataFrame, named: DataFrame) -> DataFrame:
    """(id, stay, several): the ids that stay, with the classes of those of their texts that do, and whether an id has several."""
    best = named.groupBy("part").agg(F.min(F.struct("rep", "cls")).alias("m")).select(F.col("m.rep").alias("id"), F.col("m.cls").alias("cls"))
    best = best.union(classes.where("n = 0 and id is not null").select("id", "cls"))
    several = classes.groupBy("id").agg((F.min("cls") != F.max("cls")).alias("several"))
    return best.groupBy("id").agg(F.collect_set("cls").alias("stay")).join(several, "id")


class Bodies:
    """Whole sets of chosen classes, made again from the texts that stand for them."""

    def __init__(self, rows: DataFrame, reps: DataFrame, width: int):
        self.rows, self.reps, self.width = rows, reps, width

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, n, sh) of the nodes; texts of up to FEW_IDS ids are found without a shuffle."""
        named = cut(self.reps.join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("id"), F.col("cls").alias("own"), "node"))
        made = self.rows.join(asked(named.select("id")), "id", "left_semi").select("id", classed_sets(self.width)("t").alias("s")).select("id", "s.*")
        one = made.join(named, "id").where("cls = own").dropDuplicates(["id", "node"])
        return cut(one.select("node", F.size("sh").alias("n"), "sh"))


def joined(sets: DataFrame, bodies: Bodies, percent: int) -> DataFrame:
    """(node, part) of the nodes that link with another: the least node reachable. sets: node, n, win."""
    windows = sets.select("node", "n", F.posexplode("win").alias("pos", "pivot"))
    held = windows.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # pivots of one set only, by far the most, are gone before windows are written
    windows = cut(windows.join(held.select("pivot"), "pivot", "left_semi"))
    one = F.struct("node", "n", "pos")
    regions = windows.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min(one).alias("lo"), F.max(one).alias("hi")
    )
    # regions of the same members are joined once, by their first pivot in the global order
    regions = cut(regions.groupBy("c", "x", "y").agg(F.min(F.struct(F.col("lo.pos"), "pivot", "lo", "hi")).alias("r")).select("c", "r.pivot", "r.lo", "r.hi"))
    # at the first pivot that two sets share, only what stands from there on can be in both
    close = lambda a, b: F.least(a["n"] - a["pos"], b["n"] - b["pos"]) * (100 + percent) >= percent * (a["n"] + b["n"])
    twos = regions.where("c = 2").where(close(F.col("lo"), F.col("hi"))).select(F.col("lo.node").alias("a"), F.col("hi.node").alias("b"))
    # a larger region's document pivot is its least member; the largest, which share most members, are one where they share it
    held = windows.join(regions.where("c > 2").select("pivot", "lo", "c"), "pivot").where(F.col("node") != F.col("lo.node")).withColumn("own", one)
    star = held.where(close(F.col("own"), F.col("lo"))).select(F.col("lo.node").alias("a"), F.col("node").alias("b"))
    few = held.where(F.col("c") <= SMALL).select(F.col("pivot").alias("g"), "node", "n", "pos")
    many = held.where(F.col("c") > SMALL).groupBy(F.col("lo.node").alias("g"), "node").agg(F.first("n").alias("n"), F.lit(0).alias("pos"))
    links = cut(verified(twos.union(star).distinct(), sets, bodies, percent))
    parts = components(links).withColumnsRenamed({"component": "part"})
    found = [pairs_within(mixed(few, parts), percent)]
    whole = rest = None
    large = mixed(many, parts)
    if before := large.count():
        large = cut(merged(large))
        whole = bodies.of(large)
    while before:
        # regions are split for as long as that shrinks what is still open
        cells, spans, links = divided(large, whole, percent)
        parts = cut(further(parts, links))
        cells = mixed(cells, parts)
        if 4 * (after := cells.where(F.col("c") > SMALL).count()) > 3 * before:
            rest = spans
            break
        found.append(pairs_within(cells.where(F.col("c") <= SMALL), percent))
        large, before = cells.where(F.col("c") > SMALL), after
    more = verified(reduce(DataFrame.union, found).distinct(), sets, bodies, percent)
    if rest is not None:
        more = more.union(blocks(mixed(rest, parts).join(rest.select("g", "node", "d"), ["g", "node"]), whole, percent))
    return further(parts, cut(more))


def mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (g, node, n, pos, part, c) of the regions that hold several parts, with the region's size."""
    own = members.join(parts, "node", "left").select("g", "node", "n", "pos", F.coalesce("part", "node").alias("part"))
    open_ = own.groupBy("g").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("g", "c")
    return cut(own.join(open_, "g"))


def pairs_within(small: DataFrame, percent: int) -> DataFrame:
    """Pairs of different parts and near sizes within regions of at most SMALL members; what stands from a region's pivot on can be shared."""
    x, y = (small.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "part")]) for s in "xy")
    fits = (F.col("node_x") < F.col("node_y")) & (F.col("part_x") != F.col("part_y"))
    close = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y"))
    return x.join(y, "g").where(fits & close).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def merged(large: DataFrame) -> DataFrame:
    """Regions that share a member with one of a lesser name take its name: many regions of one family become one or a few."""
    least = large.groupBy("node").agg(F.min("g").alias("m"))
    name = large.join(least, "node").groupBy("g").agg(F.min("m").alias("to"))
    return large.join(name, "g").groupBy(F.col("to").alias("g"), "node").agg(F.first("n").alias("n"), F.lit(0).alias("pos"))


def divided(large: DataFrame, whole: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Voronoi cells (g, node, n) of every region about PIVOTS of its documents, the members with their distance d to
    the first pivot, and the links with pivots.

    A member goes to its nearest pivot and, by the triangle inequality, to each that is at most 2r further: a partner
    within r lies in one of these.
    """
    r = 1 - percent / 100
    pivots = large.groupBy("g", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(PIVOTS)).cast("int").alias("k")).agg(F.min("node").alias("node"))
    # members meet the pivots in bounded groups, to each of which a region's pivots are copied
    sizes = large.groupBy("g").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    own = large.join(sizes, "g").select("g", F.pmod(F.xxhash64("node", F.lit(8)), F.col("nb")).cast("int").alias("s"), "node", F.lit(-1).alias("k"))
    theirs = pivots.join(sizes, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("s"), "node", "k")
    dealt = own.union(theirs).join(whole.select("node", "sh"), "node")

    def measure(group: pa.Table) -> pa.Table:
        g, k, node, rows = group.column("g")[0].as_py(), group.column("k").to_numpy(), group.column("node").to_numpy(), lists(group.column("sh"))
        out = []
        for q in np.flatnonzero(k >= 0):
            for x in np.flatnonzero(k < 0):
                i = len(np.intersect1d(rows[x], rows[q], assume_unique=True))
                out.append((g, node[x], k[q], node[q], i, len(rows[x]) + len(rows[q]) - i))
        return table_of(out, ("g", "node", "k", "q", "i", "u"), narrow="k")

    at = cut(dealt.groupBy("g", "s").applyInArrow(measure, "g long, node long, k int, q long, i long, u long").withColumn("d", 1 - F.col("i") / F.col("u")))
    least = at.groupBy("g", "node").agg(F.min("d").alias("m"), F.min_by("d", "k").alias("d"))
    members = large.select("g", "node", "n", "pos").join(least, ["g", "node"])
    cells = members.drop("d").join(at.select("g", "node", "q", F.col("d").alias("e")), ["g", "node"]).where(F.col("e") <= F.col("m") + 2 * r + 1e-9)
    links = at.where("q <> node").where(F.col("i") * 100 >= percent * F.col("u")).select(F.col("q").alias("a"), F.col("node").alias("b")).distinct()
    return cells.select(F.xxhash64("g", "q").alias("g"), "node", "n", F.lit(0).alias("pos")).distinct(), cut(members.drop("m")), links


def blocks(large: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links within regions that pivots do not split, compared exactly in pairs of bounded blocks: each gives a forest of its links.

    Rings of width r/2 about the first pivot are cut into blocks by hash. Rings further apart than r meet in no pair,
    nor do blocks that hold but one and the same part.
    """
    ring = F.floor(F.col("d") / ((1 - percent / 100) / 2) + 1e-9).cast("int")
    own = large.select("g", "node", "n", "part", "d").withColumn("ring", ring)
    sizes = own.groupBy("g", "ring").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    own = cut(own.join(sizes, ["g", "ring"]).withColumn("s", F.pmod(F.xxhash64("node", F.lit(9)), F.col("nb")).cast("int")).drop("nb", "d"))
    kinds = own.groupBy("g", "ring", "s").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    x, y = (kinds.select("g", *[F.col(c).alias(f"{c}_{z}") for c in ("ring", "s", "lo", "hi")]) for z in "xy")
    order = F.struct("ring_x", "s_x") <= F.struct("ring_y", "s_y")
    one = (F.col("lo_x") == F.col("hi_x")) & (F.col("lo_y") == F.col("hi_y")) & (F.col("lo_x") == F.col("lo_y"))
    meet = cut(x.join(y, "g").where(order & (F.col("ring_y") - F.col("ring_x") <= 2) & ~one).select("g", "ring_x", "s_x", "ring_y", "s_y"))
    task = [F.col(c) for c in ("g", "ring_x", "s_x", "ring_y", "s_y")]
    sides = [meet.select(F.xxhash64(*task).alias("task"), "g", F.col(f"ring_{z}").alias("ring"), F.col(f"s_{z}").alias("s"), F.lit(k).alias("side")) for k, z in enumerate("xy")]
    same = (F.col("ring_x") == F.col("ring_y")) & (F.col("s_x") == F.col("s_y"))
    sides[1] = meet.where(~same).select(F.xxhash64(*task).alias("task"), "g", F.col("ring_y").alias("ring"), F.col("s_y").alias("s"), F.lit(1).alias("side"))
    dealt = own.join(sides[0].union(sides[1]), ["g", "ring", "s"]).select("task", "side", "node", "part").join(whole.select("node", "sh"), "node")

    def compare(group: pa.Table) -> pa.Table:
        side, node, part = (group.column(c).to_numpy() for c in ("side", "node", "part"))
        return table_of(forest(node, part, similar(lists(group.column("sh")), side, percent)), ("a", "b"))

    return dealt.groupBy("task").applyInArrow(compare, "a bigint, b bigint")


def similar(rows: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Places (i, j) of sets that link: of side 0 with side 1, or within side 0 where there is no side 1."""
    sizes = np.array([len(x) for x in rows])
    codes = np.unique(np.concatenate([np.asarray(x, np.int64) for x in rows]), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(rows)), sizes)
    often = np.flatnonzero(np.bincount(codes) > 1)
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    place = np.full(codes.max() + 1, -1)
    place[often] = np.arange(len(often))
    codes, keep = place[codes], place[codes] >= 0
    order = np.argsort(codes[keep], kind="stable")
    codes, owner = codes[keep][order], owner[keep][order]
    total = np.zeros((len(a), len(b)), np.float32)
    # columns in slices, which bounds the dense matrix
    for lo in range(0, len(often), 4096):
        p, q = np.searchsorted(codes, [lo, lo + 4096])
        dense = np.zeros((len(rows), min(4096, len(often) - lo)), np.float32)
        dense[owner[p:q], codes[p:q] - lo] = 1
        total += dense[a] @ dense[b].T
    hit = 100 * total >= percent * (sizes[a][:, None] + sizes[b][None] - total)
    i, j = np.nonzero(hit)
    return np.stack([a[i], b[j]], 1)[a[i] != b[j]]


def forest(node: np.ndarray, part: np.ndarray, hits: np.ndarray) -> list[tuple[int, int]]:
    """The fewest of the links that join what all of them join, given the parts that hold already."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for i, j in hits[part[hits[:, 0]] != part[hits[:, 1]]].tolist():
        x, y = top(int(part[i])), top(int(part[j]))
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(node[i]), int(node[j])))
    return out


def further(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Parts after more links: the links are drawn between parts, which are fewer than nodes."""
    own = lambda side: parts.select(F.col("node").alias(side), F.col("part").alias(f"p{side}"))
    drawn = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    drawn = cut(drawn.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b").distinct())
    if not drawn.limit(1).count():
        return parts
    up = cut(components(drawn))
    known = parts.join(up.withColumnsRenamed({"node": "part", "component": "to"}), "part", "left").select("node", F.coalesce("to", "part").alias("part"))
    fresh = up.join(parts, "node", "left_anti").select("node", F.col("component").alias("part"))
    return known.unionByName(fresh)


def reordered(first: DataFrame, bodies: "Bodies", common: DataFrame, percent: int) -> DataFrame:
    """(node, n, win) in the order uncommon shingles by hash, then common ones by hash, for more than FEW_PIVOTS common ones.

    They are joined to the members of those sets that hold one in their first window; the windows of all other sets
    are the same in either order.
    """
    moved = first.select("node", F.explode("win").alias("pivot")).join(common, "pivot", "left_semi").select("node").distinct()
    sets = bodies.of(moved).select("node", "sh")
    flat = sets.select("node", F.explode("sh").alias("pivot")).join(common, "pivot", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("pivot")).alias("late"))
    other = sets.join(flat, "node").select("node", F.concat(F.array_except("sh", "late"), F.col("late")).alias("order"))
    size = window_size(F.col("n"), percent)
    return first.join(other, "node", "left").select("node", "n", F.coalesce(F.slice("order", 1, size), "win").alias("win"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(read(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component, that of the least doc_id; documents without an id stay."""
    return one_of_each(docs)
