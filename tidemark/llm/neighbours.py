"""Operator 6: near-duplicate vectors by a forest of random-projection trees with spill.

Trees split at medians in random directions; a vector within spill of a median goes to both sides. Each tree is joined
on its own: its leaves are compared whole, and only counts and a forest of links leave a leaf, so rows stay linear in
its members. A pair that meets in several leaves is counted in the first that both share. Leaves that outgrow what is
compared at once are split further by trees of their own samples, and what no plane splits is compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import components, cut, read, scratch

#: The trees are fitted on at most so many vectors, in order of a hash of their id; every vector is indexed.
FIT_ROWS = 20_000


class Tree:
    """Median splits by random directions; a vector within spill of the median goes to both sides."""

    def __init__(self, sample: np.ndarray, leaf: int, spill: float, seed: int):
        self.nodes: list[tuple | None] = []
        self.spill, self.leaf, rng = spill, leaf, np.random.default_rng(seed)
        todo = [(sample, None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.nodes)
            self.nodes.append(None)
            if parent is not None:
                self.nodes[parent][2 + side] = me
            if len(rows) <= leaf:
                continue
            d = rng.standard_normal(rows.shape[1])
            d /= np.linalg.norm(d)
            along = rows @ d
            at = float(np.median(along))
            left, right = rows[along <= at], rows[along > at]
            if len(left) and len(right):
                self.nodes[me] = [d, at, 0, 0]
                todo += [(left, me, 0), (right, me, 1)]

    def leaves(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        out, todo = [], [(0, np.arange(len(rows)))]
        while todo:
            n, who = todo.pop()
            if not len(who):
                continue
            if self.nodes[n] is None:
                out.append((n, who))
                continue
            d, at, a, b = self.nodes[n]
            along = rows[who] @ d
            todo += [(a, who[along <= at + self.spill]), (b, who[along > at - self.spill])]
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def finite(column: str):
    """Whether a vector can link: not null, empty or zero, and every component finite."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def links(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = 0.95, trees: int = 6, leaf: int = 300, spill: float = 0.012, size: int = 1000) -> DataFrame:
    """One row a vector: key, n_links, component_id, kept.

    Equal vectors form one class, compared once; a class of c rows gives each c - 1 links besides those to other
    classes. Vectors that are null, zero or not finite link with nothing, and no vector with one of another length.
    A null id links with nothing and has a null component; different vectors of one id are classes of their own.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        rows = vectors.select(F.col(key).alias("id"), F.col(column).alias("v"))
        good = rows.where(F.col("id").isNotNull() & finite("v")).withColumn("cls", F.md5(F.to_json(F.struct(F.transform("v", lambda x: x + F.lit(0).cast("float")).alias("v"))).cast("binary")))
        classes = good.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v"))
        # node: a number of the class's own, fixed once written
        reps = cut(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
        found = None
        for dim in sorted(r.dim for r in reps.select("dim").distinct().collect()):
            part = forest(spark, reps.where(F.col("dim") == dim), dim, least, trees, leaf, spill, size)
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = spark.createDataFrame([], "a bigint, b bigint, w bigint")
        others = found.where("w > 0").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("others"))
        parts = components(found.where("b is not null").select("a", "b"))
        named = reps.drop("v").join(others, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        per = named.join(least_id, "component").select("cls", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        linked = good.join(per, "cls").select("id", "n_links", "component_id")
        alone = rows.where(F.col("id").isNull() | ~finite("v")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        out = linked.union(alone).select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
        return cut(out, outer=True)


def forest(spark, reps: DataFrame, dim: int, least: float, trees: int, leaf: int, spill: float, size: int) -> DataFrame:
    """(a, b, w): for node a, w linked vectors of other classes (b null), or a link a, b of a leaf's forest (w 0)."""
    total = reps.count()
    sample = reps.orderBy(F.xxhash64("node"), "node").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    fitted = matrix(sample, dim)
    # a leaf of the sample stands for about leaf vectors of all, but holds FEW at least; what is larger is split further below
    own_leaf = max(FEW, leaf * len(fitted) // max(total, 1))
    at = None
    for t in range(trees):
        kept = spark.sparkContext.broadcast(Tree(fitted, own_leaf, spill, t))
        part = cut(reps.select("node", "v", F.explode(places(kept, dim)("v")).alias("leaf")).select("node", F.xxhash64(F.lit(t), "leaf").alias("leaf")))
        sizes = part.groupBy("leaf").agg(F.count(F.lit(1)).alias("c"))
        seed = 0
        # a leaf that no plane splits comes back as one, under its old name, and is asked no more
        asked = cut(sizes.where(F.col("c") > size))
        while asked.limit(1).count():
            seed += 1
            new = cut(subdivided(part.join(asked, "leaf").join(reps.select("node", "v"), "node"), dim, leaf, spill, seed))
            part = cut(part.join(asked.select("leaf"), "leaf", "left_anti").unionByName(new.select("node", "leaf")))
            asked = cut(new.where("split").groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > size))
        at = part if at is None else at.union(part)
    # ids and leaves only; vectors join them once
    per = at.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("at"))
    counts = cut(at.distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    placed = cut(reps.select("node", "copies", "v").join(per, "node"))
    out = None
    for t in range(trees):
        # a share of the leaves at a time, which bounds what is on disk at once
        own = placed.select("*", F.explode("at").alias("leaf")).join(counts.where(F.pmod("leaf", F.lit(trees)) == t), "leaf")
        part = cut(blocked(own, size).groupBy("leaf", "lo", "hi").applyInPandas(comparer(dim, least), "a bigint, b bigint, w bigint"))
        out = part if out is None else out.union(part)
    return out


#: A tree is not split below so many rows of its sample; a leaf that is split further gives a sample of about so many.
FEW, MORE = 30, 3000


def places(kept, dim: int):
    """The leaves of a tree that hold a vector."""

    @arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return leaf_lists(kept.value, matrix(column, dim))

    return run


def leaf_lists(tree: Tree, x: np.ndarray) -> pa.Array:
    found = tree.leaves(x)
    who = np.concatenate([np.zeros(0, int), *[w for _, w in found]])
    at = np.concatenate([np.zeros(0, int), *[np.full(len(w), n) for n, w in found]])
    order = np.argsort(who, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(who[order], np.arange(len(x) + 1)), pa.int32()), pa.array(at[order], pa.int32()))


def subdivided(rows: DataFrame, dim: int, leaf: int, spill: float, seed: int) -> DataFrame:
    """(node, leaf, split) of large leaves (leaf, node, c, v): each is split by a tree of a sample of its own, fitted and applied on executors."""
    picked = rows.where(F.pmod(F.xxhash64("node", "leaf"), F.col("c")) < MORE)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        import pickle

        x = matrix(pa.array(group.v.tolist(), pa.list_(pa.float64())), dim)
        tree = Tree(x, max(FEW, int(leaf * len(x) / group.c.iat[0])), spill, seed)
        if max(len(w) for _, w in tree.leaves(x)) > 0.75 * len(x):
            tree.nodes = [None]
        return pd.DataFrame({"leaf": [group.leaf.iat[0]], "c": [group.c.iat[0]], "tree": [pickle.dumps(tree)]})

    made = picked.select("leaf", "c", "v").groupBy("leaf").applyInPandas(fit, "leaf long, c long, tree binary")
    groups = F.ceil(F.col("c") / MORE).cast("int")
    theirs = made.select("leaf", "tree", F.explode(F.sequence(F.lit(0), groups - 1)).alias("s"))
    own = rows.select("leaf", "node", "v", F.pmod(F.xxhash64("node", F.lit(3)), groups).cast("int").alias("s"))

    def apply(group: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        import pickle

        if not len(group):
            return pd.DataFrame({"node": [], "leaf": [], "n": [], "split": []})
        tree = pickle.loads(model.tree.iat[0])
        held = leaf_lists(tree, matrix(pa.array(group.v.tolist(), pa.list_(pa.float64())), dim))
        ends = np.diff(held.offsets.to_numpy())
        return pd.DataFrame({"node": np.repeat(group.node.to_numpy(), ends), "leaf": group.leaf.iat[0], "n": held.values.to_numpy(), "split": len(tree.nodes) > 1})

    out = own.groupBy("leaf", "s").cogroup(theirs.groupBy("leaf", "s")).applyInPandas(apply, "node long, leaf long, n int, split boolean")
    return out.select("node", F.when(F.col("split"), F.xxhash64("leaf", "n")).otherwise(F.col("leaf")).alias("leaf"), "split")


def blocked(own: DataFrame, size: int) -> DataFrame:
    """Leaves that no plane splits are cut into blocks by hash; a member goes to each pair of blocks that holds its own."""
    n = F.ceil(F.col("c") / size).cast("int")
    rows = own.withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("leaf", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "copies", "at", "v")


def comparer(dim: int, least: float):
    """Of a pair of blocks the number of vectors that link with each node, and the fewest links that join what all join."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pa.array(group.v.tolist(), pa.list_(pa.float64())), dim)
        node, copies, side, lo, hi = group.node.to_numpy(), group.copies.to_numpy(), group.own.to_numpy(), group.lo.iat[0], group.hi.iat[0]
        a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        i, j = np.nonzero(x[a] @ x[b].T >= least - 1e-9)
        i, j = a[i], b[j]
        once = i < j if lo == hi else np.ones(len(i), bool)
        i, j = i[once], j[once]
        # the last bits of a matrix product depend on its shape: pairs are summed again, one by one
        exact = np.zeros(len(i), bool)
        for k in range(0, len(i), 50_000):
            p, q = i[k : k + 50_000], j[k : k + 50_000]
            exact[k : k + 50_000] = np.einsum("ij,ij->i", x[p], x[q]) >= least
        i, j = i[exact], j[exact]
        # a pair is counted in the first leaf that both share
        names, codes = np.unique(np.concatenate([*group["at"], [group.leaf.iat[0]]]), return_inverse=True)
        held = np.zeros((len(node), len(names)), bool)
        held[np.repeat(np.arange(len(node)), [len(r) for r in group["at"]]), codes[:-1]] = True
        first = np.zeros(len(i), bool)
        for k in range(0, len(i), 50_000):
            first[k : k + 50_000] = (held[i[k : k + 50_000]] & held[j[k : k + 50_000]]).argmax(1) == codes[-1]
        i, j = i[first], j[first]
        w = (np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))).astype("int64")
        some, tree = np.flatnonzero(w), spanning(i, j, node)
        out = [(int(node[k]), None, int(w[k])) for k in some] + [(p, q, 0) for p, q in tree]
        return pd.DataFrame({c: pd.array([r[k] for r in out], "Int64") for k, c in enumerate("abw")})

    return compare


def spanning(i: np.ndarray, j: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for p, q in zip(i.tolist(), j.tolist()):
        x, y = top(p), top(q)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(node[p]), int(node[q])))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
