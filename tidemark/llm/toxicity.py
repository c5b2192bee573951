"""Operator 2: toxicity classifier, logistic over words, with a counterfactual penalty on identity terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read


#: Identity terms that are swapped for the next one of the list.
IDENTITY = "muslim christian jewish hindu buddhist atheist black white asian african european gay lesbian straight trans woman man women men immigrant refugee disabled deaf blind elderly young musulman chrétien juif noir blanc femme homme frau mann jude muslima mujer hombre negro blanco".split()

#: At most so many labelled rows of either class are fitted; they come in order of a hash of doc_id.
MAX_ROWS_PER_CLASS = 10_000


def tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), lambda w: w != "")


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def swapped(words: Column) -> Column:
    after = F.create_map(*[F.lit(x) for a, b in zip(IDENTITY, IDENTITY[1:] + IDENTITY[:1]) for x in (a, b)])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(after, w), w))


#: Least two-proportion z of a word's rates in the two classes; which one holds is chosen by cross-validation.
CUTS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 7.0)
FOLDS = 4
#: The cut is chosen over the first rows of either class, at most so many; all rows are fitted with it.
FOLD_ROWS = 2_000

#: The bias where nothing can be learned: a score of 0.12, below the threshold.
NOTHING = np.zeros(0, np.int64), np.zeros(0), -2.0


def distinct(row: np.ndarray, code: np.ndarray, n_words: int, y: np.ndarray, least: int) -> np.ndarray:
    """The z of each word over rows with y of 0 or 1 (others are left out); -1 for words in fewer than least rows."""
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    in0, in1 = (np.bincount(code[y[row] == k], minlength=n_words) for k in (0, 1))
    rate = (in0 + in1) / (n0 + n1)
    z = np.abs(in1 / n1 - in0 / n0) / np.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1) + 1e-12)
    return np.where(in0 + in1 >= min(least, n0, n1), z, -1.0)


def descend(row: np.ndarray, code: np.ndarray, n_words: int, y: np.ndarray, swaps: list, penalty: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias from rows with y of 0 or 1. swaps: (row, codes of its swapped words)."""
    n, n0, n1 = len(y), (y == 0).sum(), (y == 1).sum()
    swaps = [(i, c) for i, c in swaps if y[i] >= 0]
    crow = np.repeat(np.arange(len(swaps)), [len(c) for _, c in swaps]).astype(int)
    ccode = np.concatenate([np.zeros(0, int), *[c for _, c in swaps]])
    base = np.asarray([i for i, _ in swaps], int)
    share = np.where(y == 1, 0.5 / n1, np.where(y == 0, 0.5 / n0, 0.0))
    w, b = np.zeros(n_words), 0.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[code], n) + b
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        full, grad = g, l2 * w
        if len(swaps):
            gap = (z[base] - b - np.bincount(crow, w[ccode], len(swaps))) * 2 * penalty / len(swaps)
            full = g + np.bincount(base, gap, n)
            grad = grad - np.bincount(ccode, gap[crow], n_words)
        grad = np.r_[grad + np.bincount(code, full[row], n_words), g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w, b = np.sign(w - move[:-1]) * np.maximum(0, np.abs(w - move[:-1]) - 0.001), b - move[-1]
    return w, float(b)


def numbered(values: np.ndarray, run: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and each value's place among them, as np.unique gives them, at a third of its memory."""
    keys = np.sort(values)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    code = np.empty(len(values), np.int32)
    for k in range(0, len(values), run):
        code[k : k + run] = np.searchsorted(keys, values[k : k + run])
    return keys, code


def fit(labelled: DataFrame, penalty: float = 1.0, l2: float = 1e-4, steps: int = 400, least: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on (doc_id, text, toxic): sorted word hashes, their weights, and the bias.

    Loss: class-balanced log loss + penalty * mean((z(text) - z(swapped text))^2) + l2 |w|^2. Words are those of at
    least the cut of CUTS whose loss over FOLDS folds is lowest. Rows with a null label are left out. Without two
    rows of each class, or where no cut does better than no words at all, every score is that of NOTHING.
    """
    words = tokens(F.col("text"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = []
    for y in (0, 1):
        part = labelled.where(F.col("toxic") == y).select("doc_id", "text").orderBy(order).limit(MAX_ROWS_PER_CLASS)
        ident = F.exists(words, lambda w: w.isin(IDENTITY))
        parts.append(part.select(hashes(words).alias("x"), F.when(ident, hashes(swapped(words))).alias("c")).toArrow())
    n0, n1 = (p.num_rows for p in parts)
    if min(n0, n1) < 2:
        return NOTHING
    # all of this stands in the driver's memory: places have 32 bits, classes and folds 8, and what is used up goes
    swapped_rows = [(i, np.asarray(c.values, np.int64)) for i, c in enumerate(x for p in parts for x in p.column("c")) if c.is_valid]
    xs = pa.concat_tables(parts).column("x").combine_chunks()
    del parts
    row = np.repeat(np.arange(n0 + n1, dtype=np.int32), np.diff(xs.offsets.to_numpy()))
    keys, code = numbered(xs.values.to_numpy())
    del xs
    pa.default_memory_pool().release_unused()
    y = np.repeat(np.arange(2, dtype=np.int8), [n0, n1])

    def trained(y: np.ndarray, cut: float, z: np.ndarray, steps: int) -> tuple[np.ndarray, float] | None:
        held = np.flatnonzero(z >= cut)
        if not len(held):
            return None
        new = np.full(len(keys), -1, np.int32)
        new[held] = np.arange(len(held))
        ok = (new[code] >= 0) & (y[row] >= 0)
        swaps = []
        for i, c in swapped_rows:
            at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
            swaps.append((i, new[at[(keys[at] == c) & (new[at] >= 0)]]))
        w, b = descend(row[ok].astype(int), new[code[ok]].astype(int), len(held), y, swaps, penalty, l2, steps)
        out = np.zeros(len(keys))
        out[held] = w
        return out, b

    # each fold takes a share of either class; its words are chosen and weighted without its rows
    folds = min(FOLDS, n0, n1)
    place = np.r_[np.arange(n0), np.arange(n1)]
    fold = np.where(place < FOLD_ROWS, place % folds, -1).astype(np.int8)
    early = fold[row] >= 0
    all_row, all_code, (row, code) = row, code, (row[early], code[early])
    loss = np.zeros(len(CUTS))
    for k in range(folds):
        learn = np.where((fold == k) | (fold < 0), -1, y)
        z = distinct(row, code, len(keys), learn, least)
        test = np.flatnonzero(fold == k)
        own = fold[row] == k
        for j, cut in enumerate(CUTS):
            made = trained(learn, cut, z, steps // 4)
            s = np.zeros(n0 + n1) if made is None else np.bincount(row[own], made[0][code[own]], n0 + n1) + made[1]
            each = np.logaddexp(0, np.where(y == 1, -s, s))[test]
            loss[j] += (each[y[test] == 0].mean() + each[y[test] == 1].mean()) / 2 / folds
    row, code = all_row, all_code
    # of equal losses the higher cut, which takes fewer words
    best = max(j for j in range(len(CUTS)) if loss[j] <= loss.min() + 1e-9)
    made = trained(y, CUTS[best], distinct(row, code, len(keys), y, least), steps) if loss[best] < np.log(2) - 1e-9 else None
    if made is None or not made[0].any():
        return NOTHING
    used = made[0] != 0
    return keys[used], made[0][used], made[1]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted; columns of these names are replaced. A text without any word of the model scores as the bias, at most as that of NOTHING."""
    bounded(docs.sparkSession)
    keys, weights, bias = model

    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def total(column: pa.Array) -> pa.Array:
        off, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            known = keys[at] == values
            each = np.where(known, weights[at], 0.0)
        else:
            known, each = np.zeros(len(values), bool), np.zeros(len(values))
        run, seen = np.r_[0.0, np.cumsum(each)], np.r_[0, np.cumsum(known)]
        start = np.where(seen[off[1:]] > seen[off[:-1]], bias, min(bias, NOTHING[2]))
        return pa.array(1 / (1 + np.exp(-np.clip(np.round(run[off[1:]] - run[off[:-1]], 9) + start, -30, 30))))

    out = docs.withColumn("score", total(hashes(tokens(F.col("text")))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def model_of(spark: SparkSession, sf_dir: str):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    learn = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    # rows are chosen among the labels, so at most two classes of MAX_ROWS_PER_CLASS ids are broadcast and no other text is shuffled
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [learn.where(F.col("toxic") == y).orderBy(order).limit(MAX_ROWS_PER_CLASS) for y in (0, 1)]
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, model_of(spark, sf_dir)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; null and empty texts stay, as do columns named as the score's."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return score(rows, model_of(spark, sf_dir)).where("predicted = 0").select("doc.*")
