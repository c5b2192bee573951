"""Operator 9: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded, grams, lists, read, word_hashes


SEED_WORDS = 4
#: A seed is rare if at most so many test items hold it; an item without rare seeds keeps its rarest ones.
RARE = 5
LEAST_SCORE = 0.6
#: An alignment worth so many equal words is a leak too, whatever its share of a long item.
LONG_WORDS = 50
#: Test items go to the executors in blocks of at most so many, which bounds what is broadcast.
BLOCK = 20_000


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words, match 2, mismatch -1, gap -1: best score, and the passage words [start, end) it spans.

    Rows are vectorised: with linear gaps a running maximum of score + position gives the gaps along a row.
    """
    m = len(passage)
    at = np.arange(m + 1)
    score, begin = np.zeros(m + 1, int), at.copy()
    best = (0, 0, 0)
    for w in item:
        diag = score[:-1] + np.where(passage == w, 2, -1)
        up = score[1:] - 1
        row = np.zeros(m + 1, int)
        row[1:] = np.maximum(np.maximum(diag, up), 0)
        src = at.copy()
        src[1:] = np.where(row[1:] == 0, at[1:], np.where(diag >= up, begin[:-1], begin[1:]))
        lifted = row + at
        top = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == top, at, 0))
        score, begin = top - at, src[where]
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), k)
    return best


def seed_counts(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all seeds, and how many items hold each. An item of fewer than SEED_WORDS words is one seed."""
    own = [np.unique(grams(x, SEED_WORDS)) for x in items]
    return np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)


def seed_table(items: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
    """Sorted hashes of seeds that are rare among all items, and for each the (item, position) pairs that hold it."""
    at = defaultdict(list)
    for i, x in enumerate(items):
        g = grams(x, SEED_WORDS)
        held = counts[1][np.searchsorted(counts[0], g)]
        for p in np.flatnonzero(held <= max(RARE, held.min() if len(held) else 0)):
            at[int(g[p])].append((i, int(p)))
    return np.array(sorted(at), np.int64), dict(at)


def finders(benchmark: DataFrame, least: float) -> list:
    """A function of word hashes to leaks for each block of test items."""
    table = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("w")).toArrow()
    ids, items = table.column("item_id").to_pylist(), [np.array(x) for x in lists(table.column("w"))] if table.num_rows else []
    counts = seed_counts(items)
    return [finder(ids[k : k + BLOCK], items[k : k + BLOCK], counts, least) for k in range(0, max(1, len(ids)), BLOCK)]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, key: str = "doc_id") -> DataFrame:
    """(key, item_id, score, start, end): per document and item the best alignment of at least the given score.

    score is the alignment's share of a perfect copy of the item; an alignment worth LONG_WORDS equal words is given
    at any score. start and end count words. Items with the same words all match. Null or blank texts and items match
    nothing. Candidates of an item are the passages around its seeds, merged where they overlap; every one is aligned.
    """
    bounded(docs.sparkSession)
    out = None
    for find in finders(benchmark, least):
        part = docs.select(key, F.explode(find(word_hashes(F.col("text")))).alias("leak")).select(key, "leak.*")
        out = part if out is None else out.unionByName(part)
    return out


def finder(ids: list[int], items: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray], least: float):
    seeds, at = seed_table(items, counts)
    # items of fewer words are sought at their own width
    widths = sorted({min(SEED_WORDS, len(x)) for x in items if len(x)})

    @arrow_udf("array<struct<item_id:bigint,score:double,start:int,end:int>>")
    def find(column: pa.Array) -> pa.Array:
        out = []
        for words in lists(column):
            found = {}
            if len(words) and len(seeds):
                spots = defaultdict(list)
                for width in widths:
                    if width > len(words):
                        break
                    held = grams(words, width)
                    near = np.searchsorted(seeds, held)
                    near[near == len(seeds)] = 0
                    for p in np.flatnonzero(seeds[near] == held):
                        for i, q in at[int(held[p])]:
                            spots[i].append((int(p) - q, int(p)))
                for i, hits in spots.items():
                    n = len(items[i])
                    slack = n // 4 + 2
                    spans = []
                    for lo, _ in sorted(hits):
                        a, b = max(0, lo - slack), min(len(words), lo + n + slack)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    for a, b in spans:
                        s, x, y = align(items[i], words[a:b])
                        share = s / (2 * n)
                        if (share >= least or s >= 2 * LONG_WORDS) and share > found.get(i, (0,))[0]:
                            found[i] = (share, a + x, a + y)
            out.append([{"item_id": ids[i], "score": s, "start": a, "end": b} for i, (s, a, b) in sorted(found.items())])
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])))

    return find


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, row by row, so that a null or repeated doc_id makes no difference."""
    for find in finders(read(spark, sf_dir, "benchmark").select("item_id", "text"), LEAST_SCORE):
        docs = docs.where(F.size(find(word_hashes(F.col("text")))) == 0)
    return docs
