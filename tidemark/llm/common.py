"""Shared helpers: reading, checkpoints, word hashes, shingles, components.

Arrow batches are bounded in rows and bytes by bounded(), and within cut().
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE = r"[\x20\x09-\x0D]+"

_scopes = threading.local()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset (tests on one machine) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch, at most: so much is held at once by each worker, and beside it; a longer text stands alone.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20

ROWS_SETTING, BYTES_SETTING = (f"spark.sql.execution.arrow.{x}PerBatch" for x in ("maxRecords", "maxBytes"))


def bounded(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes of an Arrow batch to BATCH_ROWS and BATCH_BYTES, for all queries alike; a lower number of rows stays."""
    if not 0 < int(spark.conf.get(ROWS_SETTING)) <= BATCH_ROWS:
        spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))
    spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside go when the block ends, but for those cut with outer=True."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for folder in stack.pop():
            delete(spark, folder)


def cut(df: DataFrame, outer: bool = False) -> DataFrame:
    """Cut the lineage by a table in the shared folder, so that a lost executor costs no more than what follows.

    The table belongs to the scratch block around, or with outer=True to the one around that; without one it stays.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    # what is cut is on disk, so the shuffle files behind it go at once rather than at some later collection of garbage
    # and Arrow batches are small, since some hold whole sets or texts
    own = {CLEANUP: "true", ROWS_SETTING: "256", BYTES_SETTING: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    stack = getattr(_scopes, "stack", [])
    if len(stack) > outer:
        stack[-1 - outer].append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words of a text between runs of space or \\t..\\r, A-Z lowered; null and blank give an empty array."""
    return F.filter(F.split(ascii_lower(text), SPACE), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n word hashes; a shorter text gives one hash of the whole, an empty one none."""
    values = values.view(np.uint64)
    if not len(values):
        return values.view(np.int64)
    width = min(n, len(values))
    out = np.full(len(values) - width + 1, (0x9E3779B97F4A7C15 * width) % 2**64, np.uint64)
    for k in range(width):
        out ^= values[k : k + len(out)]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


#: Texts are hashed in runs of about so many bytes, which bounds the arrays held at once; a longer text stands alone.
RUN_BYTES = 1 << 18


@lru_cache(1)
def byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, the same for a letter A-Z and its lower case, and which bytes are white space."""
    value = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return value, space


@lru_cache(2)
def powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(count - 1, base, np.uint64)])


def hashed_words(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words, A-Z lowered; none for null and blank texts.

    A word's hash is a polynomial of its bytes modulo 2^64, from differences of one running sum over many texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] + RUN_BYTES, "right")) - 1)
        yield from run_of_words(data[ends[k] : ends[stop]], ends[k : stop + 1] - ends[k])
        k = stop


def run_of_words(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(ends) - 1)
    value, space = byte_values()
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
    room = max(RUN_BYTES, 1 << (len(data) + 1).bit_length())
    inside = ~space[data]
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    before[ends[:-1][ends[:-1] < len(data)]] = False
    after[ends[1:][ends[1:] > 0] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * powers(base, room)[: len(data)], out=total[1:])
    out = (total[stop] - total[start]) * powers(inverse, room)[start]
    out += (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.split(out, np.searchsorted(start, ends[1:-1]))


def lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list array as numpy arrays without a copy for each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        return [np.asarray(x or [], np.int64) for x in column.to_pylist()]
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): the smallest node reachable.

    Each round takes the least label among a node's neighbours, then follows labels twice; it ends
    when no label changes. Only a count of changes reaches the driver.
    """
    spark = edges.sparkSession
    with scratch(spark):
        both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
        labels, changed, old = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))), 1, None
        while changed:
            near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
            low = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
            up = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
            labels = cut(low.join(up, low.label == up.n2, "left").select("node", "old", F.least("label", F.coalesce("l2", "label")).alias("label")))
            changed = labels.where("old <> label").limit(1).count()
            labels = labels.select("node", "label")
        return cut(labels.withColumnRenamed("label", "component"), outer=True)
