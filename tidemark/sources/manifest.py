"""Manifest of a tree's files, scans pruned by it, and statistics from Parquet footers.

Listing goes through Hadoop's file system; footers are read on executors, one row a file, and everything after that is
a DataFrame of files, row groups or columns.
"""

from __future__ import annotations

import struct
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("tenant", "profile", "device", "date", "hour", "key")
GROUPS = "path string, size long, row_group int, rows long, column string, kind string, compressed long, uncompressed long, encodings array<string>, min string, max string"


def segment(name: str, path: str = "path") -> Column:
    """The value of a path's name=value segment, null where it has none."""
    return F.nullif(F.regexp_extract(path, f"/{name}=([^/]*)", 1), F.lit(""))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, tenant, profile, device, date, hour, key) of the Parquet files below root, without opening one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return files.select("path", F.col("length").alias("size"), *[segment(n).alias(n) for n in LEVELS])


def with_key(files: DataFrame, key: str) -> DataFrame:
    return files.where(F.col("key") == key)


def totals(files: DataFrame) -> DataFrame:
    """Files, bytes, directories and the mean file size in KiB (0 without files)."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    mean = F.coalesce(F.avg("size") / 1024, F.lit(0.0))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct(folder).alias("directories"), F.round(mean, 3).alias("mean_kib"))


def pruned(files: DataFrame, tenant: str | None = None, device: str | None = None, start: date | None = None, stop: date | None = None) -> DataFrame:
    """Files that may hold the tenant, the device and dates in [start, stop). An axis that a path lacks keeps the file."""
    keep = F.lit(True)
    for name, value in (("tenant", tenant), ("device", device)):
        if value is not None:
            keep = keep & (F.col(name).isNull() | (F.col(name) == value))
    if start is not None:
        keep = keep & (F.col("date").isNull() | (F.col("date") >= str(start)))
    if stop is not None:
        keep = keep & (F.col("date").isNull() | (F.col("date") < str(stop)))
    return files.where(keep)


def paths(files: DataFrame) -> list[str]:
    """The files' paths in order. A pruned scan is planned from them on the driver; none at all is an error."""
    out = [r.path for r in files.select("path").orderBy("path").toLocalIterator()]
    if not out:
        raise LookupError("no file is left after pruning")
    return out


def footer_bytes(data: bytes) -> bytes:
    """The footer of a whole Parquet file, after checks of its size, magic and length."""
    if len(data) < 12:
        raise ValueError("too small for a Parquet file")
    if data[-4:] != b"PAR1":
        raise ValueError("no Parquet magic at the end")
    (length,) = struct.unpack("<i", data[-8:-4])
    if length <= 0 or length > len(data) - 12:
        raise ValueError(f"a footer of {length} bytes does not fit")
    return data[-8 - length : -8]


def footers(files: DataFrame) -> DataFrame:
    """GROUPS: one row for each column of each row group; a file without rows gives none."""

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as file:
                    meta = pq.read_metadata(file)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics
                        known = s is not None and s.has_min_max
                        rows.append((name, size, g, group.num_rows, col.path_in_schema, col.physical_type, col.total_compressed_size, col.total_uncompressed_size, sorted(col.encodings), str(s.min) if known else None, str(s.max) if known else None))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
            names = [f.split()[0] for f in GROUPS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return files.select("path", "size").mapInArrow(run, GROUPS)


def row_count(groups: DataFrame) -> DataFrame:
    """Rows by the footers alone."""
    one = groups.groupBy("path", "row_group").agg(F.first("rows").alias("rows"))
    return one.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))


def column_stats(groups: DataFrame) -> DataFrame:
    """Per column its bytes, the ratio of plain to compressed bytes (0 where nothing is compressed), and its encodings."""
    per = groups.groupBy("column").agg(F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("encodings")))).alias("encodings"))
    return per.withColumn("ratio", F.when(F.col("compressed") > 0, F.col("uncompressed") / F.col("compressed")).otherwise(0.0))


def ranges(groups: DataFrame, column: str) -> DataFrame:
    """(path, row_group, rows, min, max) of a column's row groups; null bounds where the file has no statistics or column."""
    own = groups.where(F.col("column") == column).select("path", "row_group", "min", "max")
    return groups.groupBy("path", "row_group").agg(F.first("rows").alias("rows")).join(own, ["path", "row_group"], "left")


def may_hold(value: str) -> Column:
    """Whether a row group of a string column may hold the value: by its range, and always where that is unknown."""
    return F.coalesce((F.col("min") <= value) & (F.col("max") >= value), F.lit(True))


def pruning_report(groups: DataFrame, column: str, value: str, most: int = 50) -> DataFrame:
    """Over the first files by path (a report of so many): those with a match, their row groups, and the share skipped."""
    first = groups.select("path").distinct().orderBy("path").limit(most)
    per = ranges(groups.join(first, "path", "left_semi"), column).groupBy("path").agg(F.count(F.lit(1)).alias("groups"), F.count_if(may_hold(value)).alias("hit"))
    out = per.where("hit > 0").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("groups"), F.lit(0)).alias("groups"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"))
    share = F.when(F.col("groups") > 0, 100.0 * (F.col("groups") - F.col("hit")) / F.col("groups")).otherwise(0.0)
    return out.withColumn("skipped_pct", share).withColumn("too_few_groups", F.col("groups") < 1.5 * F.col("files"))


def column_probe(spark: SparkSession, roots: dict[str, str], key: str) -> DataFrame:
    """Column statistics of each tree's first file, by path, that holds the key."""
    out = None
    for name, root in roots.items():
        first = with_key(listed(spark, root), key).orderBy("path").limit(1)
        part = column_stats(footers(first)).withColumn("tree", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def scan_stats(df: DataFrame) -> dict[str, int]:
    """Files read, bytes of them and rows put out by the scans of a DataFrame, from its plan's metrics after it has run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    out = {"numFiles": 0, "filesSize": 0, "numOutputRows": 0}
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(plan.executedPlan())
            continue
        if plan.nodeName().startswith("Scan parquet"):
            for name in out:
                metric = plan.metrics().get(name)
                if metric.isDefined():
                    out[name] += metric.get().value()
        if "QueryStage" in plan.nodeName():
            todo.append(plan.plan())
        kids = plan.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return out
