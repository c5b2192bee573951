"""Hot and cold tiers: merge, month partitions, reconciliation, backfill, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.telemetry import month_start
from ..sources import cold, manifest

POINT = ["tenant_id", "device_id", "key", "ts"]


def merge(cold_points: DataFrame, hot_points: DataFrame) -> DataFrame:
    """Points of both tiers; where both hold one (tenant, device, key, time), the hot one stays. Nulls match nothing."""
    return cold_points.join(hot_points.select(*POINT), POINT, "left_anti").unionByName(hot_points)


def hot_shape(points: DataFrame) -> DataFrame:
    """The hot table's columns: entity, key, month partition and time in milliseconds, one value column filled."""
    return points.select(
        F.lit("DEVICE").alias("entity_type"), F.col("device_id").alias("entity_id"), "key", month_start(F.col("ts")).alias("partition"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "bool_v", "str_v", "long_v", "dbl_v", "json_v"
    )


def reconcile(source: DataFrame, archive: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_source, n_archive, missing) for every group of either side; missing is negative where the archive holds more."""
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    both = count(source, "n_source").join(count(archive, "n_archive"), by, "full_outer").na.fill(0, ["n_source", "n_archive"])
    return both.withColumn("missing", F.col("n_source") - F.col("n_archive"))


def reconcile_footers(spark: SparkSession, source: DataFrame, root: str, by: list[str]) -> DataFrame:
    """The same against a written tree, whose counts come from footers; by are levels of its paths."""
    files = manifest.listed(spark, root)
    rows = manifest.footers(files).groupBy("path", "row_group").agg(F.first("rows").alias("rows")).groupBy("path").agg(F.sum("rows").alias("rows"))
    held = rows.join(files.select("path", *by), "path").groupBy(*by).agg(F.sum("rows").alias("n_archive"))
    both = source.groupBy(*by).agg(F.count(F.lit(1)).alias("n_source")).join(held, by, "full_outer").na.fill(0, ["n_source", "n_archive"])
    return both.withColumn("missing", F.col("n_source") - F.col("n_archive"))


def compact(spark: SparkSession, root: str, to: str, scheme: str = "tenant-date", value: str = "double", codec: str = "ZSTD", file_rows: int = 0, key: str | None = None) -> None:
    """Small files into one (or one of file_rows rows each) for each partition, in a new tree, sorted as the first.

    A per-key tree is compacted key by key, or with one kind's key at a time, since kinds do not mix. The old tree is
    left to the caller, who swaps them once the new one is complete.
    """
    rows = cold.scan(spark, root, None, scheme, value)
    rows = rows if key is None else rows.where(F.col("key") == key)
    levels = [name for name, _ in cold.SCHEMES[scheme]] + ["key"]
    device = "device_id" if "device_id" in rows.columns else "device"
    out = rows.withColumn("date", F.col("date").cast("string")).repartition(*levels).sortWithinPartitions(*levels, device, "ts")
    cold.options(out.write.mode("errorifexists").partitionBy(*levels), codec, "v2", 32 << 20).option("maxRecordsPerFile", file_rows).parquet(to)


def backfill(hot: DataFrame, root: str, **how) -> None:
    """Copies hot points to the cold tree, every kind."""
    cold.write_all(hot, root, **how)
