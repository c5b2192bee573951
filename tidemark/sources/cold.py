"""Cold tier: Parquet trees in three value layouts, scans of them, single files.

A tree has one directory per partition value and key. Rows are sorted by the partition columns, device and time before
they are written, so that Spark adds no sort of its own and row groups hold narrow ranges of devices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.telemetry import SCHEMES, VALUE_COLUMNS, kind, stringified, valid_name

CODECS = {"UNCOMPRESSED": "none", "SNAPPY": "snappy", "ZSTD": "zstd", "GZIP": "gzip"}
LAYOUTS = ("SPARSE_TYPED", "STRINGIFIED", "PER_KEY_TYPED")
HEAD = ["tenant_id", "profile", "device_id"]
QUARANTINE = "__quarantine__"


class Rejected(ValueError):
    """Points that cannot be written: a key or profile that is no path, or a key with values of two kinds."""


def values(layout: str, column: str = "dbl_v") -> list[Column]:
    """The value columns of a layout; PER_KEY_TYPED holds one column under the name value."""
    if layout == "SPARSE_TYPED":
        # JSON shares the string column, as in a file of this layout the two cannot be told apart
        return [F.col("bool_v"), F.col("long_v"), F.col("dbl_v"), F.coalesce("str_v", "json_v").alias("str_v")]
    if layout == "STRINGIFIED":
        return [kind().alias("value_type"), stringified().alias("value_str")]
    if layout == "PER_KEY_TYPED":
        return [F.col(column).alias("value")]
    raise ValueError(f"unknown layout {layout}")


def codec_of(name: str) -> str:
    if name not in CODECS:
        raise ValueError(f"unknown codec {name}")
    return CODECS[name]


def checked(points: DataFrame) -> DataFrame:
    """The points, failing while they are written if a key or profile is no valid path value; no scan of its own."""
    ok = valid_name(F.col("key")) & valid_name(F.col("profile"))
    message = F.concat(F.lit("a key or profile cannot be a path: "), F.coalesce("key", F.lit("null")), F.lit(", "), F.coalesce("profile", F.lit("null")))
    return points.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(message).cast("string")))


def quarantined(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points whose key and profile are paths, and the others under the quarantine key with their own key beside it."""
    ok = valid_name(F.col("key")) & valid_name(F.col("profile"))
    return points.where(ok), points.where(~ok).withColumn("bad_key", F.col("key")).withColumn("key", F.lit(QUARANTINE))


def unstable_keys(points: DataFrame, scheme: str = "tenant-date") -> DataFrame:
    """(partition columns, key, kinds) where one partition and key holds values of several kinds."""
    levels = [make().alias(name) for name, make in SCHEMES[scheme]]
    return points.groupBy(*levels, "key").agg(F.collect_set(kind()).alias("kinds")).where(F.size("kinds") > 1)


def dealt(points: DataFrame, scheme: str, layout: str, column: str, splits: int) -> tuple[DataFrame, list[str]]:
    levels = [name for name, _ in SCHEMES[scheme]] + ["key"]
    made = [make().alias(name) for name, make in SCHEMES[scheme]]
    seq = [F.col("arrival_seq")] if "arrival_seq" in points.columns else []
    tail = ["device_id", "ts", *[c for c in ("arrival_seq",) if seq]]
    base = points.select(*made, "key", *HEAD, "ts", *values(layout, column), *seq)
    # a partition goes to as many tasks as splits, by device, so that no device is cut
    by = [*levels, F.pmod(F.xxhash64("device_id"), F.lit(splits))] if splits > 1 else levels
    out = base.repartition(*by).sortWithinPartitions(*levels, *tail)
    return out.select(*levels, *[c for c in HEAD if c not in levels], "ts", *[c for c in out.columns if c.startswith("value") or c in VALUE_COLUMNS]), levels


def write(points: DataFrame, root: str, column: str = "dbl_v", scheme: str = "tenant-date", layout: str = "PER_KEY_TYPED", codec: str = "ZSTD", version: str = "v2", row_group: int = 32 << 20, file_rows: int = 0, splits: int = 1, mode: str = "append") -> None:
    """Write below scheme/key, sorted by device and time, ties in arrival order.

    PER_KEY_TYPED writes the points of one kind, those with a value in column. file_rows rolls files over, 0 never;
    splits deals each partition to so many tasks. mode "append" adds files under names of their own, "overwrite" wipes.
    Invalid keys and profiles, and a key of two kinds within a partition, fail the write and publish nothing.
    """
    rows = points.where(F.col(column).isNotNull()) if layout == "PER_KEY_TYPED" else points
    if layout == "PER_KEY_TYPED":
        bad = unstable_keys(points.join(rows.select("key").distinct(), "key", "left_semi"), scheme).limit(1).collect()
        if bad:
            raise Rejected(f"key {bad[0]['key']!r} holds values of kinds {sorted(bad[0]['kinds'])}")
    out, levels = dealt(checked(rows), scheme, layout, column, splits)
    options(out.write.mode(mode).partitionBy(*levels), codec, version, row_group).option("maxRecordsPerFile", file_rows).parquet(root)


def options(writer, codec: str, version: str, row_group: int):
    return writer.option("compression", codec_of(codec)).option("parquet.writer.version", version).option("parquet.block.size", row_group)


def write_all(points: DataFrame, root: str, **how) -> None:
    """Every kind below one root: one typed write per kind."""
    for column in VALUE_COLUMNS:
        write(points, root, column, **how)


def write_single(points: DataFrame, path: str, layout: str, column: str = "dbl_v", codec: str = "ZSTD", version: str = "v2", row_group: int = 128 << 20) -> None:
    """One file of a layout, key column included; an existing path fails and is never overwritten."""
    rows = points.where(F.col(column).isNotNull()) if layout == "PER_KEY_TYPED" else points
    out = rows.select(*HEAD, *(["key"] if layout != "PER_KEY_TYPED" else []), "ts", *values(layout, column))
    options(out.coalesce(1).write.mode("errorifexists"), codec, version, row_group).parquet(path)


def write_per_key(points: DataFrame, root: str, column: str = "dbl_v", codec: str = "ZSTD", row_group: int = 128 << 20) -> None:
    """key=<k> directories of one typed file each, in the older page format."""
    rows = checked(points.where(F.col(column).isNotNull())).select("key", *HEAD, "ts", F.col(column).alias("value"))
    options(rows.repartition("key").sortWithinPartitions("key").write.mode("append").partitionBy("key"), codec, "v1", row_group).parquet(root)


def schema(scheme: str, value: str = "double") -> StructType:
    """The schema of a per-key tree: with it no file is opened to infer one, and kinds never mix."""
    levels = [name for name, _ in SCHEMES[scheme]] + ["key"]
    fields = [*[f"{c} string" for c in HEAD], "ts timestamp_ntz", f"value {value}", *[f"{c} {'date' if c == 'date' else 'string'}" for c in levels if c not in HEAD]]
    return StructType.fromDDL(", ".join(dict.fromkeys(fields)))


def scan(spark: SparkSession, root: str, paths: list[str] | None = None, scheme: str = "tenant-date", value: str = "double") -> DataFrame:
    """A tree, or only the given files of it; partition columns come from the paths."""
    return spark.read.schema(schema(scheme, value)).option("basePath", root).parquet(*(paths if paths is not None else [root]))


def shape(columns: list[str]) -> dict[str, str | None]:
    """Which columns hold tenant, device and date: the path's where there is one, else the file's."""
    first = lambda *names: next((n for n in names if n in columns), None)
    return {"tenant": first("tenant", "tenant_id"), "device": first("device", "device_id"), "date": first("date")}


def schema_probe(spark: SparkSession, trees: dict[str, str], candidates: tuple[str, ...] = ("tenant", "tenant_id", "device", "device_id", "profile", "date")) -> DataFrame:
    """(scheme, column, type, present) of each tree's columns and of the candidates it lacks."""
    rows = []
    for name, root in trees.items():
        types = dict(spark.read.option("basePath", root).parquet(root).dtypes)
        rows += [(name, c, types.get(c), c in types) for c in dict.fromkeys([*types, *candidates])]
    return spark.createDataFrame(rows, "scheme string, column string, type string, present boolean")
