"""Telemetry points: the view over events, partition schemes, value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The value columns of a point, and the kind that each stands for; exactly one is not null.
VALUE_COLUMNS = {"bool_v": "BOOL", "long_v": "LONG", "dbl_v": "DOUBLE", "str_v": "STRING", "json_v": "JSON"}


def kind() -> Column:
    """The kind of a point's value, null where it has none."""
    return F.coalesce(*[F.when(F.col(c).isNotNull(), k) for c, k in VALUE_COLUMNS.items()])


def stringified() -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in VALUE_COLUMNS])


def month_start(ts: Column) -> Column:
    """The first instant of the month in milliseconds since 1970, UTC."""
    return F.unix_millis(F.date_trunc("month", ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def points(e: DataFrame) -> DataFrame:
    """Events as points of one typed value each."""
    key = F.col("event_type")
    late = F.when(F.col("event_id") % 20 == 0, (F.floor(F.col("event_id") / 20).cast("int") % 10) + 1).otherwise(0)
    return e.select(
        "event_id",
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.when(F.col("user_id") % 2 == 0, "industrial-sensor").otherwise("lab-sensor").alias("profile"),
        F.concat(F.lit("dev-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("device_id"),
        key.alias("key"),
        "ts",
        F.col("ts").cast("date").alias("date"),
        F.col("value"),
        F.when(key == "view", F.col("value") > 10).alias("bool_v"),
        F.when(key == "click", F.floor(F.col("value") * 100).cast("bigint")).alias("long_v"),
        F.when(key == "purchase", F.col("value")).alias("dbl_v"),
        F.when(key == "error", F.concat(F.lit("E"), (F.floor("value").cast("bigint") % 5).cast("string"))).alias("str_v"),
        F.when(key == "signup", F.col("props")).alias("json_v"),
        (F.col("ts") + F.make_dt_interval(late)).alias("arrived"),
    )


def hour(ts: Column) -> Column:
    return F.date_format(ts, "HH")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


#: Partition schemes: names and expressions of the path levels, in order.
SCHEMES: dict[str, list[tuple[str, object]]] = {
    "date": [("date", lambda: day(F.col("ts")))],
    "date-hour": [("date", lambda: day(F.col("ts"))), ("hour", lambda: hour(F.col("ts")))],
    "tenant-date": [("tenant", lambda: F.col("tenant_id")), ("date", lambda: day(F.col("ts")))],
    "tenant-profile-date": [("tenant", lambda: F.col("tenant_id")), ("profile", lambda: F.col("profile")), ("date", lambda: day(F.col("ts")))],
    "tenant-profile-date-hour": [("tenant", lambda: F.col("tenant_id")), ("profile", lambda: F.col("profile")), ("date", lambda: day(F.col("ts"))), ("hour", lambda: hour(F.col("ts")))],
    "tenant-device-date": [("tenant", lambda: F.col("tenant_id")), ("device", lambda: F.col("device_id")), ("date", lambda: day(F.col("ts")))],
}


def path(scheme: str) -> Column:
    return F.concat_ws("/", *[F.concat(F.lit(f"{name}="), value()) for name, value in SCHEMES[scheme]])


def valid_name(c: Column) -> Column:
    """1 to 128 of A-Z a-z 0-9 . _ - and neither . nor .. ; null is invalid."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]{1,128}\z") & ~c.isin(".", ".."), F.lit(False))


def in_range(ts: Column, start: Column, stop: Column) -> Column:
    """Half-open: start <= ts < stop."""
    return (ts >= start) & (ts < stop)
