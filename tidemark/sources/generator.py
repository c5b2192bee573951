"""Synthetic telemetry: points by arithmetic on a range, and late arrival as a new order of the same points."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sensors as S

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class Config:
    """What is generated. Defaults: 3 tenants of 200 devices, a tick every 10 s."""

    tenants: int = 3
    devices: int = 200
    interval_ms: int = 10_000
    start: datetime = START
    profile: str = "industrial-sensor"

    @property
    def per_tick(self) -> int:
        return self.tenants * self.devices * len(S.SENSORS)

    def count(self, days: int = 0, points: int = 1_000_000) -> int:
        """Points asked for: whole days of ticks where days are given, else the count."""
        return days * 86_400_000 // self.interval_ms * self.per_tick if days > 0 else points


def uuid_of(high: Column, low: Column) -> Column:
    """The text of a UUID of two longs."""
    h, lo = (F.lpad(F.lower(F.hex(x)), 16, "0") for x in (high, low))
    cut = lambda c, a, n: F.substring(c, a, n)
    return F.concat_ws("-", cut(h, 1, 8), cut(h, 9, 4), cut(h, 13, 4), cut(lo, 1, 4), cut(lo, 5, 12))


def generate(spark: SparkSession, count: int, config: Config = Config()) -> DataFrame:
    """(seq, tick, tenant_id, profile, device_id, key, ts, ts_ms, value columns): tick by tick, then tenant, device and sensor."""
    n = len(S.SENSORS)
    seq = F.col("id")
    device = F.floor(seq / n) % config.devices
    tenant = F.floor(seq / (n * config.devices)) % config.tenants
    tick = F.floor(seq / config.per_tick)
    base = spark.range(count).select(
        seq.alias("seq"), tick.alias("tick"), tenant.alias("t"), device.alias("d"), F.element_at(F.array(*map(F.lit, S.SENSORS)), (seq % n + 1).cast("int")).alias("key"),
        (F.lit(int(config.start.timestamp() * 1000)) + tick * config.interval_ms).cast("long").alias("ts_ms"),
    )
    base = base.withColumn("seed", F.shiftleft(F.col("t"), 32).bitwiseXOR(F.col("d")))
    ts, seed = F.col("ts_ms"), F.col("seed")
    only = lambda key, v: F.when(F.col("key") == key, v)
    return base.select(
        "seq", "tick",
        uuid_of(F.lit(0x7E4A47).cast("long"), F.col("t")).alias("tenant_id"), F.lit(config.profile).alias("profile"), uuid_of(F.lit(0xDE71CE).cast("long") + F.col("t"), F.col("d")).alias("device_id"),
        "key", F.timestamp_millis(ts).cast("timestamp_ntz").alias("ts"), "ts_ms",
        only("running", S.running(ts, seed)).alias("bool_v"), only("power_wh", S.power_wh(ts, seed)).alias("long_v"),
        F.coalesce(only("temperature", S.temperature(ts, seed)), only("humidity", S.humidity(ts, seed))).alias("dbl_v"), only("error_code", S.error_code(ts, seed)).alias("str_v"),
        F.lit(None).cast("string").alias("json_v"),
    )


def delay(seq: Column, seed: int, ratio: float, mean: float, cap: int) -> Column:
    """Ticks by which a point is late: 0 with probability 1 - ratio, else geometric about mean, 1 to cap."""
    late = S.unit(seq, F.lit(seed).cast("long")) < ratio
    drawn = 1 + F.floor(-mean * F.log(1 - S.unit(seq, F.lit(seed + 1).cast("long")))).cast("long")
    return F.when(late, F.least(F.lit(cap).cast("long"), drawn)).otherwise(F.lit(0).cast("long"))


def late_arrival(points: DataFrame, ratio: float = 0.05, mean: float = 10, cap: int = 60, seed: int = 42) -> DataFrame:
    """Adds arrival_tick and late: the same points, in the order arrival_tick, late first, seq. No column changes.

    Points that are due come before a tick's own, and those due after the last tick come at the end, by their tick.
    """
    if not 0 <= ratio <= 1 or cap < 1:
        raise ValueError("ratio lies in 0 to 1, cap is 1 at least")
    drawn = points.withColumn("_delay", delay(F.col("seq"), seed, ratio, mean, cap))
    return drawn.withColumn("arrival_tick", F.col("tick") + F.col("_delay")).withColumn("late", F.col("_delay") > 0).drop("_delay")



def in_arrival_order(points: DataFrame) -> DataFrame:
    return points.orderBy("arrival_tick", F.desc("late"), "seq")


def ndjson(points: DataFrame) -> DataFrame:
    """value: one JSON object a point, a JSON payload embedded as it stands."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    text = lambda c: F.when(c.isNotNull(), F.substring(quoted(c), F.lit(1), F.char_length(quoted(c)) - 1))
    plain = F.coalesce(F.col("bool_v").cast("string"), F.col("long_v").cast("string"), F.col("dbl_v").cast("string"), text(F.col("str_v")), F.col("json_v"), F.lit("null"))
    from ..functions.telemetry import kind

    fields = [("tenantId", text(F.col("tenant_id"))), ("profile", text(F.col("profile"))), ("deviceId", text(F.col("device_id"))), ("key", text(F.col("key"))), ("ts", F.unix_millis(F.col("ts").cast("timestamp")).cast("string")), ("type", text(kind())), ("value", plain)]
    parts = [F.concat(F.lit(("{" if k == 0 else ",") + f'"{name}":'), value) for k, (name, value) in enumerate(fields)]
    return points.select(F.concat(*parts, F.lit("}")).alias("value"))


def ndjson_bytes(points: DataFrame) -> DataFrame:
    """Bytes of the points as lines, a line end between two of them, without writing any."""
    size = ndjson(points).agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n"))
    return size.select(F.col("n").alias("n_rows"), (F.col("b") + F.greatest(F.col("n") - 1, F.lit(0))).alias("n_bytes"))
