"""Run arguments, session, latency harness, store settings and size reports."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.telemetry import SCHEMES
from ..sources import cold, manifest
from ..sources.generator import START, Config


@dataclass(frozen=True)
class Args:
    """--name=value options; a number may hold underscores."""

    given: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def parse(argv: list[str]) -> "Args":
        out = {}
        for a in argv:
            name, sign, value = a.removeprefix("--").partition("=")
            if not a.startswith("--") or not sign:
                raise ValueError(f"not of the form --name=value: {a}")
            out[name] = value
        return Args(out)

    def number(self, name: str, default: int) -> int:
        return int(self.given[name].replace("_", "")) if name in self.given else default

    def text(self, name: str, default: str) -> str:
        return self.given.get(name, default)

    def config(self) -> Config:
        start = datetime.fromisoformat(self.given["start"].replace("Z", "+00:00")).astimezone(timezone.utc) if "start" in self.given else START
        return Config(self.number("tenants", 3), self.number("devices-per-tenant", 200), self.number("interval-seconds", 10) * 1000, start)

    def count(self) -> int:
        return self.config().count(self.number("days", 0), self.number("count", 1_000_000))


#: Settings that every query here relies on.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MILLIS", "spark.sql.sources.partitionColumnTypeInference.enabled": "false"}


@dataclass(frozen=True)
class Store:
    """An object store: a part has 5 MiB at least, and an object below one part is not sent in parts."""

    bucket: str
    endpoint: str | None = None
    path_style: bool = True
    part: int = 8 << 20
    threshold: int = 8 << 20

    def __post_init__(self):
        if not self.bucket.strip():
            raise ValueError("a bucket needs a name")
        if self.part < 5 << 20:
            raise ValueError("a part has 5 MiB at least")
        if self.threshold < self.part:
            raise ValueError("below a part's size there is nothing to send in parts")

    def settings(self) -> dict[str, str]:
        out = {"spark.hadoop.fs.s3a.path.style.access": str(self.path_style).lower(), "spark.hadoop.fs.s3a.multipart.size": str(self.part), "spark.hadoop.fs.s3a.multipart.threshold": str(self.threshold)}
        return out | ({"spark.hadoop.fs.s3a.endpoint": self.endpoint} if self.endpoint else {})

    def parts(self, size: int) -> int:
        """Parts of an object: one up to the threshold."""
        return 1 if size <= self.threshold else math.ceil(size / self.part)


def session(cpus: str = "*", store: Store | None = None) -> SparkSession:
    return SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS | (store.settings() if store else {})).getOrCreate()


def nearest_rank(took: list[float], share: float) -> float:
    return sorted(took)[max(0, math.ceil(share * len(took)) - 1)]


def latency(run: Callable[[], DataFrame], warmup: int = 3, iterations: int = 20) -> dict:
    """One cold run, warm-up runs, then p50 and p95 of so many runs, in ms. A query that gives no row is an error."""

    def once() -> tuple[float, int]:
        began = time.perf_counter()
        rows = len(run().take(1_000_000))
        return 1000 * (time.perf_counter() - began), rows

    cold_ms, rows = once()
    if not rows:
        raise LookupError("the query gives no row")
    for _ in range(warmup):
        once()
    took = [once()[0] for _ in range(iterations)]
    return {"rows": rows, "cold_ms": round(cold_ms, 1), "p50_ms": round(nearest_rank(took, 0.5), 1), "p95_ms": round(nearest_rank(took, 0.95), 1)}


def layout_matrix(points: DataFrame, folder: str, codecs: tuple[str, ...] = ("SNAPPY", "GZIP", "ZSTD"), column: str = "dbl_v") -> DataFrame:
    """(layout, codec, files, bytes, n_rows, bytes_per_row) of the same points written in every layout and codec."""
    spark, out = points.sparkSession, None
    for layout in cold.LAYOUTS:
        for codec in codecs:
            to = f"{folder}/{layout}-{codec}"
            if layout == "PER_KEY_TYPED":
                cold.write_per_key(points, to, column, codec)
            else:
                cold.write_single(points, to, layout, codec=codec)
            files = manifest.listed(spark, to)
            part = manifest.totals(files).select("files", "bytes").crossJoin(manifest.row_count(manifest.footers(files)))
            part = part.select(F.lit(layout).alias("layout"), F.lit(codec).alias("codec"), "files", "bytes", "n_rows", ratio("bytes", "n_rows").alias("bytes_per_row"))
            out = part if out is None else out.unionByName(part)
    return out


def ratio(a: str, b: str):
    """a / b, 0 where b is 0 or null."""
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def smallest(results: DataFrame) -> DataFrame:
    """The result of the fewest bytes, ties by name."""
    return results.orderBy("bytes", "layout", "codec").limit(1)


def scheme_matrix(points: DataFrame, folder: str, schemes: tuple[str, ...] = tuple(SCHEMES)) -> DataFrame:
    """(scheme, files, bytes, directories, mean_kib) of the same points under every scheme."""
    spark, out = points.sparkSession, None
    for name in schemes:
        cold.write(points, f"{folder}/{name}", scheme=name, mode="overwrite")
        part = manifest.totals(manifest.listed(spark, f"{folder}/{name}")).select(F.lit(name).alias("scheme"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def slowest(uploads: DataFrame, most: int = 10) -> DataFrame:
    """The uploads (key, bytes, elapsed_ms) that took longest, with their MiB a second; ties by key."""
    return uploads.withColumn("mib_s", F.round(F.when(F.col("elapsed_ms") > 0, F.col("bytes") / 1048576 / (F.col("elapsed_ms") / 1000)).otherwise(0.0), 3)).orderBy(F.desc("elapsed_ms"), "key").limit(most)
