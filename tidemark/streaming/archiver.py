"""Streaming archiver: a stream of points into the cold tier, at least once, with duplicates removed on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.telemetry import VALUE_COLUMNS
from ..sources import cold


def source(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Points that arrive as Parquet files; a Kafka topic takes this place where its connector is installed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def archive(stream: DataFrame, root: str, checkpoint: str, quarantine: str | None = None, **how) -> StreamingQuery:
    """Writes each micro-batch kind by kind; offsets are committed after the files are, so a batch may be written twice.

    Points whose key or profile is no path go to the quarantine folder, or are left out without one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = cold.quarantined(batch)
        for column in VALUE_COLUMNS:
            part = good.where(F.col(column).isNotNull())
            if part.limit(1).count():
                cold.write(part, root, column, mode="append", **how)
        if quarantine is not None:
            bad.write.mode("append").partitionBy("key").parquet(quarantine)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(points: DataFrame, keys: tuple[str, ...] = ("tenant_id", "device_id", "key", "ts"), prefer: str | None = None) -> DataFrame:
    """One row of each point; of several the one with the greatest prefer column, else any."""
    if prefer is None:
        return points.dropDuplicates(list(keys))
    own = Window.partitionBy(*keys).orderBy(F.desc(prefer))
    return points.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


class LateDrop:
    """Late drop over micro-batches: the watermark, raised by every batch, is carried from batch to batch.

    The engine's own watermark advances between batches and drops nothing from a stateless query, so the exact rule is
    applied to each batch in arrival order, with the maximum of the batches before.
    """

    def __init__(self, days: int):
        self.days, self.mark, self.dropped = days, None, 0

    def __call__(self, batch: DataFrame) -> DataFrame:
        from .watermark import is_late, running

        marked = running(batch)
        if self.mark is not None:
            marked = marked.withColumn("wm", F.greatest("wm", F.lit(self.mark)))
        top = batch.agg(F.max("ts")).first()[0]
        self.mark = max((x for x in (self.mark, top) if x is not None), default=None)
        return marked.where(~F.coalesce(is_late(self.days), F.lit(False))).drop("wm", "prev_ts")
