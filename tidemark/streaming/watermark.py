"""Event-time watermark in arrival order, late drop, backward steps.

A window over the whole arrival order would put all rows in one task. Rows are dealt by the minute of their arrival
instead; each minute's maximum and last time are carried forward over one row a minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(points: DataFrame, unit: str = "minute") -> DataFrame:
    """Adds wm, the greatest ts so far with the current row, and prev_ts, the ts that arrived just before.

    Points arrive in order of arrived, then event_id; those without an arrival get null for both. unit is the
    date_trunc unit of a task's rows: only rows of one unit are sorted together.
    """
    rows = points.where(F.col("arrived").isNotNull()).withColumn("_unit", F.date_trunc(unit, "arrived"))
    units = rows.groupBy("_unit").agg(F.max("ts").alias("m"), F.max_by("ts", F.struct("arrived", "event_id")).alias("last"))
    over = Window.orderBy("_unit")
    carried = units.select("_unit", F.max("m").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_m"), F.lag("last").over(over).alias("_last"))
    own = Window.partitionBy("_unit").orderBy("arrived", "event_id")
    out = rows.join(carried, "_unit")
    out = out.withColumn("wm", F.greatest(F.max("ts").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_m"))
    out = out.withColumn("prev_ts", F.coalesce(F.lag("ts").over(own), "_last")).drop("_unit", "_m", "_last")
    return out.unionByName(points.where(F.col("arrived").isNull()), allowMissingColumns=True)


def is_late(days: int, ts: str = "ts", mark: str = "wm") -> Column:
    """Strictly further behind the watermark than the lag."""
    return F.col(ts) < F.col(mark) - F.make_dt_interval(F.lit(days))


def closeness(points: DataFrame, path: Column, days: int) -> DataFrame:
    """(path, last_ts, closed): each partition's last time, and whether it lies behind the final watermark by more than the lag."""
    last = points.groupBy(path.alias("path")).agg(F.max("ts").alias("last_ts"))
    mark = points.agg(F.max("ts").alias("wm"))
    return last.crossJoin(F.broadcast(mark)).select("path", "last_ts", is_late(days, "last_ts").alias("closed"))
