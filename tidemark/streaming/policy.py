"""Close policies of a partition writer, and their simulation over points in arrival order.

Which files a writer would close, reopen or evict depends on the order of arrival alone, so a writer is one sequential
fold over slim rows. Writers are independent of each other (each has its own watermark), which is what spreads the work.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows between two sweeps for partitions behind the watermark.
SWEEP = 8192
MAX_OPEN = 64

STATS = "writer string, n_rows long, files long, partitions long, reopens long, rollovers long, evictions long, watermark_closes long, dropped long, max_open long"


@dataclass(frozen=True)
class ClosePolicy:
    """lag None: partitions are closed for want of room only. drop: rows further behind the watermark than lag go."""

    name: str
    lag: timedelta | None = None
    drop: bool = False

    def __post_init__(self):
        if self.lag is None and self.drop:
            raise ValueError("late rows cannot be dropped without a lag")
        if self.lag is not None and self.lag <= timedelta(0):
            raise ValueError("the lag must be more than nothing")

    @staticmethod
    def close(lag: timedelta) -> "ClosePolicy":
        return ClosePolicy(f"watermark-close({human(lag)})", lag)

    @staticmethod
    def dropping(lag: timedelta) -> "ClosePolicy":
        return ClosePolicy(f"watermark-drop({human(lag)})", lag, True)


def human(lag: timedelta) -> str:
    for unit, size in (("d", timedelta(days=1)), ("h", timedelta(hours=1))):
        if lag >= size:
            return f"{lag // size}{unit}"
    return f"{lag // timedelta(minutes=1)}m"


LRU = ClosePolicy("lru")
DEFAULT = ClosePolicy.close(timedelta(days=7))


class Writer:
    """One writer's open partitions. A row is stored before partitions behind the watermark are closed."""

    def __init__(self, policy: ClosePolicy, max_open: int, sweep: int, file_rows: int):
        self.lag = None if policy.lag is None else policy.lag // timedelta(microseconds=1)
        self.drop, self.max_open, self.sweep, self.file_rows = policy.drop, max_open, sweep, file_rows
        self.open: OrderedDict[int, list] = OrderedDict()
        self.seen: set[int] = set()
        self.mark = -(2**63)
        self.rows = self.files = self.rollovers = self.evictions = self.closes = self.dropped = self.most = 0

    def add(self, ts: int, slot: int) -> None:
        if self.lag is not None:
            self.mark = max(self.mark, ts)
            if self.drop and ts < self.mark - self.lag:
                self.dropped += 1
                return
        held = self.open.get(slot)
        if held is None:
            held = self.open[slot] = [ts, 0]
            self.files += 1
            self.seen.add(slot)
            while len(self.open) > self.max_open:
                self.open.popitem(last=False)
                self.evictions += 1
            self.most = max(self.most, len(self.open))
        else:
            self.open.move_to_end(slot)
            if self.file_rows and held[1] == self.file_rows:
                # a full file's next one opens with its first row
                held[1] = 0
                self.files += 1
                self.rollovers += 1
        self.rows += 1
        held[0], held[1] = max(held[0], ts), held[1] + 1
        if self.lag is not None and self.rows % self.sweep == 0:
            behind = [s for s, (last, _) in self.open.items() if last < self.mark - self.lag]
            for s in behind:
                del self.open[s]
            self.closes += len(behind)


def simulate(points: DataFrame, slot: Column, policy: ClosePolicy = DEFAULT, max_open: int = MAX_OPEN, sweep: int = SWEEP, file_rows: int = 0, writer: Column | None = None) -> DataFrame:
    """STATS, one row for each writer: points (ts, arrived, event_id) in order of arrived, then event_id.

    writer names the writer of a point, one for all by default. A writer's rows pass through one task, as
    they do through one writer, in sorted batches: what is held is its open partitions and the names it has seen.
    Rows without a time or an arrival are left out.
    """
    name = F.lit("all") if writer is None else writer.cast("string")
    slim = points.select(name.alias("writer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.xxhash64(slot).alias("slot"), F.unix_micros(F.col("arrived").cast("timestamp")).alias("arrived"), "event_id")
    slim = slim.where("writer is not null and ts is not null and arrived is not null")

    def run(batches):
        made: dict[str, Writer] = {}
        for batch in batches:
            for w, ts, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if w not in made:
                    made[w] = Writer(policy, max_open, sweep, file_rows)
                made[w].add(ts, s)
        rows = [(w, m.rows, m.files, len(m.seen), m.files - len(m.seen) - m.rollovers, m.rollovers, m.evictions, m.closes, m.dropped, m.most) for w, m in made.items()]
        names = [c.split()[0] for c in STATS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64()) for k in range(len(names))], names)

    ordered = slim.repartition("writer").sortWithinPartitions("writer", "arrived", "event_id")
    return ordered.select("writer", "ts", "slot").mapInArrow(run, STATS)


def write_stats(files: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics of a finished write: those of its policy beside the files (path, size) that it left."""
    left = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("written"))
    mean = F.when(F.col("written") > 0, F.col("bytes") / F.col("written")).otherwise(0.0)
    return stats.crossJoin(F.broadcast(left)).withColumn("average_file_bytes", mean)
