"""Registered queries over the telemetry view, and their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import telemetry as T
from ..operators import tiering
from ..sources import cold, generator, manifest
from ..streaming import policy, watermark

POINTS = """WITH p AS (
SELECT event_id, concat('t', CAST(user_id % 3 AS VARCHAR)) AS tenant_id,
 CASE WHEN user_id % 2 = 0 THEN 'industrial-sensor' ELSE 'lab-sensor' END AS profile,
 concat('dev-', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS device_id, event_type AS key, ts, CAST(ts AS DATE) AS date, value,
 CASE WHEN event_type='view' THEN value > 10 END AS bool_v,
 CASE WHEN event_type='click' THEN CAST(floor(value*100) AS BIGINT) END AS long_v,
 CASE WHEN event_type='purchase' THEN value END AS dbl_v,
 CASE WHEN event_type='error' THEN concat('E', CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR)) END AS str_v,
 CASE WHEN event_type='signup' THEN props END AS json_v,
 ts + to_days(CAST(CASE WHEN event_id % 20 = 0 THEN (CAST(floor(event_id/20) AS INTEGER) % 10) + 1 ELSE 0 END AS INTEGER)) AS arrived
FROM events) """
KEY = "purchase"


def points(spark: SparkSession, d: str) -> DataFrame:
    return T.points(T.events(spark, d))


def purchases(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where(F.col("key") == KEY)


def busiest(spark: SparkSession, d: str) -> tuple[str, str]:
    """Tenant and device with most points of the key in the date window, ties by name: a series query always has rows."""
    start, stop = window(purchases(spark, d))
    top = within(purchases(spark, d), start, stop).groupBy("tenant_id", "device_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tenant_id", "device_id").first()
    if top is None:
        raise LookupError("the query gives no row")
    return top.tenant_id, top.device_id


def within(df: DataFrame, start: date, stop: date) -> DataFrame:
    return df.where(T.in_range(F.col("date"), F.lit(start), F.lit(stop)))


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def window(df: DataFrame) -> tuple[date, date]:
    """The dates that the series query reads, as literals, so that they prune partitions: one row comes to the driver."""
    row = bounds(df).first()
    if row.first_date is None:
        raise LookupError("the query gives no row")
    span = (row.last_date - row.first_date).days + 1
    start = row.first_date + timedelta(days=span // 4)
    return start, start + timedelta(days=max(1, min(7, span - span // 4)))


def date_window(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(purchases(spark, d))
    span = F.datediff("last_date", "first_date") + 1
    b = b.withColumn("o", F.floor(span / 4).cast("int")).withColumn("w", F.greatest(F.lit(1), F.least(F.lit(7), span - F.col("o"))))
    return b.select("first_date", "last_date", F.date_add("first_date", F.col("o")).alias("from_date"), F.date_add("first_date", F.col("o") + F.col("w")).alias("to_date"))


def of_device(df: DataFrame, tenant: str, device: str) -> DataFrame:
    """The device's rows, by the tenant and device columns that the frame has: of the path, else of the file."""
    own = cold.shape(df.columns)
    return df.where((F.col(own["tenant"]) == tenant) & (F.col(own["device"]) == device))


def q1(df: DataFrame, tenant: str, device: str, start: date, stop: date) -> DataFrame:
    """Raw series of one device over a half-open date range, in order of time."""
    return within(of_device(df, tenant, device), start, stop).select("ts", "value").orderBy("ts")


def q2(df: DataFrame, tenant: str, device: str) -> DataFrame:
    """Daily average of one device, with its number of points."""
    return of_device(df, tenant, device).groupBy("date").agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count(F.lit(1)).alias("n")).orderBy("date")


def q3(df: DataFrame, profile: str = "industrial-sensor") -> DataFrame:
    """One average over a profile, with its number of points."""
    return df.where(F.col("profile") == profile).agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count(F.lit(1)).alias("n"))


_trees: dict[tuple[str, str], str] = {}


def tree(spark: SparkSession, d: str) -> str:
    """The folder of the cold tree of d's purchases, written once a session and deleted at its end."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _trees:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        root = f"{shared}/cold-{uuid.uuid4().hex}" if shared else f"{tempfile.mkdtemp(prefix='cold-')}/tree"
        cold.write(points(spark, d), root, "dbl_v", mode="errorifexists")
        if not shared:
            atexit.register(shutil.rmtree, root.rsplit("/", 1)[0], True)
        _trees[at] = root
    return _trees[at]


def through(spark: SparkSession, d: str, paths: list[str] | None = None) -> DataFrame:
    return cold.scan(spark, tree(spark, d), paths).where(F.col("key") == KEY)


def series_device_range(spark, d):
    return q1(purchases(spark, d), *busiest(spark, d), *window(purchases(spark, d)))


def daily_avg_device(spark, d):
    return q2(purchases(spark, d), *busiest(spark, d))


def profile_avg(spark, d):
    return q3(purchases(spark, d))


def q1_cold(spark, d):
    cut = through(spark, d)
    return q1(cut, *busiest(spark, d), *window(cut)).select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "value")


def q2_cold(spark, d):
    return q2(through(spark, d), *busiest(spark, d))


def q3_cold(spark, d):
    return q3(through(spark, d))


def manifest_full_q2(spark, d):
    """Every file of the key, named one by one."""
    files = manifest.with_key(manifest.listed(spark, tree(spark, d)), KEY)
    return q2(through(spark, d, manifest.paths(files)), *busiest(spark, d))


def manifest_pruned_q2(spark, d):
    """The tenant's files alone."""
    tenant, device = busiest(spark, d)
    files = manifest.pruned(manifest.with_key(manifest.listed(spark, tree(spark, d)), KEY), tenant, device)
    return q2(through(spark, d, manifest.paths(files)), tenant, device)


def manifest_pruned_q1(spark, d):
    tenant, device = busiest(spark, d)
    start, stop = window(purchases(spark, d))
    files = manifest.pruned(manifest.with_key(manifest.listed(spark, tree(spark, d)), KEY), tenant, device, start, stop)
    out = q1(through(spark, d, manifest.paths(files)), tenant, device, start, stop)
    return out.select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "value")


def manifest_listing(spark, d):
    """Files and directories by date, from their names alone."""
    files = manifest.listed(spark, tree(spark, d))
    return files.groupBy(F.col("tenant").alias("tenant"), F.col("date").cast("date").alias("date"), "key").agg(F.count(F.lit(1)).alias("files"))


def footer_rows(spark, d):
    """Rows by tenant and date, from footers alone."""
    files = manifest.listed(spark, tree(spark, d))
    one = manifest.footers(files).groupBy("path", "row_group").agg(F.first("rows").alias("rows"))
    return one.join(files, "path").groupBy("tenant", F.col("date").cast("date").alias("date")).agg(F.sum("rows").alias("n_rows"))


def footer_columns(spark, d):
    return manifest.column_stats(manifest.footers(manifest.listed(spark, tree(spark, d)))).select("column", "compressed", "uncompressed", F.array_join("encodings", ",").alias("encodings"), F.round("ratio", 3).alias("ratio"))


def row_group_pruning(spark, d):
    _, device = busiest(spark, d)
    return manifest.pruning_report(manifest.footers(manifest.listed(spark, tree(spark, d))), "device_id", device)


def schema_probe(spark, d):
    return cold.schema_probe(spark, {"tenant-date": tree(spark, d)})


def partition_fanout(spark, d):
    """Partitions of every scheme: points are reduced to their distinct path parts first, then paths are counted."""
    parts = points(spark, d).groupBy("tenant_id", "profile", "device_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    # each scheme's paths are grouped, then counted, so that none is held in a set
    each = [parts.select(T.path(k).alias("path")).distinct().agg(F.count(F.lit(1)).alias(k.replace("-", "_"))) for k in T.SCHEMES]
    out = each[0]
    for one in each[1:]:
        out = out.crossJoin(F.broadcast(one))
    return out


#: Names that the rule must accept or reject, tried beside the events' own keys.
NAMES = ["temperature", "power_wh", "error_code", "batt.level", "rssi-dbm", "industrial-sensor", "A1", "9", "../../etc/passwd", "..", ".", "...", "a/b", "a=b", "with space", "한글키", "a*b", "", "x" * 128, "x" * 129, "tail\n", None]


def key_validation(spark, d):
    events = points(spark, d).select(F.concat("key", F.when(F.col("event_id") % 3 == 0, "/x").otherwise("_1")).alias("name")).distinct()
    names = events.union(spark.createDataFrame([(n,) for n in NAMES], "name string"))
    return names.select("name", T.valid_name(F.col("name")).alias("valid"))


def layout_sparse(spark, d):
    return points(spark, d).select("event_id", *cold.HEAD, "key", "ts", *cold.values("SPARSE_TYPED"))


def layout_stringified(spark, d):
    """Doubles are written as text by each engine's own rule, so they are rounded to whole numbers before that here."""
    whole = points(spark, d).withColumn("dbl_v", F.round("dbl_v").cast("long").cast("double"))
    made = whole.select("event_id", *cold.HEAD, "key", "ts", *cold.values("STRINGIFIED"))
    return made.withColumn("value_str", F.regexp_replace("value_str", r"\.0$", ""))


def layout_per_key(spark, d):
    return points(spark, d).groupBy("key", T.kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def hot_table(spark, d):
    return tiering.hot_shape(points(spark, d))


def watermark_running(spark, d):
    return watermark.running(points(spark, d)).select("event_id", "ts", "wm")


def late_drop(days):
    return lambda spark, d: watermark.running(points(spark, d)).where(~watermark.is_late(days)).select("event_id", "ts")


def late_counts(spark, d):
    return watermark.running(points(spark, d)).agg(F.count_if(F.col("ts") < F.col("wm")).alias("behind"), *[F.count_if(watermark.is_late(k)).alias(f"late_{k}d") for k in (1, 7, 10)])


def backward_steps(spark, d):
    return watermark.running(points(spark, d)).where("ts < prev_ts").select("event_id", "ts", "prev_ts")


def closeness_to_window(spark, d):
    return watermark.closeness(points(spark, d), T.path("tenant-date"), 7)


def policies(spark, d):
    """What each policy would close and reopen; the sweep is short, since the table is."""
    slot = F.concat(T.path("tenant-date"), F.lit("/key="), F.col("key"))
    runs = [(policy.LRU, 16), (policy.LRU, 512), *[(policy.ClosePolicy.close(timedelta(days=k)), 512) for k in (10, 1)], (policy.ClosePolicy.dropping(timedelta(days=1)), 512)]
    out = None
    for rule, most in runs:
        part = policy.simulate(points(spark, d), slot, rule, most, sweep=256).select(F.lit(rule.name).alias("policy"), F.lit(most).alias("slots"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def month_partition(spark, d):
    return points(spark, d).groupBy(T.month_start(F.col("ts")).alias("partition"), "tenant_id").agg(F.count(F.lit(1)).alias("n"))


def tiers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cold points up to a date and hot ones from the day before it; a hot value is one more than the cold one."""
    df = points(spark, d).select(*tiering.POINT, "value")
    old = df.where(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")).groupBy(*tiering.POINT).agg(F.max("value").alias("value"))
    hot = df.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).groupBy(*tiering.POINT).agg((F.max("value") + 1).alias("value"))
    return old, hot


def hot_cold_merge(spark, d):
    return tiering.merge(*tiers(spark, d))


def boundary_half_open(spark, d):
    """Points of a range that ends on an instant: those on its start are in, those on its end are not."""
    edge = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10", "2024-01-11")]
    return points(spark, d).where(T.in_range(F.col("ts"), *edge)).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def reconcile_counts(spark, d):
    """Source against a cold tier that lacks every seventh event."""
    by = ["tenant_id", "date"]
    return tiering.reconcile(points(spark, d).select(*by), points(spark, d).where("event_id % 7 <> 0").select(*by), by)


def reconcile_footers(spark, d):
    """The purchases against the footers of their tree."""
    source = purchases(spark, d).select(F.col("tenant_id").alias("tenant"), F.col("date").cast("string").alias("date"))
    return tiering.reconcile_footers(spark, source, tree(spark, d), ["tenant", "date"])


def percentile_nearest_rank(spark, d):
    """The value at place ceil(p n) of each tenant: values are counted, and only their running counts meet."""
    counts = purchases(spark, d).where(F.col("value").isNotNull()).groupBy("tenant_id", "value").agg(F.count(F.lit(1)).alias("c"))
    # values fall into ranges by their whole part; totals of ranges are carried, so no task sorts a tenant
    ranged = counts.withColumn("r", F.floor("value"))
    totals = ranged.groupBy("tenant_id", "r").agg(F.sum("c").alias("t"))
    from pyspark.sql import Window

    before = totals.select("tenant_id", "r", (F.sum("t").over(Window.partitionBy("tenant_id").orderBy("r")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy("tenant_id")).alias("n"))
    run = ranged.join(before, ["tenant_id", "r"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("tenant_id", "r").orderBy("value")))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(share)), F.col("value")))
    return run.groupBy("tenant_id").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def topk_largest_partitions(spark, d):
    return points(spark, d).groupBy(T.path("tenant-date").alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(10)


def kind_stability(spark, d):
    return points(spark, d).groupBy("key").agg(F.count_distinct(T.kind()).alias("kinds"))


def ndjson_bytes(spark, d):
    """Bytes of the points as JSON lines; doubles are left out, since engines print them differently."""
    return generator.ndjson_bytes(points(spark, d).where("dbl_v is null"))


def generated(spark, d):
    """A day of two tenants' sensors in late arrival order: counts by key and lateness."""
    config = generator.Config(2, 3, 60_000)
    late = generator.late_arrival(generator.generate(spark, config.count(days=1), config))
    return late.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.count_if(T.kind().isNull()).alias("n_without_value"))


QUERIES: dict = {
    f.__name__: f
    for f in (
        series_device_range, daily_avg_device, profile_avg, q1_cold, q2_cold, q3_cold, manifest_full_q2, manifest_pruned_q2, manifest_pruned_q1, manifest_listing, footer_rows, footer_columns,
        row_group_pruning, schema_probe, date_window, partition_fanout, key_validation, layout_sparse, layout_stringified, layout_per_key, hot_table, watermark_running, late_counts, backward_steps,
        closeness_to_window, policies, month_partition, hot_cold_merge, boundary_half_open, reconcile_counts, reconcile_footers, percentile_nearest_rank, topk_largest_partitions, kind_stability,
        ndjson_bytes, generated,
    )
}
QUERIES |= {f"late_drop_{k}d": late_drop(k) for k in (1, 7)}
QUERIES |= {f"scheme_paths_{k.replace('-', '_')}": (lambda s, d, k=k: points(s, d).groupBy(T.path(k).alias("path")).agg(F.count(F.lit(1)).alias("n"))) for k in T.SCHEMES}

_PATH = {"date": "concat('date=',strftime(ts,'%Y-%m-%d'))", "hour": "concat('hour=',strftime(ts,'%H'))", "tenant": "concat('tenant=',tenant_id)", "profile": "concat('profile=',profile)", "device": "concat('device=',device_id)"}
_PATHS = {k: " || '/' || ".join(_PATH[x] for x in k.split("-")) for k in T.SCHEMES}
_WINDOW = f"SELECT first_date, last_date, CAST(first_date + o AS DATE) AS from_date, CAST(first_date + o + greatest(1, least(7, span - o)) AS DATE) AS to_date FROM (SELECT *, span // 4 AS o FROM (SELECT min(date) AS first_date, max(date) AS last_date, CAST(max(date) - min(date) + 1 AS INTEGER) AS span FROM p WHERE key='{KEY}'))"
_BUSY = f"{POINTS}, w AS ({_WINDOW}), b AS (SELECT tenant_id, device_id FROM p, w WHERE key='{KEY}' AND date >= from_date AND date < to_date GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1), o AS (SELECT p.* FROM p JOIN b USING (tenant_id, device_id) WHERE key='{KEY}') "
_RUN = ", r AS (SELECT *, max(ts) OVER (ORDER BY arrived, event_id ROWS UNBOUNDED PRECEDING) AS wm, lag(ts) OVER (ORDER BY arrived, event_id) AS prev_ts FROM p) "
_KEYS = "tenant_id, device_id, key, ts"
_KIND = "CASE WHEN bool_v IS NOT NULL THEN 'BOOL' WHEN long_v IS NOT NULL THEN 'LONG' WHEN dbl_v IS NOT NULL THEN 'DOUBLE' WHEN str_v IS NOT NULL THEN 'STRING' WHEN json_v IS NOT NULL THEN 'JSON' END"
_Q1 = f"{_BUSY} SELECT ts, value FROM o, w WHERE date >= from_date AND date < to_date"
_Q1_COLD = f"{_BUSY} SELECT date_trunc('second', ts) AS ts, value FROM o, w WHERE date >= from_date AND date < to_date"
_Q2 = f"{_BUSY} SELECT date, round(avg(value),6) AS avg_value, count(*) AS n FROM o GROUP BY date"
_Q3 = f"{POINTS} SELECT round(avg(value),6) AS avg_value, count(*) AS n FROM p WHERE key='{KEY}' AND profile='industrial-sensor'"
_MONTH = "epoch_ms(CAST(date_trunc('month', ts) AS TIMESTAMP))"
_NAMES = ", ".join("(" + ("NULL" if n is None else "'" + n.replace("\n", "' || chr(10) || '") + "'") + ")" for n in NAMES)
_JSON = "'{\"tenantId\":\"' || tenant_id || '\",\"profile\":\"' || profile || '\",\"deviceId\":\"' || device_id || '\",\"key\":\"' || key || '\",\"ts\":' || CAST(epoch_ms(ts) AS VARCHAR) || ',\"type\":\"' || kind || '\",\"value\":' || v || '}'"
_TEXT = "coalesce(CAST(bool_v AS VARCHAR), CAST(long_v AS VARCHAR), CAST(CAST(round(dbl_v) AS BIGINT) AS VARCHAR), str_v, json_v)"
ORACLE: dict[str, str] = {
    "series_device_range": _Q1,
    "q1_cold": _Q1_COLD,
    "manifest_pruned_q1": _Q1_COLD,
    **{k: _Q2 for k in ("daily_avg_device", "q2_cold", "manifest_full_q2", "manifest_pruned_q2")},
    "profile_avg": _Q3,
    "q3_cold": _Q3,
    "manifest_listing": f"{POINTS} SELECT DISTINCT tenant_id AS tenant, date, key, 1 AS files FROM p WHERE key='{KEY}'",
    "footer_rows": f"{POINTS} SELECT tenant_id AS tenant, date, count(*) AS n_rows FROM p WHERE key='{KEY}' GROUP BY 1, 2",
    "date_window": f"{POINTS} {_WINDOW}",
    "partition_fanout": f"{POINTS} SELECT {', '.join(f'count(DISTINCT {v}) AS {k.replace('-', '_')}' for k, v in _PATHS.items())} FROM p",
    "key_validation": f"{POINTS}, n AS (SELECT DISTINCT concat(key, CASE WHEN event_id % 3 = 0 THEN '/x' ELSE '_1' END) AS name FROM p UNION ALL SELECT * FROM (VALUES {_NAMES})) SELECT name, coalesce(regexp_full_match(name, '[A-Za-z0-9._-]{{1,128}}') AND name NOT IN ('.', '..'), false) AS valid FROM n",
    "layout_sparse": f"{POINTS} SELECT event_id, tenant_id, profile, device_id, key, ts, bool_v, long_v, dbl_v, coalesce(str_v, json_v) AS str_v FROM p",
    "layout_stringified": f"{POINTS} SELECT event_id, tenant_id, profile, device_id, key, ts, {_KIND} AS value_type, {_TEXT} AS value_str FROM p",
    "layout_per_key": f"{POINTS} SELECT key, {_KIND} AS kind, count(*) AS n FROM p GROUP BY 1, 2",
    "hot_table": f"{POINTS} SELECT 'DEVICE' AS entity_type, device_id AS entity_id, key, {_MONTH} AS partition, epoch_us(ts) // 1000 AS ts, bool_v, str_v, long_v, dbl_v, json_v FROM p",
    "watermark_running": f"{POINTS}{_RUN} SELECT event_id, ts, wm FROM r",
    **{f"late_drop_{k}d": f"{POINTS}{_RUN} SELECT event_id, ts FROM r WHERE NOT ts < wm - INTERVAL {k} DAY" for k in (1, 7)},
    "late_counts": f"{POINTS}{_RUN} SELECT count(*) FILTER (ts < wm) AS behind, count(*) FILTER (ts < wm - INTERVAL 1 DAY) AS late_1d, count(*) FILTER (ts < wm - INTERVAL 7 DAY) AS late_7d, count(*) FILTER (ts < wm - INTERVAL 10 DAY) AS late_10d FROM r",
    "backward_steps": f"{POINTS}{_RUN} SELECT event_id, ts, prev_ts FROM r WHERE ts < prev_ts",
    "closeness_to_window": f"{POINTS} SELECT {_PATHS['tenant-date']} AS path, max(ts) AS last_ts, max(ts) < (SELECT max(ts) FROM p) - INTERVAL 7 DAY AS closed FROM p GROUP BY 1",
    "month_partition": f"{POINTS} SELECT {_MONTH} AS partition, tenant_id, count(*) AS n FROM p GROUP BY 1, 2",
    "hot_cold_merge": f"{POINTS}, c AS (SELECT {_KEYS}, max(value) AS value FROM p WHERE ts < TIMESTAMP '2024-01-21' GROUP BY {_KEYS}), h AS (SELECT {_KEYS}, max(value)+1 AS value FROM p WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY {_KEYS}) SELECT * FROM h UNION ALL SELECT c.* FROM c ANTI JOIN h USING ({_KEYS})",
    "boundary_half_open": f"{POINTS} SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'",
    "reconcile_counts": f"{POINTS} SELECT tenant_id, date, count(*) AS n_source, count(*) FILTER (event_id % 7 <> 0) AS n_archive, count(*) FILTER (event_id % 7 = 0) AS missing FROM p GROUP BY 1, 2",
    "reconcile_footers": f"{POINTS} SELECT tenant_id AS tenant, CAST(date AS VARCHAR) AS date, count(*) AS n_source, count(*) AS n_archive, 0 AS missing FROM p WHERE key='{KEY}' GROUP BY 1, 2",
    "percentile_nearest_rank": f"{POINTS} SELECT tenant_id, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM p WHERE key='{KEY}' GROUP BY tenant_id",
    "topk_largest_partitions": f"{POINTS} SELECT {_PATHS['tenant-date']} AS path, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, path LIMIT 10",
    "kind_stability": f"{POINTS} SELECT key, count(DISTINCT {_KIND}) AS kinds FROM p GROUP BY key",
    "ndjson_bytes": f"{POINTS}, k AS (SELECT *, {_KIND} AS kind, coalesce(CAST(bool_v AS VARCHAR), CAST(long_v AS VARCHAR), '\"' || str_v || '\"', json_v) AS v FROM p WHERE dbl_v IS NULL) SELECT count(*) AS n_rows, CAST(sum(octet_length(encode({_JSON}))) + count(*) - 1 AS BIGINT) AS n_bytes FROM k",
}
ORACLE |= {f"scheme_paths_{k.replace('-', '_')}": f"{POINTS} SELECT {v} AS path, count(*) AS n FROM p GROUP BY 1" for k, v in _PATHS.items()}
