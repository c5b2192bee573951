"""Write side, manifest, policies, generator: properties that no SQL states."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sensors as S
from tidemark.functions import telemetry as T
from tidemark.operators import tiering
from tidemark.plans import harness
from tidemark.sources import cold, generator, manifest
from tidemark.streaming import archiver, policy, watermark

POINT = "tenant_id string, profile string, device_id string, key string, ts timestamp_ntz, bool_v boolean, long_v bigint, dbl_v double, str_v string, json_v string, event_id bigint, arrived timestamp_ntz"


def made(spark, rows):
    """rows: (device, key, seconds after 2026-01-01, value)"""
    names = {bool: "bool_v", int: "long_v", float: "dbl_v", str: "str_v"}
    out = []
    for n, (device, key, s, v) in enumerate(rows):
        out.append({"tenant_id": "t0", "profile": "industrial-sensor", "device_id": device, "key": key, "s": s, names[type(v)]: v, "event_id": n})
    fields = "tenant_id string, profile string, device_id string, key string, s bigint, bool_v boolean, long_v bigint, dbl_v double, str_v string, json_v string, event_id bigint"
    df = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in fields.split(", ")) for r in out], fields)
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1767225600).cast("timestamp_ntz")).withColumn("date", F.col("ts").cast("date")).withColumn("arrived", F.timestamp_seconds("event_id").cast("timestamp_ntz"))


def test_tree_and_restart(spark, tmp_path):
    df = made(spark, [("d", "temperature", 0, 1.5), ("d", "temperature", 3600, 2.5), ("d", "running", 0, True)])
    root = str(tmp_path / "tree")
    cold.write_all(df, root, scheme="date-hour")
    files = manifest.listed(spark, root)
    assert manifest.totals(files).first().directories == 3 and {r.key for r in files.collect()} == {"temperature", "running"}
    cold.write_all(df, root, scheme="date-hour")
    assert manifest.totals(manifest.listed(spark, root)).first().files == 6
    assert manifest.row_count(manifest.footers(manifest.listed(spark, root))).first().n_rows == 6
    with pytest.raises(LookupError):
        manifest.paths(manifest.pruned(files, start="2030-01-01"))


def test_rejects(spark, tmp_path):
    for key in ("../../escaped", "sensor/temp", "a=b", "", None):
        root = tmp_path / f"r{abs(hash(key))}"
        with pytest.raises(Exception, match="cannot be a path"):
            cold.write(made(spark, [("d", key, 0, 1.0)]), str(root))
        assert not list(root.glob("**/*.parquet"))
    mixed = made(spark, [("d", "temperature", 0, 1.0), ("d", "temperature", 1, 2)])
    with pytest.raises(cold.Rejected, match="temperature"):
        cold.write(mixed, str(tmp_path / "mixed"))
    with pytest.raises(ValueError, match="LZO"):
        cold.write(mixed, str(tmp_path / "x"), codec="LZO", layout="SPARSE_TYPED")
    good, bad = cold.quarantined(made(spark, [("d", "ok", 0, 1.0), ("d", "a/b", 0, 1.0)]))
    assert good.count() == 1 and [(r.key, r.bad_key) for r in bad.collect()] == [(cold.QUARANTINE, "a/b")]


def test_layouts_and_codecs(spark, tmp_path):
    df = made(spark, [(f"d{k % 5}", "temperature", k, k * 0.37) for k in range(5000)])
    out = {(r.layout, r.codec): r for r in harness.layout_matrix(df, str(tmp_path), tuple(cold.CODECS)).collect()}
    assert len(out) == 12 and all(r.n_rows == 5000 for r in out.values())
    path = str(tmp_path / "SPARSE_TYPED-ZSTD")
    assert "key" in spark.read.parquet(path).columns
    with pytest.raises(Exception, match="(?i)exists"):
        cold.write_single(df, path, "SPARSE_TYPED")
    import pyarrow.parquet as pq

    assert pq.ParquetFile(next((tmp_path / "PER_KEY_TYPED-GZIP").glob("key=*/*.parquet"))).schema_arrow.names == ["tenant_id", "profile", "device_id", "ts", "value"]
    best = harness.smallest(spark.createDataFrame(list(out.values()))).first()
    assert best.bytes == min(r.bytes for r in out.values())


def test_rolling_and_pruning(spark, tmp_path):
    rows = [(f"d{k % 20:02d}", "temperature", 60 * (k // 20), 20 + k % 100 * 0.01) for k in range(20 * 1400)]
    df = made(spark, rows)
    root = str(tmp_path / "sorted")
    cold.write(df, root, scheme="tenant-date", row_group=64 << 10)
    groups = manifest.footers(manifest.listed(spark, root))
    assert manifest.row_count(groups).first().n_rows == 28_000
    report = manifest.pruning_report(groups, "device_id", "d00").first()
    assert report.groups > report.files and 0 < report.hit < report.groups and report.skipped_pct > 0 and not report.too_few_groups
    one = str(tmp_path / "one")
    cold.write(df.where("s < 86400"), one, row_group=32 << 20)
    assert manifest.ranges(manifest.footers(manifest.listed(spark, one)), "device_id").count() == 1
    unknown = manifest.ranges(groups, "nowhere")
    assert unknown.where(manifest.may_hold("x")).count() == unknown.count()
    rolled = str(tmp_path / "rolled")
    cold.write(df, rolled, file_rows=5000)
    assert manifest.listed(spark, rolled).count() > manifest.listed(spark, root).count()
    stats = {r.column: r for r in manifest.column_stats(groups).collect()}
    assert stats["ts"].ratio > 1 and any("DELTA" in e for e in stats["ts"].encodings)
    to = str(tmp_path / "compact")
    tiering.compact(spark, rolled, to)
    assert cold.scan(spark, to).exceptAll(cold.scan(spark, rolled)).count() == 0 and manifest.listed(spark, to).count() == manifest.listed(spark, root).count()
    scanned = cold.scan(spark, root).where("date = date'2026-01-01' and key = 'temperature'")
    assert manifest.scan_stats(scanned)["numFiles"] == 1
    assert manifest.column_probe(spark, {"a": root}, "temperature").count() == 5


def test_footer_errors():
    for data in (b"PAR1", b"x" * 20, b"PAR1" + b"\xff\xff\xff\x00PAR1"):
        with pytest.raises(ValueError):
            manifest.footer_bytes(data)


def days(spark, n, late=False):
    rows = [("d", "temperature", 86400 * k + s, 1.0) for k in range(n) for s in range(10_000)]
    return made(spark, rows + ([("d", "temperature", 30, 1.0)] if late else []))


def test_policies(spark):
    hour = timedelta(hours=1)
    run = lambda df, rule, **kw: policy.simulate(df, T.path("date"), rule, **kw).first()
    r = run(days(spark, 5, True), policy.LRU)
    assert (r.watermark_closes, r.reopens, r.dropped) == (0, 0, 0)
    r = run(days(spark, 5), policy.ClosePolicy.close(hour))
    assert r.watermark_closes > 0 and r.partitions == 5 and r.n_rows == 50_000
    r = run(days(spark, 3, True), policy.ClosePolicy.close(hour))
    assert r.partitions == 3 and r.reopens > 0 and r.n_rows == 30_001 and r.dropped == 0
    r = run(days(spark, 3, True), policy.ClosePolicy.dropping(hour))
    assert (r.dropped, r.n_rows, r.reopens) == (1, 30_000, 0)
    r = run(made(spark, [("d", "t", 86400 * k, 1.0) for k in range(4)]), policy.ClosePolicy.dropping(timedelta(minutes=1)))
    assert (r.dropped, r.n_rows) == (0, 4)
    turns = made(spark, [(f"d{d}", "t", n, 1.0) for n in range(3) for d in range(3)])
    r = policy.simulate(turns, T.path("tenant-device-date"), policy.LRU, max_open=2).first()
    assert (r.n_rows, r.partitions, r.rollovers, r.max_open) == (9, 3, 0, 2) and r.evictions > 0 and r.reopens > 0
    r = policy.simulate(turns, T.path("date"), policy.LRU, file_rows=4).first()
    assert (r.files, r.rollovers, r.reopens) == (3, 2, 0)
    assert policy.simulate(turns, T.path("date"), writer=F.col("device_id")).count() == 3
    assert policy.simulate(turns.where("false"), T.path("date")).count() == 0
    for bad in (lambda: policy.ClosePolicy("x", None, True), lambda: policy.ClosePolicy("x", timedelta(0))):
        with pytest.raises(ValueError):
            bad()
    assert policy.DEFAULT.name == "watermark-close(7d)" and policy.ClosePolicy.dropping(hour).name == "watermark-drop(1h)"


@pytest.mark.parametrize("rule,most,sweep,files,open_,dropped", [
    (policy.LRU, 16, 256, 10_460, 16, 0),
    (policy.LRU, 512, 256, 450, 450, 0),
    (policy.ClosePolicy.close(timedelta(days=10)), 512, 256, 450, 180, 0),
    (policy.ClosePolicy.close(timedelta(days=1)), 512, 256, 4_301, 125, 0),
    (policy.ClosePolicy.close(timedelta(days=1)), 512, 8192, 1_644, 185, 0),
    (policy.ClosePolicy.dropping(timedelta(days=1)), 512, 256, 450, 45, 4_348),
])
def test_policy_table(spark, rule, most, sweep, files, open_, dropped):
    points = T.points(T.events(spark, "/root/testdata/sf0.1"))
    r = policy.simulate(points, F.concat(T.path("tenant-date"), F.lit("/"), F.col("key")), rule, most, sweep).first()
    assert (r.files, r.max_open, r.dropped) == (files, open_, dropped)


def test_watermark_without_arrival(spark):
    df = made(spark, [("d", "t", 5, 1.0), ("d", "t", 3, 1.0)]).withColumn("arrived", F.when(F.col("event_id") == 0, F.col("arrived")))
    assert {r.event_id: r.wm is None for r in watermark.running(df).collect()} == {0: False, 1: True}


def test_late_arrival(spark):
    config = generator.Config(2, 3, 60_000)
    df = generator.generate(spark, 30_000, config)
    plain = df.collect()
    assert [r.seq for r in generator.in_arrival_order(generator.late_arrival(df, 0)).collect()] == list(range(30_000))
    for ratio in (0.01, 0.2):
        late = generator.late_arrival(df, ratio)
        assert late.drop("arrival_tick", "late").exceptAll(df).count() == 0 and late.count() == len(plain)
        first, again = (generator.in_arrival_order(generator.late_arrival(df, ratio)).select("seq", "ts_ms").collect() for _ in range(2))
        assert first == again and any(b.ts_ms < a.ts_ms for a, b in zip(first, first[1:]))
        share = late.where("late").count() / len(plain)
        assert abs(share - ratio) < 0.02
    draws = spark.range(100_000).select(generator.delay(F.col("id"), 7, 0.5, 5, 12).alias("d")).where("d > 0").agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    assert (draws.a, draws.b) == (1, 12)
    assert config.count(days=1) == 1440 * 30 and plain[0].tenant_id == "00000000-007e-4a47-0000-000000000000"
    assert plain[0].device_id == "00000000-00de-71ce-0000-000000000000"


def test_sensors(spark):
    ts, seed = F.lit(1767225600000) + F.col("id") * 10_000, F.lit(42).cast("long")
    rows = spark.range(10_000).select(S.temperature(ts, seed).alias("t"), S.humidity(ts, seed).alias("h"), S.power_wh(ts, seed).alias("p"), S.running(ts, seed).alias("r"), S.error_code(ts, seed).alias("e")).collect()
    assert max(abs(b.t - a.t) for a, b in zip(rows, rows[1:])) < 1.0
    assert sum(a.r != b.r for a, b in zip(rows, rows[1:])) < 20
    assert all(20 <= r.h <= 95 and r.p > 0 for r in rows) and sum(r.e == "OK" for r in rows) > 9000
    # splitmix64 of 0 and 1, from its published stream of seed 0
    import numpy as np

    assert int(S.mix(np.zeros(1, np.uint64))[0]) == 0xE220A8397B1DCDAF


def test_ndjson(spark, tmp_path):
    df = generator.generate(spark, 3000, generator.Config(2, 3))
    size = generator.ndjson_bytes(df).first()
    generator.ndjson(df).coalesce(1).write.text(str(tmp_path / "n"))
    data = next((tmp_path / "n").glob("part-*")).read_bytes()
    assert size.n_bytes == len(data) - 1
    first = json.loads(data.split(b"\n")[0])
    assert list(first) == ["tenantId", "profile", "deviceId", "key", "ts", "type", "value"]
    assert generator.ndjson_bytes(df.where("false")).first().n_bytes == 0


def test_archiver(spark, tmp_path):
    df = made(spark, [("d", "temperature", k, float(k)) for k in range(50)] + [("d", "a/b", 1, 1.0), ("d", "running", 1, True)])
    df.write.parquet(str(tmp_path / "in"))
    how = dict(quarantine=str(tmp_path / "bad"))
    stream = archiver.source(spark, str(tmp_path / "in"), df.schema)
    archiver.archive(stream, str(tmp_path / "tree"), str(tmp_path / "ck"), **how).awaitTermination(120)
    assert cold.scan(spark, str(tmp_path / "tree")).where("key = 'temperature'").count() == 50
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    archiver.archive(stream, str(tmp_path / "tree"), str(tmp_path / "ck"), **how).awaitTermination(120)
    tree = cold.scan(spark, str(tmp_path / "tree")).where("key = 'temperature'")
    assert tree.count() == 50
    assert archiver.deduplicated(tree.union(tree), ("tenant", "device_id", "key", "ts")).count() == 50
    source = df.where("dbl_v is not null and key = 'temperature'").select(F.col("tenant_id").alias("tenant"), F.col("date").cast("string").alias("date"))
    check = tiering.reconcile_footers(spark, source, str(tmp_path / "tree"), ["tenant", "date"]).collect()
    assert sum(r.n_source for r in check) == 50
    drop = archiver.LateDrop(1)
    assert drop(made(spark, [("d", "t", 5 * 86400, 1.0)])).count() == 1
    assert drop(made(spark, [("d", "t", 0, 1.0), ("d", "t", 5 * 86400 - 10, 1.0)])).count() == 1


def test_harness(spark):
    args = harness.Args.parse(["--count=10_000", "--tenants=2", "--interval-seconds=60"])
    assert args.count() == 10_000 and args.config().interval_ms == 60_000 and harness.Args.parse(["--days=1", "--count=5"]).count() == 8640 * 3000
    for bad in ("count=1", "--count"):
        with pytest.raises(ValueError):
            harness.Args.parse([bad])
    assert harness.Store("b", part=5 << 20, threshold=5 << 20).parts(12 << 20) == 3 and harness.Store("b").parts(8 << 20) == 1
    for kw in ({"bucket": " "}, {"bucket": "b", "part": 1}, {"bucket": "b", "threshold": 1}):
        with pytest.raises(ValueError):
            harness.Store(**kw)
    assert harness.nearest_rank([1, 2, 3, 4], 0.5) == 2 and harness.nearest_rank([1, 2, 3, 4], 0.95) == 4
    assert harness.latency(lambda: spark.range(3), 0, 2)["rows"] == 3
    with pytest.raises(LookupError):
        harness.latency(lambda: spark.range(0), 0, 1)
    up = spark.createDataFrame([(f"k{i}", 1 << 20, 10 * i) for i in range(15)], "key string, bytes long, elapsed_ms long")
    assert [r.key for r in harness.slowest(up).collect()][:2] == ["k14", "k13"]
    assert cold.shape(["tenant", "tenant_id", "device_id"]) == {"tenant": "tenant", "device": "device_id", "date": None}
