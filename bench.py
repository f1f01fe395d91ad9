"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Bulk forms of the usual key-value workloads: ordered scan, counts, pages, batch lookups, seeks,
ingest and full compaction. Each runs once to warm up and three times for the median.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from statistics import median


def main() -> None:
    from pyspark.sql import SparkSession

    from palimpsest.operators import compaction
    from palimpsest.operators import resolve as R
    from palimpsest.plans import queries as Q
    from palimpsest.store import VersionedStore

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()

    keyed = Q.table(spark, sf_dir, "lineitem").selectExpr(
        "lpad(cast(l_orderkey as string), 10, '0') || '/' || l_linenumber as k", "l_extendedprice as v"
    )
    many = keyed.selectExpr("k", "cast(v as string) as v")
    store = VersionedStore.open(spark, f"{scratch}/store")
    store.ingest(many)
    log = spark.read.parquet(*[f"{scratch}/store/{s.path}" for s in store.manifest().segments])
    view = log.where("kind <> 2").select("k", "v")
    asked = Q.table(spark, sf_dir, "orders").where("o_orderkey % 15 = 0").selectExpr("o_orderkey as ord", "lpad(cast(o_orderkey as string), 10, '0') || '/1' as k")
    runs = {
        "scan_full": lambda: noop(R.scan(log, None, R.ALL, 9)),
        "scan_prefix": lambda: noop(R.prefix_scan(log, "00000", None, 9)),
        "count": lambda: R.count(R.snapshot(log, None, 9)).collect(),
        "page_100": lambda: R.page(R.snapshot(log, None, 9).select("k", "v"), 0, 100).collect(),
        "page_100_from_5000": lambda: R.page(R.snapshot(log, None, 9).select("k", "v"), 5000, 100).collect(),
        "batch_get_10k": lambda: noop(R.batch_get(log, asked, None, 9)),
        "range_tombstone_scan": lambda: noop(Q.snap(spark, sf_dir, 10**9)),
        "rank_all_keys": lambda: noop(R.rank_by_key(view)),
        "compact_full": lambda: noop(compaction.compact(Q.change_log(spark, sf_dir), Q.tombstones(spark, sf_dir), 10**9, now=0)),
        "segment_stats": lambda: noop(Q.segments(spark, sf_dir)),
        "ingest": lambda: VersionedStore.open(spark, tempfile.mkdtemp(dir=scratch)).ingest(many),
    }
    rows = {"scan_full": log.count(), "batch_get_10k": asked.count(), "ingest": many.count()}
    found: dict[str, float] = {}
    for name, run in runs.items():
        run()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        found[name] = round(median(took), 4)
    rates = {f"{n}_rows_per_sec": round(c / found[n]) for n, c in rows.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    main()
