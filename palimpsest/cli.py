"""A small command line over a store: python -m palimpsest.cli PATH."""

from __future__ import annotations

import shlex
import sys

from palimpsest.store import VersionedStore

HELP = "fill LOW HIGH | put K V | del K | delrange A B | get K | scan [A B] (both ends included) | prefix P | dump | flush | full_compaction | stats | rt_stats | quit"


def run(store: VersionedStore, line: str) -> str | None:
    """The answer to one command; None ends the session."""
    verb, *args = shlex.split(line) or [""]
    if verb in ("quit", "close"):
        store.close()
        return None
    if verb == "fill":
        low, high = map(int, args)
        rows = store.spark.range(low, high + 1).selectExpr("cast(id as string) as k", "'value' || id as v")
        return f"committed at {store.ingest(rows)}"
    if verb == "put":
        return f"committed at {store.put(*args)}"
    if verb == "del":
        return f"committed at {store.delete(*args)}"
    if verb == "delrange":
        return f"committed at {store.delete_range(*args)}"
    if verb == "get":
        value = store.get(*args)
        return "absent" if value is None else str(value)
    if verb in ("scan", "prefix"):
        view = store.prefix_scan(*args) if verb == "prefix" else store.scan(*args, upper_open=False)
        return "\n".join(f"{k}={v}" for k, v in store.rows(view))
    if verb == "dump":
        return "\n".join(str(r.asDict()) for r in store.segments().collect())
    if verb == "flush":
        return "all commits are durable"
    if verb == "full_compaction":
        store.compact()
        return "compacted"
    if verb == "stats":
        return str(store.mvcc_gc_stats().first().asDict())
    if verb == "rt_stats":
        return str(store.range_tombstone_stats())
    return HELP


def main() -> None:
    from pyspark.sql import SparkSession

    store = VersionedStore.open(SparkSession.builder.getOrCreate(), sys.argv[1])
    for line in sys.stdin:
        answer = run(store, line)
        if answer is None:
            break
        print(answer, flush=True)


if __name__ == "__main__":
    main()
