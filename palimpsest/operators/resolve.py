"""Reads of a change log: the newest visible version of each key, then deletions and expiry.

A log has k, ts, seq, kind, v and expire_at (other columns are carried); range tombstones have
start, end and ts. Conditions on keys and timestamps go below the resolution, where they reach the
scan; conditions on kind, expiry and tombstones go above it, since a newest version that is
deleted or expired hides the older ones.

Resolution is one aggregation by key: a row per key and task crosses the shuffle, so a key with
many versions is no hot spot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.keys import prefix_successor

INLINE, POINTER, TOMBSTONE, TTL_INLINE, TTL_POINTER = range(5)
#: Range tombstones up to this many are broadcast as they are; more are cut into fragments.
FEW_TOMBSTONES = 1_000


@dataclass(frozen=True)
class Bounds:
    """A key range; None is unbounded."""

    lower: bytes | str | None = None
    upper: bytes | str | None = None
    lower_open: bool = False
    upper_open: bool = True

    @classmethod
    def of_prefix(cls, prefix: bytes | str) -> Bounds:
        return cls(prefix or None, prefix_successor(prefix))

    def holds(self, k: Column) -> Column:
        out = F.lit(True)
        if self.lower is not None:
            out = out & ((k > F.lit(self.lower)) if self.lower_open else (k >= F.lit(self.lower)))
        if self.upper is not None:
            out = out & ((k < F.lit(self.upper)) if self.upper_open else (k <= F.lit(self.upper)))
        return out

    def apply(self, log: DataFrame) -> DataFrame:
        return log if self.lower is None and self.upper is None else log.where(self.holds(F.col("k")))

    def meets(self, rt: DataFrame) -> DataFrame:
        """The tombstones that overlap the range."""
        if self.upper is not None:
            rt = rt.where(F.col("start") < F.lit(self.upper) if self.upper_open else F.col("start") <= F.lit(self.upper))
        return rt if self.lower is None else rt.where(F.col("end") > F.lit(self.lower))


ALL = Bounds()


def newest(log: DataFrame, read_ts: int | None = None) -> DataFrame:
    """The newest version of each key at or below a timestamp, whatever its kind."""
    if read_ts is not None:
        log = log.where(F.col("ts") <= read_ts)
    rest = [c for c in log.columns if c not in ("k", "ts", "seq")]
    order = [F.col("ts"), F.col("seq") if "seq" in log.columns else F.lit(0).alias("seq")]
    # the largest (ts, seq) of a key is one row's, so the rest of that row comes along
    top = log.groupBy("k").agg(F.max(F.struct(*order, *rest)).alias("top"))
    return top.select("k", *[F.col(f"top.{c}").alias(c) for c in log.columns if c != "k"])


def live(top: DataFrame, now: int | None = None) -> DataFrame:
    """Of newest versions those that are not deleted and, at a time, not expired."""
    out = top.where(F.col("kind") != TOMBSTONE)
    if now is not None and "expire_at" in top.columns:
        out = out.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))
    return out


def uncovered(top: DataFrame, rt: DataFrame, read_ts: int | None = None, few: int = FEW_TOMBSTONES) -> DataFrame:
    """Versions that no range tombstone at or above their timestamp covers.

    A few tombstones are broadcast and compared with each row; their number is checked. More become
    fragments, which each row meets by a bucket of the key space at most once (see intervals).
    """
    if read_ts is not None:
        rt = rt.where(F.col("ts") <= read_ts)
    rt = rt.select(F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("ts").alias("__t"))
    if rt.limit(few + 1).count() <= few:
        hit = (F.col("k") >= F.col("__s")) & (F.col("k") < F.col("__e")) & (F.col("ts") <= F.col("__t"))
        return top.join(F.broadcast(rt), hit, "left_anti")
    from palimpsest.operators.intervals import cover, fragment

    pieces = fragment(rt.select(F.col("__s").alias("start"), F.col("__e").alias("end"), F.col("__t").alias("ts")))
    covered = cover(top, pieces)
    return covered.where(F.col("cover_ts").isNull() | (F.col("ts") > F.col("cover_ts"))).select(*top.columns)


def snapshot(
    log: DataFrame, rt: DataFrame | None = None, read_ts: int | None = None, now: int | None = None, bounds: Bounds = ALL
) -> DataFrame:
    """All visible versions: one row per key, unordered."""
    out = live(newest(bounds.apply(log), read_ts), now)
    return out if rt is None else uncovered(out, bounds.meets(rt), read_ts)


def scan(log: DataFrame, rt: DataFrame | None = None, bounds: Bounds = ALL, read_ts: int | None = None, now: int | None = None) -> DataFrame:
    """Visible rows in ascending key order: a range-partitioned sort, whose partitions are the shards."""
    return snapshot(log, rt, read_ts, now, bounds).orderBy("k")


def prefix_scan(log: DataFrame, prefix: bytes | str, rt: DataFrame | None = None, read_ts: int | None = None, now: int | None = None) -> DataFrame:
    return scan(log, rt, Bounds.of_prefix(prefix), read_ts, now)


def get(log: DataFrame, key: bytes | str, rt: DataFrame | None = None, read_ts: int | None = None, now: int | None = None) -> DataFrame:
    return snapshot(log, rt, read_ts, now, Bounds(key, key, upper_open=False))


def get_exact(log: DataFrame, key: bytes | str, ts: int) -> DataFrame:
    """The stored version of a key at just this timestamp, resolved in no way."""
    return log.where((F.col("k") == F.lit(key)) & (F.col("ts") == ts))


def batch_get(
    log: DataFrame, keys: DataFrame, rt: DataFrame | None = None, read_ts: int | None = None, now: int | None = None
) -> DataFrame:
    """keys (ord, k) in their order, repeats kept, with the columns found or nulls.

    The log is cut to the keys asked for before it is resolved; the planner broadcasts the keys if
    they are small. Column `found` tells an absent key from a null value.
    """
    asked = keys.select("k").where("k is not null").distinct()
    hits = snapshot(log.join(asked, "k", "left_semi"), rt, read_ts, now).withColumn("found", F.lit(True))
    out = keys.select("ord", "k").join(hits, "k", "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False))).orderBy("ord")


def count(view: DataFrame, limit: int | None = None) -> DataFrame:
    """n: the number of rows, counted up to a limit; reads no values."""
    view = view.select("k")
    return (view if limit is None else view.limit(limit)).agg(F.count("*").alias("n"))


def page(view: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows after the first `offset` in key order: a top-k, no full sort, where there is a limit."""
    out = view.orderBy("k").offset(offset)
    return out if limit is None else out.limit(limit)


def seek(view: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """For each (seek, start) the first n rows at or above the start: all seeks in one pass.

    Starts are sorted into the key order; each row is dealt to the starts that reach it: the view is
    ranked once, so a seek is a lookup of its first rank and n rows from there.
    """
    ranked = rank_by_key(view)
    first = starts.join(ranked.select("k", "rank"), F.col("k") >= F.col("start"), "left").groupBy("seek", "start").agg(
        F.min("rank").alias("first")
    ).where("first is not null")
    rows = first.select("seek", "start", F.explode(F.sequence(F.col("first"), F.col("first") + n - 1)).alias("rank"))
    return rows.join(ranked, "rank").drop("rank")


def rank_by_key(view: DataFrame, buckets: int = 64) -> DataFrame:
    """Adds rank, from 1 in key order, by sampled key ranges: no task sorts all rows."""
    cuts = key_cuts(view, buckets)
    out = view.withColumn("__b", bucket(F.col("k"), cuts))
    sizes = out.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select(
        "__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    within = F.row_number().over(Window.partitionBy("__b").orderBy("k"))
    return out.withColumn("__r", within).join(F.broadcast(before), "__b").withColumn("rank", F.col("__before") + F.col("__r")).drop(
        "__b", "__r", "__before"
    )


def key_cuts(view: DataFrame, buckets: int) -> list:
    """At most buckets - 1 keys that cut the rows into ranges of about equal size (a sample of the keys)."""
    total = view.count()
    share = min(1.0, 100.0 * buckets / max(total, 1))
    sample = sorted(r[0] for r in view.select("k").sample(share, 7).limit(200 * buckets).collect())
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []


def bucket(k: Column, cuts: list) -> Column:
    """How many cuts are at or below a key, by halving."""

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(k >= F.lit(cuts[mid]), find(mid + 1, high)).otherwise(find(low, mid))

    return find(0, len(cuts))


def merge(*logs: DataFrame) -> DataFrame:
    """Several sources of versions as one log: recency comes from ts, never from the source."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def overlay(local: DataFrame, view: DataFrame) -> DataFrame:
    """A transaction's own writes (k, kind, v) over a snapshot (k, v, ...): own rows win, own deletions hide."""
    mine = local.select("k", F.col("kind").alias("__kind"), F.col("v").alias("__v"))
    out = view.select("k", "v").join(mine, "k", "full_outer")
    out = out.where(F.col("__kind").isNull() | (F.col("__kind") != TOMBSTONE))
    return out.select("k", F.when(F.col("__kind").isNotNull(), F.col("__v")).otherwise(F.col("v")).alias("v"))


def last_per_key(batch: DataFrame) -> DataFrame:
    """The last operation on each key of a batch (pos, k, ...)."""
    rest = [c for c in batch.columns if c not in ("k", "pos")]
    return batch.groupBy("k").agg(F.max(F.struct("pos", *rest)).alias("top")).select("k", *[f"top.{c}" for c in ["pos", *rest]])
