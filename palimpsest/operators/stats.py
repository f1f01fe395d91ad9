"""Statistics of segments, tombstones and separated values, each an aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.resolve import TOMBSTONE


def segment_stats(log: DataFrame, *by: str) -> DataFrame:
    """Rows, keys, timestamps, key range, tombstones, redundant versions and times to live by segment.

    Redundant versions are rows less distinct keys: counted from one row a key and segment.
    """
    keys = log.groupBy(*by, "k").agg(
        F.count("*").alias("n"),
        F.max("ts").alias("max_ts"),
        F.min("ts").alias("min_ts"),
        F.count_if(F.col("kind") == TOMBSTONE).alias("tombstones"),
        F.count("expire_at").alias("ttl_rows"),
        F.min("expire_at").alias("min_expire"),
        F.max("expire_at").alias("max_expire"),
    )
    return keys.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_keys"),
        (F.sum("n") - F.count("*")).alias("redundant"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
        F.min("k").alias("first_k"),
        F.max("k").alias("last_k"),
        F.sum("tombstones").alias("tombstones"),
        F.sum("ttl_rows").alias("ttl_rows"),
        F.min("min_expire").alias("min_expire"),
        F.max("max_expire").alias("max_expire"),
        (F.sum("ttl_rows") < F.sum("n")).alias("has_non_ttl"),
    )


def totals(stats: DataFrame, *by: str) -> DataFrame:
    """segment_stats() summed over levels, or over all."""
    return stats.groupBy(*by).agg(
        F.count("*").alias("segments"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("redundant").alias("redundant"),
        F.sum("tombstones").alias("tombstones"),
        F.max("max_ts").alias("max_ts"),
        F.bool_or(F.col("ttl_rows") > 0).alias("has_ttl"),
    )


def fragment_bytes(fragments: DataFrame) -> DataFrame:
    """(fragments, bytes): the size of tombstone metadata."""
    size = F.lit(8) + F.octet_length("start") + F.octet_length("end") + F.size("covering_ts") * 8
    return fragments.agg(F.count("*").alias("fragments"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def overlapping_segments(segments: DataFrame) -> DataFrame:
    """(a, b): pairs of segments (id, first_k, last_k) with a < b whose key ranges meet. Manifest rows, not data."""
    one = segments.select(F.col("id").alias("a"), F.col("first_k").alias("f"), F.col("last_k").alias("l"))
    two = segments.select(F.col("id").alias("b"), "first_k", "last_k")
    return one.join(two, (F.col("a") < F.col("b")) & (F.col("f") <= F.col("last_k")) & (F.col("first_k") <= F.col("l"))).select("a", "b")


def has_overlap(segments: DataFrame) -> DataFrame:
    """(overlaps): whether any segment starts before an earlier one has ended."""
    reach = F.max("last_k").over(Window.orderBy("first_k", "id").rowsBetween(Window.unboundedPreceding, -1))
    return segments.select((F.coalesce(reach >= F.col("first_k"), F.lit(False))).alias("o")).agg(F.bool_or("o").alias("overlaps"))


def percentiles(rows: DataFrame, col: str, *at: float) -> DataFrame:
    """Nearest-rank percentiles of a column, exact: p50, p95 and so on."""
    return rows.agg(*[F.expr(f"percentile_disc({q}) within group (order by {col})").alias(f"p{round(q * 100)}") for q in at])


def rate_windows(rows: DataFrame, ts: str, width: str) -> DataFrame:
    return rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def saturating_diff(after: Column, before: Column) -> Column:
    return F.greatest(after - before, F.lit(0))


def unordered_keys(rows: DataFrame, order: str) -> DataFrame:
    """(violations): rows of a scan, numbered by `order`, whose key is not above the one before."""
    prev = F.lag("k").over(Window.orderBy(order))
    return rows.select((prev >= F.col("k")).alias("bad")).agg(F.count_if(F.coalesce("bad", F.lit(False))).alias("violations"))


def watermark(readers: list[int], last_ts: int) -> int:
    """The oldest timestamp that an active reader needs, else the latest."""
    return min(readers, default=last_ts)
