"""Compaction: the smallest log with the same visible state for all readers at or above a watermark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.resolve import TOMBSTONE, Bounds


@dataclass(frozen=True)
class PrefixFilter:
    """Versions of keys with the prefix, up to the cutoff, may go."""

    id: int
    prefix: bytes | str
    cutoff_ts: int

    def matches(self) -> Column:
        return (F.col("ts") <= self.cutoff_ts) & Bounds.of_prefix(self.prefix).holds(F.col("k"))


def matches_any(filters: list[PrefixFilter]) -> Column:
    out = F.lit(False)
    for f in filters:
        out = out | f.matches()
    return out


def retained(log: DataFrame, watermark: int) -> DataFrame:
    """Versions above the watermark, and each key's newest at or below it.

    Only the newest timestamp of each key is shuffled twice, as a window over the key would sort
    whole rows; a key with many versions is combined before the shuffle.
    """
    below = F.when(F.col("ts") <= watermark, F.struct("ts", "seq"))
    top = log.groupBy("k").agg(F.max(below).alias("__top"))
    out = log.join(top, "k").where((F.col("ts") > watermark) | (F.struct("ts", "seq") == F.col("__top")))
    return out.drop("__top")


def compact(
    log: DataFrame,
    rt: DataFrame | None,
    watermark: int,
    bottom: bool = True,
    idle: bool = True,
    now: int | None = None,
    filters: list[PrefixFilter] | None = None,
) -> DataFrame:
    """The log that a compaction writes.

    Versions above the watermark stay, older ones go but for each key's newest. That one goes at the
    bottom if it is a tombstone or a range tombstone at or below the watermark covers it; with no
    readers also if a filter matches it or it has expired.
    """
    kept = retained(log, watermark)
    if not bottom:
        return kept
    old = F.col("ts") <= watermark
    drop = old & (F.col("kind") == TOMBSTONE)
    if idle:
        plain = F.col("kind") != TOMBSTONE
        if filters:
            drop = drop | (plain & matches_any(filters))
        if now is not None:
            drop = drop | (plain & F.coalesce(F.col("expire_at") <= now, F.lit(False)))
    kept = kept.where(~drop)
    if rt is not None:
        from palimpsest.operators.resolve import uncovered

        kept = kept.where(~old).unionByName(uncovered(kept.where(old), rt, watermark))
    return kept


def digest(log: DataFrame) -> DataFrame:
    """(n, sum): a multiset digest that does not depend on order: input = output + drops."""
    h = F.xxhash64("k", "ts", "kind", F.col("v").cast("string")).cast("decimal(38,0)")
    return log.agg(F.count("*").alias("n"), F.sum(h).alias("sum"))


def filter_stats(log: DataFrame, filters: list[PrefixFilter]) -> DataFrame:
    """(eligible, dropped_bytes): what filters would drop of a log."""
    hit = log.where((F.col("kind") != TOMBSTONE) & matches_any(filters))
    size = F.octet_length("k") + F.coalesce(F.octet_length(F.col("v").cast("string")), F.lit(0))
    return hit.agg(F.count("*").alias("eligible"), F.coalesce(F.sum(size), F.lit(0)).alias("dropped_bytes"))
