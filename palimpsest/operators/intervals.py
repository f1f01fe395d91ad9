"""Range tombstones as disjoint fragments: (start, end, covering_ts), and what is asked of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _order():
    return Window.orderBy("start")



def fragment(rt: DataFrame) -> DataFrame:
    """Elementary spans with the ascending timestamps that cover them; equal neighbours are one.

    Endpoints are few: one per tombstone end, so their order is a single window; the join that
    finds what covers a span is on the spans, not on the data.
    """
    rt = rt.where("start < end")
    points = rt.select(F.col("start").alias("p")).unionByName(rt.select(F.col("end").alias("p"))).distinct()
    spans = points.select(F.col("p").alias("start"), F.lead("p").over(Window.orderBy("p")).alias("end")).where("end is not null")
    by = rt.select(F.col("start").alias("s"), F.col("end").alias("e"), "ts")
    covered = spans.join(by, (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")))
    return coalesce(covered.groupBy("start", "end").agg(F.sort_array(F.collect_set("ts")).alias("covering_ts")))


def coalesce(fragments: DataFrame) -> DataFrame:
    """Joins fragments that touch and have the same timestamps."""
    same = (F.lag("end").over(_order()) == F.col("start")) & (F.lag("covering_ts").over(_order()) == F.col("covering_ts"))
    runs = fragments.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(_order()))
    return runs.groupBy("run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("covering_ts").alias("covering_ts")
    ).drop("run")


def merge(*lists: DataFrame) -> DataFrame:
    """The fragments of several lists of fragments."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return fragment(rows.select("start", "end", F.explode("covering_ts").alias("ts")))


def truncate(fragments: DataFrame, low, high) -> DataFrame:
    """Fragments clipped to [low, high)."""
    start = F.greatest(F.col("start"), F.lit(low)) if low is not None else F.col("start")
    end = F.least(F.col("end"), F.lit(high)) if high is not None else F.col("end")
    return fragments.select(start.alias("start"), end.alias("end"), "covering_ts").where("start < end")


def collect_garbage(fragments: DataFrame, watermark: int) -> DataFrame:
    """Timestamps at or below the watermark go, and fragments that have none left."""
    kept = F.filter("covering_ts", lambda t: t > watermark)
    return fragments.withColumn("covering_ts", kept).where(F.size("covering_ts") > 0)


def gaps(ranges: DataFrame, low, high) -> DataFrame:
    """What of [low, high) no (start, end) covers."""
    reach = F.max("end").over(_order().rowsBetween(Window.unboundedPreceding, -1))
    clipped = ranges.select(
        F.greatest(F.col("start"), F.lit(low)).alias("start"), F.least(F.col("end"), F.lit(high)).alias("end")
    ).where("start < end")
    rows = clipped.unionByName(clipped.sparkSession.createDataFrame([(high, high)], clipped.schema))
    return rows.select(F.coalesce(reach, F.lit(low)).alias("g_start"), F.col("start").alias("g_end")).where("g_start < g_end").select(
        F.col("g_start").alias("start"), F.col("g_end").alias("end")
    )


def overlapping(rt: DataFrame, low, high, read_ts: int | None = None) -> DataFrame:
    """Tombstones that overlap [low, high), of any or of visible timestamps."""
    out = rt.where((F.col("start") < F.lit(high)) & (F.col("end") > F.lit(low)))
    return out if read_ts is None else out.where(F.col("ts") <= read_ts)


def newest_cover(covering_ts: Column | str, read_ts: int) -> Column:
    return F.array_max(F.filter(covering_ts, lambda t: t <= read_ts))


def cover(rows: DataFrame, fragments: DataFrame, read_ts: int | None = None) -> DataFrame:
    """Adds cover_ts, the newest timestamp over each row's key, or null: an as-of join on k.

    Fragments are disjoint, so the one that may hold a key is the last to start at or before it.
    Rows and fragments are sorted together within sampled key ranges; a fragment is dealt to each
    range that it reaches into.
    """
    from palimpsest.operators.resolve import bucket, key_cuts

    ts = F.array_max("covering_ts") if read_ts is None else newest_cover("covering_ts", read_ts)
    pieces = fragments.select("start", "end", ts.alias("cover")).where("cover is not null")
    cuts = key_cuts(rows, 64)
    reach = F.sequence(bucket(F.col("start"), cuts), bucket(F.col("end"), cuts))
    pieces = pieces.withColumn("__b", F.explode(reach))
    columns = rows.columns
    left = rows.select("*", bucket(F.col("k"), cuts).alias("__b"), F.col("k").alias("__p"), F.lit(1).alias("__row"))
    right = pieces.select("__b", F.col("start").alias("__p"), F.lit(0).alias("__row"), F.struct("end", "cover").alias("__f"))
    both = left.unionByName(right, allowMissingColumns=True)
    last = F.last("__f", ignorenulls=True).over(Window.partitionBy("__b").orderBy("__p", "__row"))
    out = both.withColumn("__last", last).where("__row = 1")
    return out.select(*columns, F.when(F.col("k") < F.col("__last.end"), F.col("__last.cover")).alias("cover_ts"))
