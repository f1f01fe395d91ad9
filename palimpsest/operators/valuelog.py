"""Large values apart from the log: (file_id, offset, size, k, ts, v), and what is still alive of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.keys import value_entry_size
from palimpsest.operators.resolve import INLINE, POINTER, TTL_INLINE, TTL_POINTER

PTR = "struct<file_id:bigint,offset:bigint,size:bigint>"


def separate(log: DataFrame, min_size: int = 1024, files: int = 16) -> tuple[DataFrame, DataFrame]:
    """(log with pointers, values): values of min_size bytes and more move out.

    A file is a hash range of the keys, so offsets are running sums within a file, in no global order.
    """
    size = F.octet_length("v")
    large = F.coalesce(size >= min_size, F.lit(False)) & F.col("kind").isin(INLINE, TTL_INLINE)
    moved = log.where(large).withColumn("file_id", F.pmod(F.xxhash64("k"), F.lit(files)).cast("long"))
    entry = value_entry_size("k", "v")
    before = F.sum(entry).over(Window.partitionBy("file_id").orderBy("k", "ts").rowsBetween(Window.unboundedPreceding, -1))
    values = moved.select("file_id", F.coalesce(before, F.lit(0)).alias("offset"), entry.alias("size"), "k", "ts", "v")
    ptr = F.struct("file_id", "offset", "size").cast(PTR)
    found = values.select("k", "ts", ptr.alias("__ptr"))
    out = log.join(found, ["k", "ts"], "left")
    kind = F.when(F.col("__ptr").isNull(), F.col("kind")).when(F.col("kind") == INLINE, POINTER).otherwise(TTL_POINTER)
    v = F.when(F.col("__ptr").isNull(), F.col("v"))
    return out.withColumns({"kind": kind.cast("tinyint"), "v": v, "ptr": F.col("__ptr")}).drop("__ptr"), values


def resolve_values(view: DataFrame, values: DataFrame) -> DataFrame:
    """Rows with their values: only rows with a pointer meet the value files."""
    plain = view.where(F.col("ptr").isNull())
    far = view.where(F.col("ptr").isNotNull()).drop("v")
    at = values.select(F.col("file_id").alias("__f"), F.col("offset").alias("__o"), "v")
    far = far.join(at, (F.col("ptr.file_id") == F.col("__f")) & (F.col("ptr.offset") == F.col("__o"))).select(*view.columns)
    return plain.unionByName(far)


def _pointers(log: DataFrame) -> DataFrame:
    return log.where("ptr is not null").select("k", "ts", "ptr.file_id", "ptr.offset", "ptr.size")


def alive(values: DataFrame, log: DataFrame) -> DataFrame:
    """Values whose exact version still points at them."""
    return values.join(_pointers(log), ["file_id", "offset", "size", "k", "ts"], "left_semi")


def dead(values: DataFrame, log: DataFrame) -> DataFrame:
    return values.join(_pointers(log), ["file_id", "offset", "size", "k", "ts"], "left_anti")


def stale_ratio(values: DataFrame, log: DataFrame) -> DataFrame:
    """(file_id, total_bytes, dead_bytes, ratio)."""
    headers = values.drop("v")
    gone = dead(headers, log).groupBy("file_id").agg(F.sum("size").alias("dead_bytes"))
    all_ = headers.groupBy("file_id").agg(F.sum("size").alias("total_bytes"))
    out = all_.join(gone, "file_id", "left").withColumn("dead_bytes", F.coalesce("dead_bytes", F.lit(0)))
    return out.withColumn("ratio", F.col("dead_bytes") / F.col("total_bytes"))


def collect_garbage(values: DataFrame, log: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(values to keep, ids of files rewritten): of files at or above the threshold only live values stay."""
    stale = stale_ratio(values, log).where(F.col("ratio") >= threshold).select("file_id")
    fresh = values.join(stale, "file_id", "left_anti")
    return fresh.unionByName(alive(values.join(stale, "file_id", "left_semi"), log).select(*values.columns)), stale


def orphans(values: DataFrame, log: DataFrame) -> DataFrame:
    """Ids of files that no version points into."""
    return values.select("file_id").distinct().join(_pointers(log).select("file_id").distinct(), "file_id", "left_anti")
