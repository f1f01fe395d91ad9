"""Shared plumbing: tables, scratch tables in the cluster's shared folder, range buckets."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch; texts are long, and both sides hold some batches at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to a Python worker at once, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only on a local master whose session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def named(name: str) -> Column:
    """A column by its plain name, whatever signs it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def numbered(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that no name clashes with another."""
    return df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(df.columns)])


class Scratch:
    """Parquet tables in the shared folder that cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, what: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Frees a table made by keep() that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Slots for each value asked for, and the most slots there are (a table of 16 MB).
SLOTS_EACH, MOST_SLOTS = 16, 1 << 27


def slot_table(values: DataFrame, col: str) -> tuple[Broadcast, int]:
    """Which of n slots (value mod n) are asked for, as packed bits on all executors, and n.

    A first sieve before a join on values: of bounded size whatever their number; beyond the bound it
    lets more rows pass, never fewer.
    """
    spark = values.sparkSession
    n, most = 1 << 15, min(MOST_SLOTS, SLOTS_EACH * values.count())
    while n < most:
        n *= 2
    slot = values.select((F.pmod(F.col(col), F.lit(n)) + 1).alias("slot"))
    bits = slot.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = np.zeros(n // 8, np.uint8)
    for part, own in bits.collect():  # n bits in all
        table[(part - 1) * 4096 : part * 4096] = np.frombuffer(own, np.uint8)
    return spark.sparkContext.broadcast(table), n


def asked(table: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Which of the values (int64) may have been asked for."""
    slot = values % n  # of a floor, as pmod
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def cut_points(df: DataFrame, col: str, buckets: int) -> list[int]:
    """At most buckets - 1 ascending values that deal the rows' ids out about evenly."""
    at = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(col, at, 10_000)).first()[0]
    return sorted(set(found or []))


def bucket_of(col: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below a value: range buckets in the values' order; null goes first."""
    # never a bare number, which groupBy() would take for a position
    return F.when(col.isNull(), 0).otherwise(_bisect(col, cuts, 0, len(cuts)))


def _bisect(col: Column, cuts: list[int], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(col >= F.lit(cuts[mid]), _bisect(col, cuts, mid + 1, high)).otherwise(_bisect(col, cuts, low, mid))
