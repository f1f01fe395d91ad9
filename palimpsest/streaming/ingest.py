"""Streams into a store, and streams kept as latest values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.resolve import TOMBSTONE
from palimpsest.store import VersionedStore


def ingest(stream: DataFrame, store: VersionedStore, checkpoint: str, name: str, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Writes each micro-batch of (k, v[, pos, op, expire_at]) as one commit.

    A batch may be delivered again after a failure; its number is in the manifest of the commit, so
    the second delivery changes nothing. maintain() runs after each batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.ingest(batch, token=(name, number))
        store.maintain()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def latest(stream: DataFrame) -> DataFrame:
    """The newest version of each key as state, a row for each change: (k, ts, kind, v, expire_at).

    The state is an aggregation's, so it is combined before the shuffle and kept by the state store.
    Deletions stay as rows of their kind; live() drops these, and what has expired at a time.
    """
    top = stream.groupBy("k").agg(F.max(F.struct("ts", "kind", "v", "expire_at")).alias("top"))
    return top.select("k", "top.ts", "top.kind", "top.v", "top.expire_at")


def live(latest_rows: DataFrame, now: int) -> DataFrame:
    return latest_rows.where((F.col("kind") != TOMBSTONE) & (F.col("expire_at").isNull() | (F.col("expire_at") > now)))


def stop(query: StreamingQuery, seconds: int = 60) -> None:
    """Lets the batch at work end, then stops."""
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(seconds)
