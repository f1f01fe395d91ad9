"""Contiguous shards of ordered atomic groups, the largest shard as small as can be.

Equal texts are one group, in the order of the groups' smallest ids; a group's end is the sum of
sizes up to and with it. For a capacity c, filling shards greedily from the front needs the fewest
shards; the smallest c that needs no more than asked for is found by a search that tries many
capacities at a time: each round walks all of them shard by shard, and a step of the walk is one
aggregation, the last group end within reach of each capacity, over the column of ends. After the
first round only ends within reach of a feasible cut are read, and rounds are few: each narrows
the range of capacities by WAYS.

Group ends are sums in two levels: ranges of ids, then groups within a range. DataFrame functions
only; what reaches the driver is WAYS numbers a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import Scratch, bucket_of, cut_points

WAYS = 64
#: Ranges for two-level sums and ranks; more for more data (a parameter of shard()).
RANGES = 64
#: Bytes that each document counts besides its text.
EACH = 8


def _reach(ends: DataFrame, starts: list[int], capacity: list[int]) -> list[int]:
    """For each start and capacity the largest group end that is no larger than their sum."""
    goals = [s + c for s, c in zip(starts, capacity, strict=True)]
    order = sorted(set(goals))
    # an end counts for the first goal at or above it; later goals take the largest so far
    slot = bucket_of(F.col("end") - 1, order)
    low, high = min(starts), order[-1]
    rows = ends.where((F.col("end") > low) & (F.col("end") <= high)).groupBy(slot.alias("slot")).agg(F.max("end").alias("end")).collect()
    top, best, found = dict(rows), 0, {}
    for i, goal in enumerate(order):
        best = max(best, top.get(i, 0))
        found[goal] = best
    return [max(s, found[g]) for s, g in zip(starts, goals, strict=True)]


def cuts(ends: DataFrame, shards: int, total: int, largest: int) -> int:
    """The smallest capacity with which greedy filling needs no more shards than asked for."""
    low = max(largest, -(-total // shards))
    high = max(low, -(-total // shards) + largest)  # always enough: each full shard holds an even share
    while True:
        step = -(-(high - low + 1) // WAYS)
        tried = sorted({min(high, low + i * step) for i in range(WAYS)} | {high})
        at = [0] * len(tried)
        for _ in range(shards):
            at = _reach(ends, at, tried)
            if min(at) >= total:
                break
        good = next(i for i, x in enumerate(at) if x >= total)
        if good == 0 or tried[good] - tried[good - 1] == 1:
            return tried[good]
        low, high = tried[good - 1] + 1, tried[good]


def even_out(ends: DataFrame, shards: int, total: int, capacity: int) -> list[int]:
    """Ends of shards within the capacity, each as near below its even share of the whole as it can be.

    What is left must fit the shards to come, so a shard ends no earlier than filling them greedily
    from the back allows, and no later than its own start and the capacity.
    """
    least = [total]
    for _ in range(shards - 1):
        goal = least[-1] - capacity
        least.append(0 if goal <= 0 else ends.where(F.col("end") >= goal).agg(F.min("end")).first()[0])
    least.reverse()
    goals = [max(total * (j + 1) // shards, least[j]) for j in range(shards)]
    wanted = _reach(ends, [0] * shards, goals)
    out = [0]
    for end in wanted:
        out.append(end if end - out[-1] <= capacity else _reach(ends, [out[-1]], [capacity])[0])
    return out[1:]


def shard(
    documents: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES
) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text and EACH; a null text has none and is a group of its own kind.
    slot: the rank within the shard by doc_id, then by text, from 0. Null ids come first. Repeated
    rows are copies: they stay together and each has its own slot. An empty table gives no rows.
    Other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(
        documents.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(EACH)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null")).alias("key"),
        ),
        "rows",
    )
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    groups = scratch.keep(groups, "groups")
    by_first = cut_points(groups, "first", ranges)
    groups = groups.withColumn("range", bucket_of(F.col("first"), by_first))
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    within = Window.partitionBy("range").orderBy(F.col("first").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.groupBy("range").agg(F.sum("bytes").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    ends = groups.withColumn("sum", F.sum("bytes").over(within)).join(F.broadcast(base), "range").select(
        "key", (F.col("base") + F.col("sum")).alias("end")
    )
    ends = scratch.keep(ends, "ends")
    found = even_out(ends, shards, total, cuts(ends, shards, total, largest)) if total else []
    placed = ends.select("key", bucket_of(F.col("end") - 1, sorted(set(found))).alias("shard"))
    out = rows.join(placed, "key")
    # ranks in two levels: ranges of ids within a shard, then rows within a range
    by_id = cut_points(rows, "doc_id", ranges)
    out = scratch.keep(out.withColumn("range", bucket_of(F.col("doc_id"), by_id)), "placed")
    base = out.groupBy("shard", "range").agg(F.count("*").alias("n")).select(
        "shard", "range", F.coalesce(F.sum("n").over(before.partitionBy("shard")), F.lit(0)).alias("base")
    )
    order = Window.partitionBy("shard", "range").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    return out.withColumn("rank", F.row_number().over(order)).join(F.broadcast(base), ["shard", "range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
