"""Connected components, and links among bucket members without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch

#: In a bucket of up to so many nodes all pairs are compared.
FEW = 8


def star_step(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """One large-star and one small-star step on edges (a, b), a > b: the same components, nearer to stars.

    Each is an aggregation that combines before the shuffle and one join, so a hub costs a join that
    can be split, never one task's list.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # large star: a node's larger neighbours move to its smallest neighbour
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = scratch.keep(large.where("a <> b").distinct(), "large")
    # small star: a node's smaller neighbours, itself too, move to the smallest of them
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    after = scratch.keep(small.where("a <> b").distinct(), "small")
    scratch.drop(large)
    return after


def downward(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any order, loops and repeats among them, as a > b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def labels(edges: DataFrame) -> DataFrame:
    """(node, component): the lowest neighbour below each node that has one. Of the same label only if connected."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def converge(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Star steps on edges (a, b), a > b, until they stay the same: each node to the smallest of its component."""
    seen = None
    while True:
        edges = star_step(edges, scratch)
        now = edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges
        seen = now


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of an undirected graph: (node, component), component the smallest node.

    Edges: (a, b), longs. Loops and repeats are harmless.
    """
    edges = converge(scratch.keep(downward(edges).distinct(), "edges"), scratch)
    return labels(edges).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def often(members: DataFrame) -> DataFrame:
    """Rows of buckets that have several rows, or share a short hash with such: what a narrow count can tell."""
    seen = members.groupBy(F.hash("bucket").alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    return members.withColumn("h", F.hash("bucket")).join(seen.select("h"), "h").drop("h")


def link_buckets(
    deal: Callable[[int, DataFrame | None, DataFrame | None], DataFrame],
    nodes: DataFrame,
    may_link: Callable[[str, str], str],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    scratch: Scratch,
    rounds: int = 2,
    few: int = FEW,
    centres: int = 1,
    last: Callable[[DataFrame], DataFrame] | None = None,
    sift: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of the nodes that verified links join: (node, component) for linked nodes.

    deal: for a round, the components so far (None at first) and the open rows of the round before
    (bucket, node, c), the rows (bucket, node, c) with c the node's component, itself if it has none;
    rows may repeat. Only nodes that share a bucket of the last round can be linked; earlier rounds
    may deal fewer buckets.
    nodes: (node, rank, x), x a struct of what may_link looks at.
    may_link: the SQL condition on two such structs that a pair meets to be a candidate at all; it
    is part of the join, so other pairs are never made.
    verify: takes distinct pairs (a, b) and the open rows of the round, whose nodes hold those of all
    later rounds that deal the same buckets, and returns the pairs that are links.
    sift: takes some buckets (bucket) of the first round and returns its rows that are in them, or few
    more; all rounds deal the same buckets then. So the many rows of other buckets are counted, but
    never sorted or moved as rows.

    A bucket whose nodes are all in one component needs no pairs: they cannot change the result. Of
    the others, those with up to `few` nodes compare all of these, a bounded number for a row; in a
    larger one the first round compares the lowest-ranked node with the others, later rounds about
    `centres` nodes, so that a round makes a bounded number for a row. Larger buckets that hold
    several components after all rounds go to `last`, which gets their rows (bucket, node, x, c) and
    returns candidates (a, b) without all pairs of a bucket; without it, nodes of different
    components in a bucket are compared under may_link. So no link is lost.
    """
    edges = component = rest = None
    for step in range(rounds + 1):
        before = rest
        if step < rounds:
            state = deal(step, component, rest)
            if sift is None:
                state = scratch.keep(often(state), "dealt")
            open_ = state.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket")
            if sift is not None and not step:
                open_ = scratch.keep(open_, "several")
                state = sift(open_)
            # rows of open buckets are few beside all rows: only these meet what the condition looks at
            rest = scratch.keep(state.join(open_, "bucket").distinct(), "open")
            if sift is None:
                scratch.drop(state)
        else:
            if edges is not None:
                edges = converge(edges, scratch)
                component = scratch.keep(labels(edges), "labels")
                rest = rest.drop("c").join(component, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
            open_ = rest.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where(f"low <> high and n > {few}")
            rest = scratch.keep(rest.select("bucket", "node", "c").join(open_.select("bucket"), "bucket"), "open")
        if before is not None:
            scratch.drop(before)
        if rest.isEmpty():
            if step < rounds - 1:
                continue  # the next round deals other buckets
            break
        full = None
        if step == rounds and last is not None:
            pairs = last(rest.join(nodes, "node").select("bucket", "node", "x", "c"))
        else:
            full = members = scratch.keep(rest.join(nodes, "node").select("bucket", "node", "rank", "x", "c"), "members")
            # the centre: the lowest rank at first, later the lowest by a hash of the round, and others by it
            rank = F.col("rank") if not step else F.xxhash64("node", F.lit(step))
            by = full.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("rank"), "node")).alias("top"))
            centre = F.lit(True)
            if step < rounds:
                centre = (F.col("n") <= few) | (F.col("node") == F.col("top.node"))
                if step:
                    centre |= F.pmod(rank, F.col("n")) < centres - 1
            full = full.join(by, "bucket").withColumn("centre", centre)
            once = "true"
            if step == rounds:
                # a pair comes up in the first only of the buckets that it shares, and in none if one of the
                # two has been a centre by its hash of such a bucket, which still has the same members
                was = F.lit(False)
                for k in range(1, rounds):
                    was |= F.pmod(F.xxhash64("node", F.lit(k)), F.col("n")) < centres - 1
                own = full.groupBy("node").agg(F.collect_set("bucket").alias("own"), F.collect_set(F.when(was, F.col("bucket"))).alias("led"))
                full = full.join(own, "node")
                once = "array_min(array_intersect(own, other)) = bucket and not arrays_overlap(led, other) and not arrays_overlap(own, led_too)"
            else:
                full = full.withColumn("own", F.lit(None).cast("array<bigint>")).withColumn("led", F.col("own"))
            full = full.select("bucket", "node", "x", "c", "centre", "own", "led")
            partner = full.where("centre").drop("centre").toDF("bucket", "b", "y", "d", "other", "led_too")
            # two centres meet once
            met = full.join(partner, "bucket").where(f"if(centre, c < d, c <> d) and {may_link('x', 'y')} and {once}")
            pairs = met.select(F.col("node").alias("a"), "b")
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = scratch.keep(pairs, "pairs")
        if full is not None:
            scratch.drop(members)
        if pairs.isEmpty():
            continue  # no centre has a new candidate; other members of a bucket may still have some
        found = downward(verify(pairs, rest)).distinct()
        links = scratch.keep(found if edges is None else edges.unionByName(found), "links")
        scratch.drop(pairs)
        edges = star_step(links, scratch)
        scratch.drop(links)
        # not the whole components yet, but the same label only within one
        component = scratch.keep(labels(edges), "labels")
    if edges is None:
        return nodes.select("node", F.col("node").alias("component")).limit(0)
    return scratch.keep(connected(edges, scratch), "component")
