"""Operators on small logs, and keys, intervals and policies against plain models."""

import random

import pytest

from palimpsest.functions import keys as K
from palimpsest.operators import compaction, intervals, stats, valuelog
from palimpsest.operators import resolve as R
from palimpsest.plans import policies as P

LOG = "k string, ts long, seq int, kind tinyint, v string, expire_at long"


def log(spark, *rows):
    return spark.createDataFrame([(*r, None) if len(r) == 5 else r for r in rows], LOG)


def rt(spark, *rows):
    return spark.createDataFrame(list(rows), "start string, end string, ts long")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("key", [b"", b"a", b"12345678", b"123456789", b"\x00\xff" * 9])
def test_key_codec(key):
    data = K.encode_key(key)
    assert K.decode_key(data) == key and K.decode_key(data[:-1]) is None and K.decode_key(data + b"\0" * 9) is None
    assert K.version_ts(K.encode_version(key, 7)) == 7 and K.encode_version(key, 8) < K.encode_version(key, 7)


def test_key_order_and_successor():
    rng = random.Random(3)
    found = [bytes(rng.choice([0, 1, 254, 255]) for _ in range(rng.randrange(20))) for _ in range(300)]
    assert sorted(found) == sorted(found, key=K.encode_key)
    assert [K.prefix_successor(p) for p in (b"", b"a", b"ab", b"a\xff", b"\xff\xff", b"a\xff\xff")] == [None, b"b", b"ac", b"b", None, b"b"]
    assert K.prefix_successor("az") == "a{" and K.prefix_successor("") is None
    assert K.expire_at(10, 0) == 10 and K.expire_at(10, 0.1) == 11 and K.expire_at(10, 1e30) == 2**63 - 1
    assert K.bloom_bits_per_key(0.01) == 10 and K.zipf_cdf(3)[-1] == pytest.approx(1) and K.splitmix64(0) == 0xE220A8397B1DCDAF


def test_resolution_rules(spark):
    rows = log(
        spark, ("a", 1, 0, 0, "1"), ("a", 3, 0, 2, None), ("b", 2, 0, 0, "b"), ("c", 4, 0, 3, "c", 10), ("c", 1, 0, 0, "old"), ("d", 5, 0, 0, "d"), ("e", 6, 0, 0, "e"), ("e", 6, 1, 0, "e2")
    )
    cut = rt(spark, ("d", "e", 5), ("b", "c", 1))
    assert got(R.snapshot(rows, cut, 9, 9), "k", "v") == [("b", "b"), ("c", "c"), ("e", "e2")]  # equal timestamps hide
    assert got(R.snapshot(rows, cut, 9, 10), "k", "v") == [("b", "b"), ("e", "e2")]  # what expired hides older versions
    assert got(R.snapshot(rows, cut, 2, 9), "k", "v") == [("a", "1"), ("b", "b"), ("c", "old")]
    assert R.snapshot(rows.limit(0), cut, 9, 9).count() == 0
    keys = spark.createDataFrame([(0, "z"), (1, "e"), (2, "e"), (3, None)], "ord int, k string")
    assert [(r.k, r.v, r.found) for r in R.batch_get(rows, keys, cut, 9, 9).collect()] == [("z", None, False), ("e", "e2", True), ("e", "e2", True), (None, None, False)]
    plan = R.scan(rows, None, R.Bounds("b", "d"))._jdf.queryExecution().optimizedPlan().toString()
    # conditions on kind stay above the resolution, those on keys go below it
    assert plan.index("kind#") < plan.index("Aggregate") < plan.rindex("Filter") and ">= b" in plan[plan.rindex("Filter") :]


@pytest.mark.parametrize("seed", range(2))
def test_fragments_equal_tombstones(spark, seed):
    rng = random.Random(seed)
    names = [f"{i:02d}" for i in range(30)]
    cuts = [(*sorted(rng.sample(names, 2)), rng.randrange(1, 20)) for _ in range(15)]
    rows = [(k, rng.randrange(1, 20), 0, 0, k) for k in names]
    pieces = sorted((r.start, r.end, list(r.covering_ts)) for r in intervals.fragment(rt(spark, *cuts)).collect())
    for (s, e, c), after in zip(pieces, [*pieces[1:], (None, None, None)], strict=True):
        assert s < e and (after[0] is None or e < after[0] or (e == after[0] and c != after[2]))
    for k in names:
        want = sorted({t for s, e, t in cuts if s <= k < e})
        assert next((c for s, e, c in pieces if s <= k < e), []) == want
    few, many = (got(R.uncovered(log(spark, *rows), rt(spark, *cuts), 15, few=n), "k") for n in (99, 0))
    assert few == many == sorted((k,) for k, ts, *_ in rows if not any(s <= k < e and ts <= t <= 15 for s, e, t in cuts))
    free = got(intervals.gaps(rt(spark, *cuts).select("start", "end"), "00", "30"), "start", "end")
    assert all(any(s <= k < e for s, e in free) != any(s <= k < e for s, e, _ in cuts) for k in names)


def test_interval_edges(spark):
    same = rt(spark, ("a", "c", 1), ("c", "e", 1), ("x", "x", 2))
    assert [(r.start, r.end, r.covering_ts) for r in intervals.fragment(same).collect()] == [("a", "e", [1])]
    pieces = intervals.fragment(rt(spark, ("a", "d", 1), ("b", "c", 9)))
    assert got(intervals.truncate(pieces, "b", "bb"), "start", "end") == [("b", "bb")]
    assert got(intervals.collect_garbage(pieces, 5), "start", "end") == [("b", "c")]
    assert intervals.fragment(same.limit(0)).count() == 0
    assert got(intervals.merge(pieces, intervals.fragment(same)), "start", "end") == [("a", "b"), ("b", "c"), ("c", "e")]


def test_compaction_rules(spark):
    rows = log(spark, ("a", 1, 0, 0, "1"), ("a", 2, 0, 0, "2"), ("a", 9, 0, 0, "9"), ("b", 3, 0, 2, None), ("c", 4, 0, 3, "c", 7), ("p:x", 2, 0, 0, "x"), ("d", 1, 0, 0, "d"))
    cut = rt(spark, ("d", "e", 5))
    f = [compaction.PrefixFilter(1, "p:", 5)]
    assert got(compaction.compact(rows, cut, 5, now=7, filters=f), "k", "ts") == [("a", 2), ("a", 9)]
    assert got(compaction.compact(rows, cut, 5, idle=False, now=7, filters=f), "k", "ts") == [("a", 2), ("a", 9), ("c", 4), ("p:x", 2)]
    assert got(compaction.compact(rows, cut, 5, bottom=False), "k", "ts") == [("a", 2), ("a", 9), ("b", 3), ("c", 4), ("d", 1), ("p:x", 2)]
    assert got(compaction.compact(rows, rt(spark, ("d", "e", 6)), 5), "k", "ts")[-2:] == [("d", 1), ("p:x", 2)]


def test_value_separation(spark):
    rows = log(spark, ("a", 1, 0, 0, "x" * 2000), ("a", 2, 0, 0, "y" * 1500), ("b", 1, 0, 3, "z" * 1024, 50), ("c", 1, 0, 0, "small"))
    far, values = valuelog.separate(rows, 1024, files=1)
    assert got(far, "k", "ts", "kind") == [("a", 1, 1), ("a", 2, 1), ("b", 1, 4), ("c", 1, 0)]
    view = R.live(R.newest(far)).select("k", "v", "ptr")
    assert [(k, len(v)) for k, v in got(valuelog.resolve_values(view, values), "k", "v")] == [("a", 1500), ("b", 1024), ("c", 5)]
    kept = compaction.compact(far, None, 9)
    assert got(valuelog.dead(values, kept), "k", "ts") == [("a", 1)]
    left, files = valuelog.collect_garbage(values, kept, 0.3)
    assert got(left, "k", "ts") == [("a", 2), ("b", 1)] and files.count() == 1 and valuelog.orphans(values, kept.limit(0)).count() == 1


def test_paging_and_seeks(spark):
    view = spark.createDataFrame([(f"{i:03d}", i) for i in range(50)], "k string, v int")
    assert [r.v for r in R.page(view, 5, 3).collect()] == [5, 6, 7] and R.page(view, 60, 3).count() == 0
    starts = spark.createDataFrame([(0, "0105"), (1, "048"), (2, "999")], "seek int, start string")
    assert got(R.seek(view, starts, 3), "seek", "k") == [(0, "011"), (0, "012"), (0, "013"), (1, "048"), (1, "049")]
    assert stats.unordered_keys(R.rank_by_key(view), "rank").first()[0] == 0


def test_policies():
    runs = [P.Run(i, "a", "z") for i in range(4)]
    assert P.SimpleLeveled().pick(P.Shape([runs[:1]])) is None
    assert P.SimpleLeveled().pick(P.Shape([runs[:2]])) == P.Task(0, (0, 1), 1, (), False)
    task = P.Leveled(base_size=8).pick(P.Shape([runs[:2], [], [], [], [P.Run(9, "b", "c", 64)]]))
    assert task.upper == 0 and task.lower == 2
    assert P.Tiered(num_tiers=3).pick(P.Shape([[r] for r in runs[:2]])) is None
    assert P.Tiered(num_tiers=3).pick(P.Shape([[r] for r in runs[:3]])) == [0, 1, 2]
    # the tiers so far reach the next one's size and are merged with it; else there are too many
    wide = P.Tiered(num_tiers=3, max_size_amplification_percent=9999)
    assert wide.pick(P.Shape([runs[:3], runs[:2], runs[:4]])) == [0, 1] and wide.pick(P.Shape([[runs[0]], runs[:2], runs[:4]])) == [0, 1]
    assert wide.pick(P.Shape([[runs[0]], runs[:2], runs[:2]])) == [0, 1, 2]
    for policy in (P.SimpleLeveled(), P.Leveled(base_size=4), P.Tiered(num_tiers=3)):
        out = P.simulate(policy, 40)
        assert out["write_amplification"] >= 1 and out["sorted_runs"] < 10
    old = [P.Run(1, "a", "b", tombstones=3), P.Run(2, "c", "d", ttl_ratio=0.6, max_expire=5)]
    assert P.garbage_candidate(P.Shape([[], old]), 1).id == 1 and P.ttl_candidate(P.Shape([[], old]), 1, 5).id == 2 and P.ttl_candidate(P.Shape([[], old]), 1, 4) is None
