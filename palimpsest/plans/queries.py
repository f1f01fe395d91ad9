"""The queries of the core operators over the driver's tables, each with its SQL.

events is the change log: k from the user, ts from the event, errors are tombstones, signups expire;
some events are range tombstones as well. orders is a second log with one version a key, documents
has the large values. The clock is logical: now is the read timestamp.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import keys
from palimpsest.operators import compaction, intervals, stats, valuelog
from palimpsest.operators import resolve as R
from palimpsest.plans import policies
from palimpsest.store import Options, VersionedStore, local_rows
from palimpsest.streaming.ingest import ingest, latest

#: The read timestamp of the queries: nine tenths of the log's last, so that all scales read the same share.
AT_SQL = "(SELECT CAST(9 * (max(event_id) + 1) // 10 AS BIGINT) FROM events)"
_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def present(spark: SparkSession, sf_dir: str) -> int:
    """AT_SQL of a folder's events."""
    return 9 * ((table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1) // 10


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "'u' || lpad(cast(user_id as string), 8, '0') as k",
        "event_id + 1 as ts",
        "0 as seq",
        "cast(case when event_type = 'error' then 2 when event_type = 'signup' then 3 else 0 end as tinyint) as kind",
        "case when event_type = 'error' then null else value end as v",
        "case when event_type = 'signup' then event_id + 1 + 500 end as expire_at",
    )


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 997 = 3").selectExpr(
        "'u' || lpad(cast(user_id as string), 8, '0') as start",
        "'u' || lpad(cast(user_id + 5 as string), 8, '0') as end",
        "event_id + 1 as ts",
    )


def value_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two versions each: every third is rewritten, every fifth deleted."""
    docs = table(spark, sf_dir, "documents").selectExpr("'d' || lpad(cast(doc_id as string), 10, '0') as k", "doc_id", "text")
    first = docs.selectExpr("k", "doc_id + 1 as ts", "0 as seq", "0 as kind", "text as v")
    again = docs.where("doc_id % 3 = 0").selectExpr("k", "doc_id + 1000001 as ts", "0 as seq", "0 as kind", "'2' || text as v")
    gone = docs.where("doc_id % 5 = 0").selectExpr("k", "doc_id + 2000001 as ts", "0 as seq", "2 as kind", "null as v")
    return first.unionByName(again).unionByName(gone).withColumn("kind", F.col("kind").cast("tinyint")).withColumn(
        "expire_at", F.lit(None).cast("long")
    )


LOG = """log AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS k, CAST(event_id + 1 AS BIGINT) AS ts,
    CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'signup' THEN 3 ELSE 0 END AS kind,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v,
    CASE WHEN event_type = 'signup' THEN CAST(event_id + 501 AS BIGINT) END AS expire_at FROM events),
rt AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS s, 'u' || lpad(CAST(user_id + 5 AS VARCHAR), 8, '0') AS e,
    CAST(event_id + 1 AS BIGINT) AS ts FROM events WHERE event_id % 997 = 3)"""


def snap_sql(at: int | str = AT_SQL, name: str = "snap") -> str:
    return f"""{name} AS (SELECT k, v, ts FROM (SELECT log.*, row_number() OVER (PARTITION BY k ORDER BY ts DESC) rn FROM log WHERE ts <= {at}) top
    WHERE rn = 1 AND kind <> 2 AND (expire_at IS NULL OR expire_at > {at})
    AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.ts <= {at} AND top.k >= rt.s AND top.k < rt.e AND top.ts <= rt.ts))"""


FRAG = """p AS (SELECT s AS p FROM rt UNION SELECT e FROM rt), sp AS (SELECT p AS s, lead(p) OVER (ORDER BY p) AS e FROM p),
cov AS (SELECT sp.s, sp.e, list_sort(list(DISTINCT rt.ts)) AS c FROM sp JOIN rt ON rt.s <= sp.s AND rt.e >= sp.e WHERE sp.e IS NOT NULL GROUP BY ALL),
run AS (SELECT *, CASE WHEN lag(e) OVER (ORDER BY s) = s AND lag(c) OVER (ORDER BY s) = c THEN 0 ELSE 1 END AS f FROM cov),
frag AS (SELECT min(s) AS s, max(e) AS e, any_value(c) AS c FROM (SELECT *, sum(f) OVER (ORDER BY s) AS r FROM run) GROUP BY r)"""


def query(name: str, sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _found[name] = (f, sql)
        return f

    return take


def snap(spark: SparkSession, d: str, at: int | None = None, bounds: R.Bounds = R.ALL) -> DataFrame:
    at = present(spark, d) if at is None else at
    return R.snapshot(change_log(spark, d), tombstones(spark, d), at, at, bounds).select("k", "v", "ts")


def with_snap(body: str, at: int | str = AT_SQL) -> str:
    return f"WITH {LOG}, {snap_sql(at)} {body}"


@query("r1_newest_version", f"WITH {LOG} SELECT k, ts, kind FROM log WHERE ts <= {AT_SQL} QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC) = 1")
def r1(spark, d):
    return R.newest(change_log(spark, d), present(spark, d)).select("k", "ts", F.col("kind").cast("int").alias("kind"))


@query("r2_point_tombstones", f"""WITH {LOG}, t AS (SELECT * FROM log WHERE ts <= {AT_SQL} QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC) = 1)
SELECT k, ts FROM t WHERE kind <> 2""")
def r2(spark, d):
    return R.live(R.newest(change_log(spark, d), present(spark, d))).select("k", "ts")


@query("r3_ttl", f"""WITH {LOG}, t AS (SELECT * FROM log WHERE ts <= {AT_SQL} QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC) = 1)
SELECT k, ts FROM t WHERE kind <> 2 AND (expire_at IS NULL OR expire_at > {AT_SQL})""")
def r3(spark, d):
    return R.live(R.newest(change_log(spark, d), present(spark, d)), present(spark, d)).select("k", "ts")


@query("r4_range_tombstones", with_snap("SELECT k, v, ts FROM snap"))
def r4(spark, d):
    return snap(spark, d)


@query("s1_scan", with_snap("SELECT k, v FROM snap WHERE k >= 'u00000020' AND k < 'u00000090'"))
def s1(spark, d):
    return R.scan(change_log(spark, d), tombstones(spark, d), R.Bounds("u00000020", "u00000090"), present(spark, d), present(spark, d)).select("k", "v")


@query("s1_scan_open_closed", with_snap("SELECT k, v FROM snap WHERE k > 'u00000020' AND k <= 'u00000090'"))
def s1b(spark, d):
    return R.scan(change_log(spark, d), tombstones(spark, d), R.Bounds("u00000020", "u00000090", True, False), present(spark, d), present(spark, d)).select("k", "v")


@query("s3_prefix_scan", with_snap("SELECT k, v FROM snap WHERE k LIKE 'u000000%'"))
def s3(spark, d):
    return R.prefix_scan(change_log(spark, d), "u000000", tombstones(spark, d), present(spark, d), present(spark, d)).select("k", "v")


@query("s4_time_travel", with_snap("SELECT k, v, ts FROM snap", 400))
def s4(spark, d):
    return snap(spark, d, 400)


@query("s6_get", with_snap("SELECT k, v, ts FROM snap WHERE k = 'u00000042'"))
def s6(spark, d):
    return R.get(change_log(spark, d), "u00000042", tombstones(spark, d), present(spark, d), present(spark, d)).select("k", "v", "ts")


BATCH = "SELECT CAST(c_custkey AS BIGINT) AS ord, 'u' || lpad(CAST(c_custkey % 40 AS VARCHAR), 8, '0') AS k FROM customer"


@query("s8_batch_get", with_snap(f"SELECT ord, b.k, v, snap.k IS NOT NULL AS found FROM ({BATCH}) b LEFT JOIN snap ON b.k = snap.k"))
def s8(spark, d):
    asked = table(spark, d, "customer").selectExpr("c_custkey as ord", "'u' || lpad(cast(c_custkey % 40 as string), 8, '0') as k")
    return R.batch_get(change_log(spark, d), asked, tombstones(spark, d), present(spark, d), present(spark, d)).select("ord", "k", "v", "found")


@query("s10_exact_version", f"WITH {LOG} SELECT k, ts, v FROM log WHERE k = (SELECT k FROM log WHERE ts = 77) AND ts = 77")
def s10(spark, d):
    k = change_log(spark, d).where("ts = 77").select("k").first()[0]
    return R.get_exact(change_log(spark, d), k, 77).select("k", "ts", "v")


@query("s11_get_with_kind", f"""WITH {LOG} SELECT k, kind, ts, expire_at FROM log WHERE k IN ('u00000003', 'u00000004', 'u00000005') AND ts <= {AT_SQL}
QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC) = 1""")
def s11(spark, d):
    log = change_log(spark, d).where(F.col("k").isin("u00000003", "u00000004", "u00000005"))
    return R.newest(log, present(spark, d)).select("k", F.col("kind").cast("int").alias("kind"), "ts", "expire_at")


@query("s13_parallel_scan", with_snap("SELECT k, v, ts FROM snap"))
def s13(spark, d):
    return snap(spark, d).repartitionByRange("k").sortWithinPartitions("k")


@query("s14_parallel_prefix_scan", with_snap("SELECT k, v, ts FROM snap WHERE starts_with(k, 'u0000010')"))
def s14(spark, d):
    return snap(spark, d, bounds=R.Bounds.of_prefix("u0000010")).repartitionByRange("k").sortWithinPartitions("k")


@query("s_orders_scan", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k, o_totalprice AS v FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
def s_orders(spark, d):
    log = table(spark, d, "orders").selectExpr("lpad(cast(o_orderkey as string), 12, '0') as k", "1L as ts", "0 as seq", "0 as kind", "o_totalprice as v")
    return R.scan(log, None, R.Bounds(f"{100:012d}", f"{5000:012d}")).select("k", "v")


@query("s_pages_prefix", "SELECT url AS k, CAST(strlen(html) AS BIGINT) AS size FROM pages WHERE starts_with(url, 'https://') QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1")
def s_pages(spark, d):
    log = table(spark, d, "pages").selectExpr("url as k", "page_id as ts", "0 as seq", "0 as kind", "cast(octet_length(html) as bigint) as v")
    return R.prefix_scan(log, "https://").selectExpr("k", "v as size")


@query("s_conversation_prefix", "SELECT turn, text FROM conversations WHERE conv_id = 3")
def s_conv(spark, d):
    log = table(spark, d, "conversations").selectExpr(
        "lpad(cast(conv_id as string), 8, '0') || '/' || lpad(cast(turn as string), 6, '0') as k", "1L as ts", "0 as seq", "0 as kind", "struct(turn, text) as v"
    )
    return R.prefix_scan(log, "00000003/").select("v.turn", "v.text")


@query("p5_keys_only", with_snap("SELECT k FROM snap ORDER BY k LIMIT 25"))
def p5(spark, d):
    return R.page(snap(spark, d).select("k"), 0, 25)


@query("p6_values_only", with_snap("SELECT v FROM snap ORDER BY k LIMIT 25"))
def p6(spark, d):
    return R.page(snap(spark, d), 0, 25).select("v")


@query("p13_filter_match", f"WITH {LOG} SELECT k, ts FROM log WHERE ts <= 5000 AND starts_with(k, 'u0000001')")
def p13(spark, d):
    return change_log(spark, d).where(compaction.PrefixFilter(1, "u0000001", 5000).matches()).select("k", "ts")


@query("p16_overlap_visible", f"WITH {LOG} SELECT count(*) > 0 AS overlaps FROM rt WHERE s < 'u00000060' AND e > 'u00000050' AND ts <= {AT_SQL}")
def p16(spark, d):
    return intervals.overlapping(tombstones(spark, d), "u00000050", "u00000060", present(spark, d)).agg((F.count("*") > 0).alias("overlaps"))


@query("p17_overlapping_tombstones", f"WITH {LOG} SELECT s AS start, e AS \"end\", ts FROM rt WHERE s < 'u00000090' AND e > 'u00000010'")
def p17(spark, d):
    return intervals.overlapping(tombstones(spark, d), "u00000010", "u00000090")


@query("p18_range_has_rows", f"WITH {LOG} SELECT count(*) > 0 AS found FROM log WHERE k >= 'u00000010' AND k < 'u00000012'")
def p18(spark, d):
    return R.Bounds("u00000010", "u00000012").apply(change_log(spark, d)).limit(1).agg((F.count("*") > 0).alias("found"))


@query("j1_merge_sources", with_snap("SELECT k, v, ts FROM snap"))
def j1(spark, d):
    log = change_log(spark, d)
    parts = [log.where(F.pmod(F.col("ts"), F.lit(3)) == i) for i in range(3)]
    return R.snapshot(R.merge(*parts), tombstones(spark, d), present(spark, d), present(spark, d)).select("k", "v", "ts")


OWN = "SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS k, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS kind, c_acctbal AS v FROM customer WHERE c_custkey < 60"


@query("j2_overlay_own_writes", with_snap(f"""SELECT coalesce(o.k, snap.k) AS k, CASE WHEN o.k IS NULL THEN snap.v ELSE o.v END AS v
FROM snap FULL JOIN ({OWN}) o ON snap.k = o.k WHERE o.k IS NULL OR o.kind <> 2"""))
def j2(spark, d):
    own = table(spark, d, "customer").where("c_custkey < 60").selectExpr(
        "'u' || lpad(cast(c_custkey as string), 8, '0') as k", "case when c_custkey % 3 = 0 then 2 else 0 end as kind", "c_acctbal as v"
    )
    return R.overlay(own, snap(spark, d))


@query("j4_fragment_suppression", with_snap("SELECT k, v, ts FROM snap"))
def j4(spark, d):
    top = R.live(R.newest(change_log(spark, d), present(spark, d)), present(spark, d))
    return R.uncovered(top, tombstones(spark, d), present(spark, d), few=0).select("k", "v", "ts")


@query("j5_asof_cover", f"""WITH {LOG} SELECT k, log.ts, (SELECT max(rt.ts) FROM rt WHERE rt.s <= k AND k < rt.e AND rt.ts <= {AT_SQL}) AS cover_ts
FROM log""")
def j5(spark, d):
    rows = change_log(spark, d).select("k", "ts")
    return intervals.cover(rows, intervals.fragment(tombstones(spark, d)), present(spark, d))


@query("j10_occ_conflicts", f"""WITH {LOG} SELECT DISTINCT c_custkey % 40 AS reader FROM customer
JOIN log ON log.k = 'u' || lpad(CAST(c_custkey % 40 AS VARCHAR), 8, '0') AND log.ts > {AT_SQL}""")
def j10(spark, d):
    reads = table(spark, d, "customer").selectExpr("c_custkey % 40 as reader", "'u' || lpad(cast(c_custkey % 40 as string), 8, '0') as k").distinct()
    return reads.join(change_log(spark, d).where(F.col("ts") > present(spark, d)), "k", "left_semi").select("reader")


SEG = "seg AS (SELECT CAST((ts - 1) // 1000 AS BIGINT) AS id, min(k) AS f, max(k) AS l, count(*) AS n FROM log GROUP BY 1)"


def segments(spark, d):
    log = change_log(spark, d).withColumn("id", F.expr("(ts - 1) div 1000"))
    return stats.segment_stats(log, "id")


@query("j11_overlapping_segments", f"WITH {LOG}, {SEG} SELECT a.id AS a, b.id AS b FROM seg a JOIN seg b ON a.id < b.id AND a.f <= b.l AND b.f <= a.l")
def j11(spark, d):
    return stats.overlapping_segments(segments(spark, d))


@query("j12_self_overlap", f"WITH {LOG}, {SEG} SELECT count(*) > 0 AS overlaps FROM seg a JOIN seg b ON a.id < b.id AND a.f <= b.l AND b.f <= a.l")
def j12(spark, d):
    return stats.has_overlap(segments(spark, d))


@query("j14_merge_fragments", f"WITH {LOG}, {FRAG} SELECT s AS start, e AS \"end\", array_to_string(c, ',') AS covering FROM frag")
def j14(spark, d):
    rt = tombstones(spark, d)
    halves = [intervals.fragment(rt.where(F.pmod(F.col("ts"), F.lit(2)) == i)) for i in range(2)]
    return intervals.merge(*halves).select("start", "end", F.array_join(F.col("covering_ts").cast("array<string>"), ",").alias("covering"))


@query("a1_count", with_snap("SELECT count(*) AS n FROM snap"))
def a1(spark, d):
    return R.count(snap(spark, d))


@query("a1_count_limited", with_snap("SELECT least(count(*), 50) AS n FROM snap"))
def a1b(spark, d):
    return R.count(snap(spark, d), 50)


@query("a2_newest_by_key", f"WITH {LOG} SELECT k, max(ts) AS ts, arg_max(v, ts) FILTER (WHERE true) AS v FROM log WHERE kind = 0 GROUP BY k")
def a2(spark, d):
    return R.newest(change_log(spark, d).where("kind = 0")).select("k", "ts", "v")


@query("a5_segment_stats", f"""WITH {LOG} SELECT CAST((ts - 1) // 1000 AS BIGINT) AS id, count(*) AS n_rows, count(DISTINCT k) AS n_keys,
count(*) - count(DISTINCT k) AS redundant, min(ts) AS min_ts, max(ts) AS max_ts, min(k) AS first_k, max(k) AS last_k,
count(*) FILTER (WHERE kind = 2) AS tombstones, count(expire_at) AS ttl_rows, min(expire_at) AS min_expire, max(expire_at) AS max_expire,
count(expire_at) < count(*) AS has_non_ttl FROM log GROUP BY 1""")
def a5(spark, d):
    return segments(spark, d)


@query("a6_level_totals", f"""WITH {LOG}, s AS (SELECT CAST((ts - 1) // 1000 AS BIGINT) AS id, count(*) AS n, count(*) - count(DISTINCT k) AS r,
count(*) FILTER (WHERE kind = 2) AS t, max(ts) AS m, count(expire_at) > 0 AS h FROM log GROUP BY 1)
SELECT id % 3 AS level, count(*) AS segments, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(r) AS BIGINT) AS redundant, CAST(sum(t) AS BIGINT) AS tombstones,
max(m) AS max_ts, bool_or(h) AS has_ttl FROM s GROUP BY 1""")
def a6(spark, d):
    return stats.totals(segments(spark, d).withColumn("level", F.col("id") % 3), "level")


@query("a8_fragment_bytes", f"WITH {LOG}, {FRAG} SELECT count(*) AS fragments, CAST(sum(8 + strlen(s) + strlen(e) + 8 * len(c)) AS BIGINT) AS bytes FROM frag")
def a8(spark, d):
    return stats.fragment_bytes(intervals.fragment(tombstones(spark, d)))


@query("a13_filter_stats", f"WITH {LOG} SELECT count(*) AS eligible FROM log WHERE kind <> 2 AND ts <= 5000 AND starts_with(k, 'u0000001')")
def a13(spark, d):
    return compaction.filter_stats(change_log(spark, d), [compaction.PrefixFilter(1, "u0000001", 5000)]).select("eligible")


@query("a19_percentiles", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def a19(spark, d):
    return stats.percentiles(table(spark, d, "events"), "value", 0.5, 0.95, 0.99)


@query("a20_rate_windows", "SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def a20(spark, d):
    return stats.rate_windows(table(spark, d, "events"), "ts", "1 hour")


@query("w1_version_rank", f"WITH {LOG} SELECT k, ts, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS rank FROM log")
def w1(spark, d):
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("seq"))).cast("long")
    return change_log(spark, d).select("k", "ts", rank.alias("rank"))


@query("w2_retention", f"""WITH {LOG} SELECT k, ts FROM log QUALIFY ts > 5000 OR row_number() OVER (PARTITION BY k, ts <= 5000 ORDER BY ts DESC) = 1""")
def w2(spark, d):
    return compaction.retained(change_log(spark, d), 5000).select("k", "ts")


@query("w3_fragments", f"WITH {LOG}, {FRAG} SELECT s AS start, e AS \"end\", array_to_string(c, ',') AS covering FROM frag")
def w3(spark, d):
    return intervals.fragment(tombstones(spark, d)).select("start", "end", F.array_join(F.col("covering_ts").cast("array<string>"), ",").alias("covering"))


@query("w5_truncate", f"""WITH {LOG}, {FRAG} SELECT greatest(s, 'u00000020') AS start, least(e, 'u00000100') AS "end", CAST(len(c) AS INTEGER) AS n FROM frag
WHERE s < 'u00000100' AND e > 'u00000020'""")
def w5(spark, d):
    return intervals.truncate(intervals.fragment(tombstones(spark, d)), "u00000020", "u00000100").select("start", "end", F.size("covering_ts").alias("n"))


@query("w6_gaps", f"""WITH {LOG}, r AS (SELECT greatest(s, 'u00000000') AS s, least(e, 'u00000150') AS e FROM rt WHERE s < 'u00000150'
UNION ALL SELECT 'u00000150', 'u00000150'), g AS (SELECT coalesce(max(e) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'u00000000') AS a, s AS b FROM r)
SELECT a AS start, b AS "end" FROM g WHERE a < b""")
def w6(spark, d):
    return intervals.gaps(tombstones(spark, d).select("start", "end"), "u00000000", "u00000150")


@query("w7_fragment_gc", f"""WITH {LOG}, {FRAG} SELECT s AS start, e AS "end", array_to_string(list_filter(c, lambda x: x > 5000), ',') AS covering FROM frag
WHERE len(list_filter(c, lambda x: x > 5000)) > 0""")
def w7(spark, d):
    return intervals.collect_garbage(intervals.fragment(tombstones(spark, d)), 5000).select(
        "start", "end", F.array_join(F.col("covering_ts").cast("array<string>"), ",").alias("covering")
    )


@query("w8_redundant_versions", f"WITH {LOG} SELECT count(*) - count(DISTINCT k) AS redundant FROM log")
def w8(spark, d):
    return stats.segment_stats(change_log(spark, d)).select("redundant")


@query("w9_order_check", "SELECT CAST(0 AS BIGINT) AS violations")
def w9(spark, d):
    return stats.unordered_keys(R.rank_by_key(snap(spark, d)), "rank")


@query("w10_key_rank", with_snap("SELECT k, row_number() OVER (ORDER BY k) AS rank FROM snap"))
def w10(spark, d):
    return R.rank_by_key(snap(spark, d)).select("k", F.col("rank").cast("long").alias("rank"))


@query("w11_last_op_wins", """SELECT 'p' || CAST(l_partkey AS VARCHAR) AS k, max(rn) AS pos FROM
(SELECT l_partkey, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS rn FROM lineitem) GROUP BY 1""")
def w11(spark, d):
    batch = table(spark, d, "lineitem").selectExpr("'p' || l_partkey as k", "cast(l_orderkey * 10 + l_linenumber as bigint) as pos")
    return R.last_per_key(batch)


@query("t2_offset_limit", with_snap("SELECT k, v FROM snap ORDER BY k LIMIT 20 OFFSET 40"))
def t2(spark, d):
    return R.page(snap(spark, d).select("k", "v"), 40, 20)


@query("t4_seek_next", with_snap("""SELECT CAST(i AS BIGINT) AS seek, n.k FROM (SELECT unnest(range(0, 10)) AS i) s,
LATERAL (SELECT k FROM snap WHERE k >= 'u' || lpad(CAST(i * 13 AS VARCHAR), 8, '0') ORDER BY k LIMIT 5) n"""))
def t4(spark, d):
    starts = spark.range(10).selectExpr("id as seek", "'u' || lpad(cast(id * 13 as string), 8, '0') as start")
    return R.seek(snap(spark, d).select("k"), starts, 5).select("seek", "k")


@query("t5_pick_candidate", f"""WITH {LOG} SELECT CAST((ts - 1) // 1000 AS BIGINT) AS id FROM log GROUP BY 1
ORDER BY count(*) FILTER (WHERE kind = 2) + count(*) - count(DISTINCT k) DESC, count(*) FILTER (WHERE kind = 2) DESC, id LIMIT 1""")
def t5(spark, d):
    # the policies work on the manifest's rows, one a segment
    rows = segments(spark, d).select("id", "tombstones", "redundant").collect()
    best = policies.garbage_candidate(policies.Shape([[policies.Run(r.id, "", "", tombstones=r.tombstones, redundant=r.redundant) for r in rows]]), 0)
    return local_rows(spark, [(best.id,)] if best else [], "id bigint")


@query("f5_encoded_length", "SELECT o_orderpriority AS k, CAST((strlen(o_orderpriority) // 8 + 1) * 9 + 8 AS BIGINT) AS n FROM orders GROUP BY ALL")
def f5(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("k")).distinct().select("k", keys.encoded_length("k").alias("n"))


@query("f9_expire_at", "SELECT event_id, CAST(event_id + ceil(value) AS BIGINT) AS expire_at FROM events WHERE event_type = 'purchase'")
def f9(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").select("event_id", keys.expiry("event_id", "value").alias("expire_at"))


@query("f12_value_entry_size", "SELECT doc_id, CAST(ceil((24 + 8 + strlen(text)) / 8.0) * 8 AS BIGINT) AS size FROM documents")
def f12(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "lpad(cast(doc_id as string), 8, '0') as k", "text as v")
    return docs.select("doc_id", keys.value_entry_size("k", "v").alias("size"))


@query("f6_bloom_hash")
def f6(spark, d):
    return change_log(spark, d).select("k").distinct().select("k", keys.bloom_hash("k").alias("hash"))


@query("f15_steady_key", "SELECT CAST(c_custkey AS BIGINT) AS id, lpad(upper(to_hex(c_custkey)), 16, '0') || repeat('30', 12) AS k FROM customer")
def f15(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.hex(keys.steady_key("c_custkey")).alias("k"))


COMPACT = f"""WITH {LOG}, kept AS (SELECT * FROM log QUALIFY ts > 5000 OR row_number() OVER (PARTITION BY k, ts <= 5000 ORDER BY ts DESC) = 1)
SELECT k, ts, kind FROM kept WHERE ts > 5000 OR (kind <> 2 AND (expire_at IS NULL OR expire_at > 5000) AND NOT (ts <= 3000 AND starts_with(k, 'u0000001'))
AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.ts <= 5000 AND kept.ts <= rt.ts AND kept.k >= rt.s AND kept.k < rt.e))"""


@query("m1_compact", COMPACT)
def m1(spark, d):
    out = compaction.compact(change_log(spark, d), tombstones(spark, d), 5000, now=5000, filters=[compaction.PrefixFilter(1, "u0000001", 3000)])
    return out.select("k", "ts", F.col("kind").cast("int").alias("kind"))


@query("m1_compact_upper_level", f"WITH {LOG} SELECT k, ts FROM log QUALIFY ts > 5000 OR row_number() OVER (PARTITION BY k, ts <= 5000 ORDER BY ts DESC) = 1")
def m1b(spark, d):
    return compaction.compact(change_log(spark, d), tombstones(spark, d), 5000, bottom=False).select("k", "ts")


@query("m2_full_compaction_keeps_view", with_snap("SELECT k, v, ts FROM snap"))
def m2(spark, d):
    log, rt = change_log(spark, d).where(F.col("ts") <= present(spark, d)), tombstones(spark, d).where(F.col("ts") <= present(spark, d))
    return R.snapshot(compaction.compact(log, rt, present(spark, d), now=present(spark, d)), None, present(spark, d), present(spark, d)).select("k", "v", "ts")


@query("a14_digest_balance", "SELECT true AS balanced")
def a14(spark, d):
    log = change_log(spark, d)
    kept = compaction.retained(log, 5000)
    gone = log.join(kept.select("k", "ts"), ["k", "ts"], "left_anti")
    one, two, three = (compaction.digest(x).selectExpr(f"n as n{i}", f"coalesce(sum, 0) as s{i}") for i, x in enumerate((log, kept, gone)))
    return one.crossJoin(two).crossJoin(three).selectExpr("n0 = n1 + n2 and s0 = s1 + s2 as balanced")


VAL = """vlog AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS k, CAST(doc_id + 1 AS BIGINT) AS ts, 0 AS kind, text AS v FROM documents
UNION ALL SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 10, '0'), CAST(doc_id + 1000001 AS BIGINT), 0, '2' || text FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 10, '0'), CAST(doc_id + 2000001 AS BIGINT), 2, NULL FROM documents WHERE doc_id % 5 = 0),
alive AS (SELECT * FROM vlog QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC) = 1)"""


@query("m19_separate_values", f"WITH {VAL} SELECT k, ts, coalesce(strlen(v) >= 1024, false) AS far FROM vlog")
def m19(spark, d):
    log, _ = valuelog.separate(value_log(spark, d))
    return log.select("k", "ts", F.col("ptr").isNotNull().alias("far"))


@query("r6_resolve_values", f"WITH {VAL} SELECT k, sha256(v) AS digest FROM alive WHERE kind <> 2")
def r6(spark, d):
    log, values = valuelog.separate(value_log(spark, d))
    view = R.live(R.newest(log)).select("k", "v", "ptr")
    return valuelog.resolve_values(view, values).select("k", F.sha2("v", 256).alias("digest"))


def _after_compaction(spark, d):
    log, values = valuelog.separate(value_log(spark, d))
    return compaction.compact(log, None, 10_000_000), values


@query("j9_dead_values", f"""WITH {VAL} SELECT k, ts FROM vlog WHERE strlen(v) >= 1024
AND NOT EXISTS (SELECT 1 FROM alive a WHERE a.kind <> 2 AND a.k = vlog.k AND a.ts = vlog.ts)""")
def j9(spark, d):
    log, values = _after_compaction(spark, d)
    return valuelog.dead(values, log).select("k", "ts")


@query("m13_value_gc", f"WITH {VAL} SELECT k, ts FROM alive WHERE kind <> 2 AND strlen(v) >= 1024")
def m13(spark, d):
    log, values = _after_compaction(spark, d)
    return valuelog.collect_garbage(values, log, 0.0)[0].select("k", "ts")


@query("a9_stale_bytes", f"""WITH {VAL}, big AS (SELECT k, ts, CAST(ceil((24 + strlen(k) + strlen(v)) / 8.0) * 8 AS BIGINT) AS size FROM vlog WHERE strlen(v) >= 1024)
SELECT CAST(sum(size) AS BIGINT) AS total_bytes, CAST(coalesce(sum(size) FILTER (WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.kind <> 2 AND a.k = big.k AND a.ts = big.ts)), 0) AS BIGINT) AS dead_bytes FROM big""")
def a9(spark, d):
    log, values = _after_compaction(spark, d)
    return valuelog.stale_ratio(values, log).agg(F.sum("total_bytes").alias("total_bytes"), F.sum("dead_bytes").alias("dead_bytes"))


@query("u3_orphan_files", f"WITH {VAL} SELECT CAST(0 AS BIGINT) AS orphans")
def u3(spark, d):
    log, values = valuelog.separate(value_log(spark, d))
    return valuelog.orphans(values, log).agg(F.count("*").alias("orphans"))


@query("j13_file_references", f"WITH {VAL} SELECT kind, count(*) AS n FROM (SELECT kind, ts FROM vlog WHERE coalesce(strlen(v) >= 1024, false)) GROUP BY kind")
def j13(spark, d):
    log, values = valuelog.separate(value_log(spark, d))
    both = log.where("ptr is not null").select("ptr.file_id", "ptr.offset").join(values.drop("v"), ["file_id", "offset"])
    return both.agg(F.count("*").alias("n")).where("n > 0").selectExpr("0 as kind", "n")


@query("a16_level_rows", f"WITH {LOG} SELECT CAST((ts - 1) // 1000 AS BIGINT) % 3 AS level, count(DISTINCT (ts - 1) // 1000) AS runs, count(*) AS n_rows FROM log GROUP BY 1")
def a16(spark, d):
    return segments(spark, d).withColumn("level", F.col("id") % 3).groupBy("level").agg(F.count("*").alias("runs"), F.sum("n_rows").alias("n_rows"))


@query("a21_saturating_diff", "SELECT event_id, CAST(greatest(user_id - 50, 0) AS BIGINT) AS d FROM events")
def a21(spark, d):
    return table(spark, d, "events").select("event_id", stats.saturating_diff(F.col("user_id"), F.lit(50)).cast("long").alias("d"))


def _store(spark: SparkSession) -> VersionedStore:
    """An empty store in the folder that all executors share; a local one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    return VersionedStore.open(spark, f"{root}/store-{uuid.uuid4().hex}", Options(value_type="double"))


BY_USER = """SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS k, value AS v FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'"""
FEED = ["'u' || lpad(cast(user_id as string), 8, '0') as k", "value as v", "event_id as pos", "if(event_type = 'error', 'del', 'put') as op"]


@query("x_store_ingest_scan", BY_USER)
def x_store(spark, d):
    store = _store(spark)
    events = table(spark, d, "events")
    cut = events.agg(F.expr("max(event_id) div 2")).first()[0]
    store.ingest(events.where(F.col("event_id") <= cut).selectExpr(*FEED))
    store.ingest(events.where(F.col("event_id") > cut).selectExpr(*FEED))
    store.compact()
    return store.scan()


@query("st1_stream_ingest", BY_USER)
def st1(spark, d):
    store = _store(spark)
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").selectExpr(*FEED)  # a pattern: a stream takes no single file
    ingest(stream, store, f"{store.root}/progress", f"q{uuid.uuid4().hex}").awaitTermination()
    return store.scan()


@query("st5_latest_state", f"WITH {LOG} SELECT k, max(ts) AS ts FROM log GROUP BY k")
def st5(spark, d):
    return latest(change_log(spark, d)).select("k", "ts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}
