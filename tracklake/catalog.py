"""The reference operators bound to the driver's tables, each with SQL that gives the same rows.

``events`` are samples (a track per user), ``lineitem`` and ``orders`` are sample tables of chunks, ``embeddings`` are sampled values and
``documents`` and ``pages`` are bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import catalog_assets, catalog_streams, catalog_workflows  # noqa: F401  they register their queries
from .catalog_containers import transport_files
from .functions import bitstream as N
from .functions import bytesql as B
from .functions import pcm as P
from .functions import writers as W
from .operators import packets as K
from .operators import selection as S
from .operators import timeline as T
from .registry import EV, LINE, LINE_ORDER, QUERIES, SQL, chunks, ev, plain, query, table, vectors
from .sources import media as M
from .streaming import rings
from .tables import dealt

# --- selection

@query("q_track_select_nth", "SELECT o_custkey AS track_id, o_orderkey AS idx FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 2")
def _(spark, d):
    second = S.nth_of(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 1)
    return second.select(F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("idx"))


_POS = f"WITH {EV}, p AS (SELECT *, row_number() OVER w - 1 AS position, first_value(pts) OVER w AS first_pts, lead(pts) OVER w AS nxt FROM ev WINDOW w AS (PARTITION BY track_id ORDER BY idx, pts))"


@query("q_select_index_range", f"{_POS} SELECT track_id, idx, pts FROM p WHERE position BETWEEN 3 AND 9")
def _(spark, d):
    return plain(S.select_samples(ev(spark, d), S.Criteria(start_index=3, end_index=9)))


@query("q_select_time_half_open", f"{_POS} SELECT track_id, idx, pts FROM p WHERE pts >= first_pts + 86400000000 AND pts < first_pts + 864000000000")
def _(spark, d):
    return plain(S.select_samples(ev(spark, d), S.Criteria(start_us=86_400_000_000, end_us=864_000_000_000)))


@query("q_select_audio_overlap", f"{_POS} SELECT track_id, idx, pts FROM p WHERE greatest(pts + 1, coalesce(nxt, pts + 1)) > first_pts + 86400000000 AND pts < first_pts + 864000000000")
def _(spark, d):
    return plain(S.select_samples(ev(spark, d), S.Criteria(start_us=86_400_000_000, end_us=864_000_000_000, kind="audio")))


for _name, _kind, _where in (("key", "key", "is_key"), ("non_key", "non_key", "NOT is_key"), ("picture", "P", "pic = 'P'")):
    query(f"q_select_{_name}", f"WITH {EV} SELECT track_id, idx, pts FROM ev WHERE {_where}")(lambda spark, d, k=_kind: plain(ev(spark, d).where(S.matches_frame_type(k))))


@query("q_select_limit_per_track", f"WITH {EV} SELECT track_id, idx, pts FROM ev WHERE is_key QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY idx, pts) <= 5")
def _(spark, d):
    return plain(S.select_samples(ev(spark, d), S.Criteria(frame_type="key", limit=5)))


@query("q_select_decode_order_limit", f"SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, {LINE}, l_quantity, l_discount, l_tax) <= 2")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", *LINE_ORDER, "l_quantity", "l_discount", "l_tax"))
    return chunks(spark, d).withColumn("n", n).where("n <= 2").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("q_selection_range_end", f"{_POS} SELECT track_id, max(pts) AS range_end FROM p WHERE position BETWEEN 3 AND 9 GROUP BY track_id")
def _(spark, d):
    return S.range_end(S.select_samples(ev(spark, d), S.Criteria(start_index=3, end_index=9)))


@query("q_selection_id", f"""WITH {EV}, s AS (SELECT track_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS ids FROM ev WHERE is_key GROUP BY track_id)
SELECT track_id, 'selection:' || printf('%08x', list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(ids, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS selection_id FROM s""")
def _(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("index")), lambda i: i.cast("string")), ",")
    return ev(spark, d).where("is_key").groupBy("track_id").agg(ids.alias("ids")).select("track_id", B.selection_id(F.col("ids")).alias("selection_id"))


@query("q_frame_pick_nearest", f"WITH {EV}, m AS (SELECT (min(pts) + max(pts)) // 2 AS t FROM ev) SELECT track_id, arg_min(idx, (abs(pts - t), pts, idx)) AS idx FROM ev, m GROUP BY track_id")
def _(spark, d):
    rows = T.with_scalars(ev(spark, d), F.expr("(min(pts_us) + max(pts_us)) div 2").alias("t"))
    return S.nearest_frame(rows, F.col("t")).select("track_id", F.col("index").alias("idx"))


@query("q_remux_filter", f"WITH {EV}, m AS (SELECT min(pts) AS t FROM ev) SELECT track_id, idx, pts FROM ev, m WHERE pts + 1 > t + 864000000000 AND pts < t + 1728000000000")
def _(spark, d):
    rows = T.with_scalars(ev(spark, d), F.min("pts_us").alias("t"))
    return plain(rows.where(S.overlaps(F.col("t") + 864_000_000_000, F.col("t") + 1_728_000_000_000)))


# --- planning

_GOP = f"""WITH {EV}, g AS (SELECT *, sum(is_key::INT) OVER (PARTITION BY track_id ORDER BY pts, idx ROWS UNBOUNDED PRECEDING) AS gop FROM ev),
n AS (SELECT *, max(is_target::INT) OVER (PARTITION BY track_id, gop ORDER BY pts, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS need FROM g)"""


@query("q_gop_closure", f"{_GOP} SELECT track_id, idx, pts, gop::BIGINT AS gop FROM n WHERE need = 1")
def _(spark, d):
    return plain(T.gop_closure(ev(spark, d)), F.col("gop").cast("long").alias("gop"))


#: All events as one track, and rows of a range: few, so that the tables of any size have several.
_ALONE, RANGE = _GOP.replace("user_id AS track_id", "0::BIGINT AS track_id"), 4096


@query("q_one_track_closure", f"{_ALONE} SELECT track_id, idx, pts, gop::BIGINT AS gop FROM n WHERE need = 1")
def _(spark, d):
    """All events as one track, cut into ranges."""
    return plain(T.gop_closure(ev(spark, d).withColumn("track_id", F.lit(0).cast("long")), per=RANGE), F.col("gop").cast("long").alias("gop"))


@query("q_gop_orphans", f"{_GOP} SELECT track_id, idx, pts FROM n WHERE need = 1 AND gop = 0 AND is_target")
def _(spark, d):
    return plain(T.orphan_targets(ev(spark, d)))


@query("q_gop_decode_plan", f"{_GOP}, u AS (SELECT track_id, idx, coalesce(CASE WHEN x > 0 THEN x END, 33333) AS duration_us FROM (SELECT track_id, idx, lead(pts) OVER (PARTITION BY track_id ORDER BY pts, idx) - pts AS x FROM ev)) SELECT n.track_id, n.idx, pts, is_key, is_target, u.duration_us FROM n JOIN u USING (track_id, idx) WHERE need = 1")
def _(spark, d):
    """Flagship: what to decode for the targets, with every packet's duration; one shuffle by track serves all windows."""
    return plain(T.gop_closure(T.durations(ev(spark, d), 33_333)), "is_key", "is_target", "duration_us")


@query("q_target_semi_join", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')")
def _(spark, d):
    wanted = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return chunks(spark, d).join(wanted, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("q_unmapped_anti", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate < TIMESTAMP '1996-01-01')")
def _(spark, d):
    known = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'1996-01-01 00:00:00'")
    return chunks(spark, d).join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("q_map_with_fallback", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_name, s_name) AS mapped FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def _(spark, d):
    first = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    second = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    out = chunks(spark, d).join(first, "l_partkey", "left").join(second, "l_suppkey", "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("p_name", "s_name").alias("mapped"))


@query("q_nearest_tolerance", f"""WITH {EV}, q AS (SELECT * FROM ev WHERE pic = 'B'), t AS (SELECT * FROM ev WHERE is_target),
c AS (SELECT q.track_id, q.idx AS query, t.idx AS target, row_number() OVER (PARTITION BY q.track_id, q.idx ORDER BY abs(q.pts - t.pts), t.pts, t.idx) AS n, abs(q.pts - t.pts) AS gap FROM q JOIN t USING (track_id))
SELECT q.track_id, q.idx AS query, CASE WHEN gap <= 43200000000 THEN target END AS target FROM q LEFT JOIN (SELECT * FROM c WHERE n = 1) c ON q.track_id = c.track_id AND q.idx = c.query""")
def _(spark, d):
    rows = ev(spark, d)
    return T.nearest_target(rows.where("picture_type = 'B'"), rows.where("is_target"), 43_200_000_000)


@query("q_align_trim", f"WITH {EV}, a AS (SELECT * FROM ev WHERE track_id % 2 = 0), b AS (SELECT (max(pts) - min(pts)) // 2 AS span FROM ev WHERE track_id % 2 = 1) SELECT track_id, idx, pts FROM a, b WHERE pts - (SELECT min(pts) FROM a) < span")
def _(spark, d):
    rows = ev(spark, d)
    other = rows.where("track_id % 2 = 1")
    half = other.agg(F.expr("min(pts_us) + (max(pts_us) - min(pts_us)) div 2").alias("m"))
    ends = other.agg(F.min("pts_us").alias("pts_us")).union(half).withColumn("duration_us", F.lit(0).cast("long"))
    return plain(T.align_to(rows.where("track_id % 2 = 0"), ends))


@query("q_triple_lookup", """WITH f AS (SELECT 'p' || doc_id::VARCHAR AS packet_id, 's' || (doc_id * 2)::VARCHAR AS sample_id, doc_id * 3 AS pts, 'f' || doc_id::VARCHAR AS frame_id FROM documents),
p AS (SELECT 'p' || (conv_id * 2 + turn)::VARCHAR AS packet_id, 's' || (conv_id + turn)::VARCHAR AS sample_id, conv_id + turn * 7 AS pts FROM conversations)
SELECT p.packet_id, p.sample_id, p.pts, coalesce(a.frame_id, b.frame_id, c.frame_id) AS frame_id FROM p LEFT JOIN f a ON a.packet_id = p.packet_id LEFT JOIN f b ON b.sample_id = p.sample_id LEFT JOIN f c ON c.pts = p.pts""")
def _(spark, d):
    """Frames of packets by three keys; all documents are frames, and many ids of packets have none."""
    number, text = F.col("doc_id"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    frames = table(spark, d, "documents").select(text("p", number).alias("packet_id"), text("s", number * 2).alias("sample_id"), (number * 3).alias("pts_us"), text("f", number).alias("frame_id"), number.alias("index"))
    c, t = F.col("conv_id"), F.col("turn")
    packets = table(spark, d, "conversations").select(text("p", c * 2 + t).alias("packet_id"), text("s", c + t).alias("sample_id"), (c + t * 7).alias("pts_us"))
    return K.resolved_frames(packets, frames, keep=True).select("packet_id", "sample_id", F.col("pts_us").alias("pts"), "frame_id")


@query("q_capability_top1", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) = 1")
def _(spark, d):
    return S.first_match(table(spark, d, "part"), ["p_brand"], "p_partkey", [F.col("p_size"), -F.col("p_retailprice"), -F.col("p_partkey")])


# --- aggregates

_SUM = f"WITH {EV}, t AS (SELECT track_id, count(*) AS n_samples, max(pts) - min(pts) AS duration_us, sum(size)::BIGINT AS n_bytes FROM ev GROUP BY track_id)"


@query("q_count_by_track", f"WITH {EV} SELECT track_id, count(*) AS n_samples FROM ev GROUP BY track_id")
def _(spark, d):
    return ev(spark, d).groupBy("track_id").agg(F.count("*").alias("n_samples"))


@query("q_track_summary", f"{_SUM} SELECT *, CASE WHEN duration_us > 0 THEN floor(n_bytes * 8 * 1e6::DOUBLE / duration_us + 0.5)::BIGINT END AS bitrate FROM t")
def _(spark, d):
    return T.track_summary(ev(spark, d))


@query("q_container_rollup", f"{_SUM}, c AS (SELECT max(duration_us) AS duration_us, sum(n_bytes)::BIGINT AS n_bytes, count(*) AS n_tracks FROM t) SELECT *, CASE WHEN duration_us > 0 THEN floor(n_bytes * 8 * 1e6::DOUBLE / duration_us + 0.5)::BIGINT END AS bitrate FROM c")
def _(spark, d):
    return T.container_summary(T.track_summary(ev(spark, d)))


@query("q_inferred_frame_rate", f"WITH {EV} SELECT track_id, CASE WHEN count(*) < 2 OR max(pts) = min(pts) THEN 30 ELSE greatest(1, floor(count(*) * 1e6::DOUBLE / (max(pts) - min(pts)) + 0.5)::INT) END AS frame_rate FROM ev GROUP BY track_id")
def _(spark, d):
    return T.inferred_frame_rate(ev(spark, d))


@query("q_key_index_list", f"WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) AS n FROM ev) SELECT track_id, list(n ORDER BY n) AS keys FROM p WHERE is_key GROUP BY track_id")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("track_id").orderBy("index")).cast("long")
    return ev(spark, d).withColumn("n", n).where("is_key").groupBy("track_id").agg(F.array_sort(F.collect_list("n")).alias("keys"))


_PRICE = f"WITH s AS (SELECT l_orderkey AS track_id, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY {LINE}) AS last FROM lineitem), v AS (SELECT track_id, sum(coalesce(l_shipdate <= last, false)::INT)::BIGINT AS violations FROM s GROUP BY track_id)"


@query("q_non_monotonic", f"{_PRICE} SELECT * FROM v")
def _(spark, d):
    return T.non_monotonic(dealt(chunks(spark, d).select("l_orderkey", *LINE_ORDER).withColumnRenamed("l_orderkey", "track_id"), "track_id"), LINE_ORDER, "l_shipdate")


@query("q_one_track_monotonic", f"SELECT 0::BIGINT AS track_id, sum(bad)::BIGINT AS violations FROM (SELECT coalesce((l_shipdate <= lag(l_shipdate) OVER (ORDER BY {LINE}))::BIGINT, 0) AS bad FROM lineitem)")
def _(spark, d):
    """All lines as one track, cut into ranges."""
    return T.non_monotonic(chunks(spark, d).withColumn("track_id", F.lit(0).cast("long")), LINE_ORDER, "l_shipdate", per=RANGE)


@query("q_duplicate_ids", f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE}) > 1")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER))
    return chunks(spark, d).withColumn("n", n).where("n > 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("q_validation_union", f"""{_PRICE} SELECT track_id::VARCHAR AS source_id, 'warning' AS severity, 'track.non_monotonic' AS code, violations::VARCHAR || ' steps back' AS message FROM v WHERE violations > 0
UNION ALL SELECT o_orderkey::VARCHAR, 'error', 'asset.empty', 'no samples' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)""")
def _(spark, d):
    rows = chunks(spark, d)
    back = T.non_monotonic(dealt(rows.select("l_orderkey", *LINE_ORDER).withColumnRenamed("l_orderkey", "track_id"), "track_id"), LINE_ORDER, "l_shipdate").where("violations > 0")
    full = dealt(rows.where("l_quantity > 40").select("l_orderkey"), "l_orderkey")
    empty = dealt(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").join(full, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    first = T.diagnostics(back, "track.non_monotonic", "warning", F.concat(F.col("violations").cast("string"), F.lit(" steps back")), F.col("track_id"))
    return first.unionByName(T.diagnostics(empty, "asset.empty", "error", F.lit("no samples"), F.col("o_orderkey")))


# --- windows and sample tables

@query("q_packet_duration", f"WITH {EV}, x AS (SELECT track_id, idx, lead(pts) OVER (PARTITION BY track_id ORDER BY pts, idx) - pts AS gap FROM ev) SELECT track_id, idx, CASE WHEN gap > 0 THEN gap ELSE 21333 END AS duration_us FROM x")
def _(spark, d):
    return T.durations(ev(spark, d), 21_333).select("track_id", F.col("index").alias("idx"), "duration_us")


@query("q_frame_duration", f"WITH {EV} SELECT track_id, idx, coalesce(lead(pts) OVER w - pts, pts - lag(pts) OVER w, 33333) AS frame_us FROM ev WINDOW w AS (PARTITION BY track_id ORDER BY pts, idx)")
def _(spark, d):
    return T.frame_durations(ev(spark, d)).select("track_id", F.col("index").alias("idx"), "frame_us")


@query("q_dts_deltas", f"WITH {EV} SELECT track_id, idx, greatest(1, coalesce(pts - lag(pts) OVER (PARTITION BY track_id ORDER BY pts, idx), 1)) AS delta FROM ev")
def _(spark, d):
    return T.dts_deltas(ev(spark, d)).select("track_id", F.col("index").alias("idx"), "delta")


@query("q_stts_encode", f"""WITH s AS (SELECT l_orderkey, l_quantity, row_number() OVER w AS n, CASE WHEN row_number() OVER w = 1 OR l_quantity IS DISTINCT FROM lag(l_quantity) OVER w THEN 1 ELSE 0 END AS head FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINE})),
r AS (SELECT *, sum(head) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM s) SELECT l_orderkey, run, l_quantity, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, d):
    return T.run_lengths(chunks(spark, d), ["l_orderkey"], LINE_ORDER, "l_quantity")


@query("q_one_track_runs", f"""WITH s AS (SELECT l_quantity, row_number() OVER w AS n, CASE WHEN row_number() OVER w = 1 OR l_quantity IS DISTINCT FROM lag(l_quantity) OVER w THEN 1 ELSE 0 END AS head FROM lineitem WINDOW w AS (ORDER BY {LINE})),
r AS (SELECT *, sum(head) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM s) SELECT 0::BIGINT AS track_id, run, l_quantity, count(*) AS n FROM r GROUP BY ALL""")
def _(spark, d):
    """Run lengths of all lines as one track, cut into ranges."""
    return T.run_lengths(chunks(spark, d).withColumn("track_id", F.lit(0).cast("long")), ["track_id"], LINE_ORDER, "l_quantity", per=RANGE)


@query("q_stts_decode_dts", """WITH r AS (SELECT p_brand, p_partkey, p_size AS n, (p_partkey % 7 + 1)::BIGINT AS delta FROM part),
s AS (SELECT *, coalesce(sum(n) OVER w, 0)::BIGINT AS a, coalesce(sum(n * delta) OVER w, 0)::BIGINT AS t FROM r WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT p_brand, a + i AS sample, delta, t + i * delta AS dts FROM (SELECT *, unnest(range(n::BIGINT)) AS i FROM s)""")
def _(spark, d):
    runs = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").alias("n"), (F.col("p_partkey") % 7 + 1).alias("delta"))
    return T.expand_runs(runs, ["p_brand"], ["p_partkey"], "n", "delta")


@query("q_sample_offsets", f"SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey * 100000 + coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM lineitem")
def _(spark, d):
    out = T.sample_offsets(chunks(spark, d), "l_orderkey", F.col("l_orderkey") * 100_000, LINE_ORDER, "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("offset").cast("long").alias("offset"))


@query("q_stsc_asof", f"""WITH {EV}, r AS (SELECT track_id AS g, idx, pic FROM ev WHERE is_key OR is_target) SELECT e.track_id AS g, e.idx, (SELECT arg_max(pic, r.idx) FROM r WHERE r.g = e.track_id AND r.idx <= e.idx) AS pic FROM ev e""")
def _(spark, d):
    rows = ev(spark, d).select(F.col("track_id").alias("g"), F.col("index").alias("idx"), F.col("picture_type").alias("pic"))
    return T.last_run_at(rows.select("g", "idx"), rows.where("pic != 'B'"), "idx", "pic")


@query("q_sync_flag", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN any_key THEN l_returnflag = 'R' ELSE true END AS is_key FROM (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS any_key FROM lineitem)")
def _(spark, d):
    key = F.col("l_returnflag") == "R"
    some = F.max(key).over(Window.partitionBy("l_orderkey"))
    return chunks(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.when(some, key).otherwise(True).alias("is_key"))


@query("q_ctts_pad", "SELECT o_orderkey, coalesce(shift, 0) AS shift FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber)::BIGINT AS shift FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    shifts = chunks(spark, d).where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").cast("long").alias("shift"))
    return table(spark, d, "orders").select("o_orderkey").join(shifts, "o_orderkey", "left").fillna(0, ["shift"])


@query("q_payload_layout", f"WITH {EV}, t AS (SELECT track_id, sum(size)::BIGINT AS n_bytes FROM ev GROUP BY track_id) SELECT track_id, n_bytes, coalesce(sum(n_bytes) OVER (ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t")
def _(spark, d):
    tracks = ev(spark, d).groupBy("track_id").agg(F.sum("size").alias("n_bytes"))
    return T.running_totals(tracks, F.expr("track_id div 4096"), "track_id", "n_bytes", "start").select("track_id", "n_bytes", "start")


# --- bytes

_PREFIX = """CASE doc_id % 11 WHEN 0 THEN '464C5601' WHEN 1 THEN '0000001066747970' WHEN 2 THEN '000001BA' WHEN 3 THEN '524946460000000057415645' WHEN 4 THEN '664C6143' WHEN 5 THEN 'FFFB9064' WHEN 6 THEN '494433'
  WHEN 7 THEN '4F676753' || repeat('00', 24) || '4F707573' WHEN 8 THEN repeat('47' || repeat('00', 187), 5) WHEN 9 THEN '47' || repeat('00', 187) ELSE '' END"""
#: The format of bytes in hex, ``h``, for DuckDB.
_SNIFFED = f"""CASE WHEN h[1:6] = '464C56' THEN 'flv' WHEN len(h) >= 24 AND h[9:16] = '66747970' THEN 'mp4'
  WHEN len(h) >= 376 AND {' AND '.join(f"(len(h) < {376 * i + 2} OR h[{376 * i + 1}:{376 * i + 2}] = '47')" for i in range(5))} THEN 'mpegts'
  WHEN h[1:8] = '000001BA' THEN 'mpegps' WHEN h[1:8] = '52494646' AND h[17:24] = '57415645' THEN 'wav' WHEN h[1:8] = '664C6143' THEN 'flac'
  WHEN h[1:6] = '494433' OR (h[1:2] = 'FF' AND h[3:3] IN ('E', 'F')) THEN 'mp3' WHEN len(h) >= 72 AND h[1:8] = '4F676753' AND h[57:64] = '4F707573' THEN 'opus' ELSE 'unknown' END"""


def prefixed(spark, d, name="documents", key="doc_id", text="text") -> DataFrame:
    """The bytes of texts, each after the first bytes of some container."""
    kind = F.expr(_PREFIX.replace("doc_id", key))
    return table(spark, d, name).select(key, F.concat(F.unhex(kind), F.encode(text, "utf-8")).alias("data"))


@query("q_sniff_format", f"WITH b AS (SELECT doc_id, {_PREFIX} || hex(encode(text)) AS h FROM documents) SELECT doc_id, {_SNIFFED} AS format FROM b")
def _(spark, d):
    return prefixed(spark, d).select("doc_id", B.container_format(F.col("data")).alias("format"))


@query("q_probe_confidence", f"""WITH b AS (SELECT page_id, {_PREFIX.replace('doc_id', 'page_id')} || hex(encode(html)) AS h FROM pages), f AS (SELECT page_id, {_SNIFFED} AS format FROM b)
SELECT page_id, format, CASE format WHEN 'unknown' THEN 0.0::DOUBLE WHEN 'mp3' THEN 0.7::DOUBLE ELSE 0.98::DOUBLE END AS confidence FROM f""")
def _(spark, d):
    rows = M.probe(prefixed(spark, d, "pages", "page_id", "html"))
    return rows.select("page_id", "format", "confidence")


@query("q_hex_view", r"SELECT doc_id, strlen(text) AS byte_length, substr(lower(regexp_replace(hex(encode(text))[1:128], '(..)', '\1 ', 'g')), 1, greatest(0, 3 * least(64, strlen(text)) - 1)) AS hex FROM documents")
def _(spark, d):
    data = F.encode("text", "utf-8")
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("byte_length"), B.spaced_hex(B.part(data, 0, 64)).alias("hex"))


@query("q_byte_slice", "SELECT doc_id, CASE WHEN doc_id % 200 + 32 <= strlen(text) THEN lower(substr(hex(encode(text)), (2 * (doc_id % 200) + 1), 64)) END AS part FROM documents")
def _(spark, d):
    part = B.slice_bytes(F.encode("text", "utf-8"), F.col("doc_id") % 200, F.lit(32))
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(part)).alias("part"))


@query("q_codec_string", "SELECT doc_id, CASE WHEN strlen(text) >= 4 THEN 'avc1.' || lower(hex(encode(text))[3:8]) END AS codec FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", B.avc_codec_string(F.encode("text", "utf-8")).alias("codec"))


@query("q_asc_build", f"""WITH r AS (SELECT p_partkey, (p_size % 6 + 1) AS object_type, list_extract([{', '.join(map(str, [*B.AAC_RATES, 12345]))}], (p_partkey % 14 + 1)::INT) AS rate, (p_size % 3) AS channels FROM part)
SELECT p_partkey, CASE WHEN list_position([{', '.join(map(str, B.AAC_RATES))}], rate) IS NOT NULL AND list_position([{', '.join(map(str, B.AAC_RATES))}], rate) > 0 AND channels > 0
  THEN printf('%04x', ((object_type << 11) + ((list_position([{', '.join(map(str, B.AAC_RATES))}], rate) - 1) << 7) + (channels << 3))::INT) END AS config FROM r""")
def _(spark, d):
    rate = F.element_at(F.array(*[F.lit(r) for r in [*B.AAC_RATES, 12345]]), (F.col("p_partkey") % 14 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", B.audio_specific_config(F.col("p_size") % 6 + 1, rate, F.col("p_size") % 3).alias("config"))


@query("q_slice_type", "SELECT l_orderkey, l_linenumber, l_partkey, (['P', 'B', 'I', 'SP', 'SI'])[(l_linenumber % 5 + 1)::INT] AS h264, CASE l_linenumber WHEN 1 THEN 'P' WHEN 2 THEN 'I' END AS h265 FROM lineitem")
def _(spark, d):
    n = F.col("l_linenumber")
    return chunks(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", B.picture_of_slice("h264", n).alias("h264"), B.picture_of_slice("h265", n).alias("h265"))


_CODES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT)"


@query("q_g711_ulaw", f"""WITH b AS (SELECT doc_id, {_CODES} AS b FROM documents)
SELECT doc_id, coalesce(list_sum(list_transform(b, lambda c: (CASE WHEN c < 128 THEN -1 ELSE 1 END) * ((((255 - c) & 15) * 8 + 132) * (1 << (((255 - c) >> 4) & 7)) - 132))), 0)::BIGINT AS total FROM b""")
def _(spark, d):
    """The sum over each whole text."""
    return M.ulaw_sums(table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("data")))


# --- sampled values

@query("q_pcm_to_float", "SELECT vec_id, list_transform(embedding, lambda x: floor(greatest(-1.0, least(1.0, x::DOUBLE)) * 32767 + 0.5)::INT::DOUBLE / 32768) AS samples FROM embeddings")
def _(spark, d):
    return vectors(spark, d).select("vec_id", P.from_pcm16(P.quantise16(F.col("embedding"))).alias("samples"))


@query("q_pcm16_quantise", "SELECT vec_id, list_transform(embedding, lambda x: floor(greatest(-1.0, least(1.0, x::DOUBLE)) * 32767 + 0.5)::INT) AS samples FROM embeddings")
def _(spark, d):
    return vectors(spark, d).select("vec_id", P.quantise16(F.col("embedding")).alias("samples"))


@query("q_gain", "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 0.5) AS samples FROM embeddings")
def _(spark, d):
    return vectors(spark, d).select("vec_id", P.gain(F.col("embedding"), 0.5).alias("samples"))


@query("q_resample_linear", """WITH p AS (SELECT vec_id, embedding AS e, list_transform(range(128), lambda i: i * 63 / 127::DOUBLE) AS spots FROM embeddings)
SELECT vec_id, list_transform(spots, lambda x: floor(1e5::DOUBLE * (e[floor(x)::INT + 1]::DOUBLE + (e[least(floor(x)::INT + 2, 64)]::DOUBLE - e[floor(x)::INT + 1]::DOUBLE) * (x - floor(x))) + 0.5)::BIGINT) AS samples FROM p""")
def _(spark, d):
    out = P.resample_linear(F.col("embedding"), 24_000, 48_000)
    return vectors(spark, d).select("vec_id", F.transform(out, lambda x: F.floor(x * 1e5 + 0.5)).alias("samples"))


@query("q_pcm_trim", "SELECT vec_id, list_transform(embedding[13:33], lambda x: x::DOUBLE) AS samples FROM embeddings")
def _(spark, d):
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return vectors(spark, d).select("vec_id", P.trim(samples, 100, F.lit(0), F.lit(125_000), F.lit(324_001)).alias("samples"))


@query("q_interleave", "SELECT a.vec_id, flatten(list_transform(list_zip(a.embedding, b.embedding), lambda z: [z[1], z[2]])) AS samples FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def _(spark, d):
    left = vectors(spark, d).where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("a"))
    right = vectors(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return left.join(right, "vec_id").select("vec_id", P.interleave(F.col("a"), F.col("b")).alias("samples"))


# --- buffers and clocks over stored samples

@query("q_clock_ticks", f"WITH {EV} SELECT track_id, pts // 3600000000 AS tick, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, d):
    return ev(spark, d).groupBy("track_id", F.expr("pts_us div 3600000000").alias("tick")).agg(F.count("*").alias("n"))


@query("q_ring_drop_oldest", f"WITH {EV} SELECT track_id, idx, pts FROM ev QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY pts DESC, idx DESC) <= 8")
def _(spark, d):
    return plain(rings.held(ev(spark, d), 8))


@query("q_ring_drop_newest", f"WITH {EV} SELECT track_id, idx, pts FROM ev QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY pts, idx) <= 8")
def _(spark, d):
    return plain(rings.held(ev(spark, d), 8, "drop_newest"))


@query("q_pull_due", f"WITH {EV} SELECT track_id, idx, pts FROM ev WHERE pts <= (SELECT (min(pts) + max(pts)) // 2 FROM ev)")
def _(spark, d):
    rows = T.with_scalars(ev(spark, d), F.expr("(min(pts_us) + max(pts_us)) div 2").alias("t"))
    return plain(rows.where("pts_us <= t"))


@query("q_presentable_asof", f"""WITH {EV}, k AS (SELECT track_id, unnest(range(10)) AS tick FROM (SELECT DISTINCT track_id FROM ev)), b AS (SELECT min(pts) AS lo, max(pts) AS hi FROM ev), t AS (SELECT track_id, tick, lo + (hi - lo) // 10 * tick AS due FROM k, b)
SELECT t.track_id, tick, coalesce(max(idx) FILTER (pts <= due), min(idx)) AS idx FROM t JOIN ev USING (track_id) GROUP BY ALL""")
def _(spark, d):
    rows = ev(spark, d)
    spans = rows.groupBy("track_id").agg(F.min("index").alias("first"))
    ends = rows.agg(F.min("pts_us").alias("lo"), F.max("pts_us").alias("hi"))
    ticks = spans.crossJoin(F.broadcast(ends)).select("track_id", "lo", "hi", F.explode(F.expr("sequence(0L, 9L)")).alias("tick"))
    points = ticks.select(F.col("track_id").alias("g"), "tick", F.expr("lo + tick * ((hi - lo) div 10)").alias("pts_us"))
    latest = T.last_run_at(points, rows.select(F.col("track_id").alias("g"), "pts_us", "index"), "pts_us", "index").withColumnRenamed("index", "now").distinct()
    out = points.join(latest, ["g", "pts_us"]).join(spans.withColumnRenamed("track_id", "g"), "g")
    return out.select(F.col("g").alias("track_id"), "tick", F.coalesce("now", "first").alias("idx"))


@query("q_record_gate", f"""WITH {EV}, g AS (SELECT *, last_value(CASE WHEN is_key THEN true WHEN is_target THEN false END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS open FROM ev)
SELECT track_id, idx, pts FROM g WHERE open""")
def _(spark, d):
    return plain(rings.gated(ev(spark, d), F.col("is_key"), F.col("is_target")))


# --- projections

@query("q_overview", f"{_SUM} SELECT track_id, 'video:' || track_id::VARCHAR AS name, n_samples FROM t")
def _(spark, d):
    out = ev(spark, d).groupBy("track_id").agg(F.count("*").alias("n_samples"))
    return out.select("track_id", F.concat_ws(":", F.lit("video"), "track_id").alias("name"), "n_samples")


@query("q_sample_table", f"WITH {EV} SELECT track_id, idx, pts, is_key, pic AS picture_type, size FROM ev")
def _(spark, d):
    return plain(ev(spark, d), "is_key", "picture_type", "size")


# --- packets

_TEXT = "regexp_replace(coalesce(text, ''), '[^a-z ]', 'x', 'g')"
_HEX = "lower(hex(encode(coalesce(text, ''))))"


def plain_texts(spark, d) -> DataFrame:
    """Every document with its text in small letters, spaces and x; null texts are empty."""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", "x").alias("t"))


@query("q_annexb_split", f"WITH t AS (SELECT doc_id, regexp_extract_all({_TEXT}, '.{{1,20}}') AS u FROM documents) SELECT doc_id, len(u)::INT AS n_units, list_transform(u, lambda x: lower(hex(encode(x)))) AS units FROM t")
def _(spark, d):
    """A start code before every 20 characters of a text; the units as hex, in order."""
    data = F.concat(F.encode(F.regexp_replace("t", "(?s)(.{1,20})", "\x00\x00\x00\x01$1"), "utf-8"), F.lit(b"\x00\x00"))
    out = plain_texts(spark, d).select("doc_id", N.annexb_nals(data).alias("u"))
    return out.select("doc_id", F.size("u").alias("n_units"), F.transform("u", lambda u: F.lower(F.hex(u))).alias("units"))


@query("q_length_prefix", f"WITH t AS (SELECT doc_id, {_TEXT} AS t FROM documents) SELECT doc_id, CASE WHEN len(t) > 0 THEN printf('%08x', len(t)) || lower(hex(encode(t))) END AS data FROM t")
def _(spark, d):
    """One unit a text; an empty one makes no unit, and no unit has no length."""
    data = F.concat(F.lit(b"\x00\x00\x01"), F.encode("t", "utf-8"))
    return plain_texts(spark, d).select("doc_id", F.lower(F.hex(N.length_prefixed(N.annexb_nals(data)))).alias("data"))


@query("q_adts_strip", f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN len({_HEX}) > 0 THEN {_HEX} ELSE 'fff150800000fc' END
  WHEN len({_HEX}) > 4 THEN {_HEX}[5:] ELSE 'fff050800000fc' || {_HEX} END AS raw FROM documents""")
def _(spark, d):
    """Headers without and with a checksum; what is too short for the header it tells stays as it is."""
    head = F.when(F.col("doc_id") % 2 == 0, F.lit(b"\xff\xf1\x50\x80\x00\x00\xfc")).otherwise(F.lit(b"\xff\xf0\x50\x80\x00\x00\xfc"))
    data = F.concat(head, F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(N.without_adts(data))).alias("raw"))


@query("q_bitstream_format", f"""WITH b AS (SELECT doc_id, lang, {_PREFIX} || hex(encode(text)) AS h FROM documents), f AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'video' ELSE 'audio' END AS kind, CASE WHEN lang IN ('de', 'en') THEN 'aac' ELSE 'mp3' END AS family, {_SNIFFED} AS container FROM b)
SELECT doc_id, container, CASE WHEN kind = 'video' THEN CASE WHEN container IN ('mpegts', 'mpegps') THEN 'annexb' WHEN container IN ('flv', 'mp4') THEN 'avcc' ELSE 'unknown' END
  WHEN family = 'aac' THEN CASE WHEN container IN ('mpegts', 'mpegps') THEN 'adts' ELSE 'aac_raw' END ELSE 'mp3' END AS format FROM f""")
def _(spark, d):
    """The container is what the bytes say; kind and codec follow the language."""
    rows = prefixed(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    kind = F.when(F.col("lang") == "en", "video").otherwise("audio")
    family = N.codec_family(F.when(F.col("lang").isin("de", "en"), "aac").otherwise("unknown"), F.lit("MPEG Audio Layer III"))
    container = B.container_format(F.col("data"))
    return rows.select("doc_id", container.alias("container"), N.bitstream_format(kind, container, family).alias("format"))


# --- containers, built from rows and read as tables again

def _flv_files(rows: DataFrame, *by: str) -> DataFrame:
    """(source_id, data): FLV files of the rows (index, ms, is_key, n) of each group, with n bytes of payload a row."""
    big = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))
    n = F.col("n")
    body = F.concat(F.when(F.col("is_key"), F.lit(b"\x17\x01\x00\x00\x00")).otherwise(F.lit(b"\x27\x01\x00\x00\x00")), F.unhex(F.expr("repeat('AB', cast(n as int))")))
    tag = F.concat(F.lit(b"\x09"), big(n + 5, 3), big(F.col("ms") % (1 << 24), 3), big(F.shiftright("ms", 24), 1), F.lit(bytes(3)), body, big(n + 16, 4))
    files = rows.withColumn("tag", tag).groupBy(*by).agg(W.joined_in_order("tag", "index").alias("tags"))
    return files.select(F.concat_ws(":", *by).alias("source_id"), F.concat(F.lit(b"FLV\x01\x01\x00\x00\x00\x09\x00\x00\x00\x00"), F.col("tags")).alias("data"))


#: Milliseconds that a file can tell apart: its times are signed, of 32 bits.
FLV_MS = 1 << 31
#: Rows of a track that one file holds.
FILE_ROWS = 4096


@query("q_flv_roundtrip", f"WITH {EV}, p AS (SELECT *, (pts - first_value(pts) OVER (PARTITION BY track_id ORDER BY idx)) // 1000 AS ms FROM ev) SELECT track_id::VARCHAR AS source_id, ms * 1000 AS pts_us, is_key, (size % 50 + 1) AS size FROM p")
def _(spark, d):
    """Every event: a track goes on in another file where the time range or the rows of one are used up."""
    whole = Window.partitionBy("track_id").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ev(spark, d).withColumn("ms", F.floor((F.col("pts_us") - F.first("pts_us").over(whole)) / 1000)).withColumns({"n": F.col("size") % 50 + 1, "part": F.floor((F.row_number().over(Window.partitionBy("track_id").orderBy("index")) - 1) / FILE_ROWS)})
    rows = rows.withColumn("segment", F.floor(F.col("ms") / FLV_MS)).withColumn("ms", F.col("ms") - F.col("segment") * FLV_MS)
    place = F.split("source_id", ":")
    start = F.get(place, F.lit(1)).cast("long") * (FLV_MS * 1000)
    return M.flv_tags(_flv_files(rows, "track_id", "segment", "part")).select(F.get(place, F.lit(0)).alias("source_id"), (F.col("pts_us") + start).alias("pts_us"), "is_key", "size")


@query("q_ts_roundtrip", f"WITH {EV}, p AS (SELECT *, (pts // 1000) % 80000000 * 90 AS ticks FROM ev) SELECT track_id::VARCHAR AS source_id, CASE WHEN is_key THEN 256 ELSE 257 END::BIGINT AS pid, CASE WHEN is_key THEN 'video' ELSE 'audio' END AS kind, floor(ticks * 100 / 9::DOUBLE + 0.5)::BIGINT AS pts_us FROM p")
def _(spark, d):
    out = M.ts_pes(M.ts_packets(transport_files(spark, d)))
    return out.select(F.get(F.split("source_id", ":"), F.lit(0)).alias("source_id"), "pid", "kind", "pts_us")


@query("q_wav_roundtrip", "SELECT vec_id::VARCHAR AS source_id, 8000::BIGINT AS rate, 1::BIGINT AS channels, len(embedding)::BIGINT AS frames, floor(len(embedding) * 1000000 / 8000::DOUBLE + 0.5)::BIGINT AS duration_us FROM embeddings")
def _(spark, d):
    rows = vectors(spark, d).select(F.col("vec_id").cast("string").alias("source_id"), F.col("embedding").cast("array<double>").alias("v"))
    files = M.wav_bytes(rows, "v", 8000).select("source_id", F.col("wav").alias("data"))
    return M.wav_tracks(files).select("source_id", "rate", "channels", "frames", "duration_us")


# --- stateful operators, as streams over the table

@query("q_state_record_gate", SQL["q_record_gate"].replace("idx, pts FROM g", "idx, pts AS pts_us FROM g"))
def _(spark, d):
    rows = ev(spark, d, stream=True).withColumnRenamed("index", "idx")
    return rings.replayed(rings.record_gate(rows, "is_key", "is_target"))


@query("q_state_packet_ring", f"""WITH {EV}, g AS (SELECT *, coalesce(sum(is_key::INT) OVER (PARTITION BY track_id ORDER BY pts, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, part ORDER BY pts DESC, idx DESC) AS k, count(*) OVER (PARTITION BY track_id, part) AS size_, bool_or(is_key) OVER (PARTITION BY track_id, part) AS ended FROM g),
o AS (SELECT track_id, part, sum(greatest(0, size_ - 2)) OVER (PARTITION BY track_id ORDER BY part ROWS UNBOUNDED PRECEDING)::BIGINT AS overruns FROM (SELECT DISTINCT track_id, part, size_ FROM n))
SELECT track_id, idx, pts AS pts_us, overruns FROM n JOIN o USING (track_id, part) WHERE ended AND k <= 2""")
def _(spark, d):
    """A ring of two packets that are not due for ten years: the oldest go, and a key sample ends a stretch and lets out what is held."""
    rows = ev(spark, d, stream=True).withColumnRenamed("index", "idx")
    return rings.replayed(rings.packet_ring(rows, capacity=2, delay_us=315_360_000_000_000, ends="is_key")).select("track_id", "idx", "pts_us", "overruns")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
