"""Tracks that are the whole table, cut into ranges, against the same operators on whole tracks; parameter sets as of each slice."""

import random

import pytest
from pyspark.sql import functions as F

from tracklake.functions import bits
from tracklake.operators import buckets
from tracklake.operators import timeline as T

from .test_containers import Writer, escaped


def one_track(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 7]) if i % 50 == 0 else 7, i, rng.randrange(3000), rng.choice([None, 0, 40]), rng.random() < 0.05, rng.random() < 0.1, rng.choice([None, 1, 2])) for i in range(n)]
    rows = [(t, i, x, x, d, k, g, v) for t, i, x, d, k, g, v in rows]
    return spark.createDataFrame(rows, "track_id long, index long, pts_us long, dts_us long, duration_us long, is_key boolean, is_target boolean, value long").repartition(4)


def rows_of(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("per", [13, 100])
def test_ranges_give_what_whole_tracks_give(spark, per):
    rows = one_track(spark).where("track_id is not null")
    for f in (
        lambda p: T.gop_closure(rows, per=p),
        lambda p: T.durations(rows, 5, per=p),
        lambda p: T.non_monotonic(rows, ["dts_us", "index"], "value", per=p),
        lambda p: T.run_lengths(rows, ["track_id"], ["dts_us", "index"], "value", per=p),
    ):
        assert rows_of(f(per)) == rows_of(f(None))


def test_all_carries(spark):
    rows, group, order = one_track(spark, 300, 2), ["track_id"], ["dts_us", "index"]
    kinds = {"sums": {"s": F.col("value")}, "lasts": {"l": F.col("value")}, "before": {"b": F.col("value")}, "after": {"a": F.col("value")}}
    cut = buckets.bucketed(rows, group, order, 20)
    assert rows_of(buckets.over(cut, group, order, **kinds).drop("_bucket")) == rows_of(buckets.over(rows, group, order, **kinds))
    assert max(r["count"] for r in cut.groupBy("_bucket").count().collect()) <= 60
    assert buckets.over(buckets.bucketed(rows.limit(0), group, order, 20), group, order, **kinds).count() == 0


def test_a_window_holds_a_range(spark):
    """No window is over a track alone; what meets for a track is one row for each range."""
    rows = one_track(spark).where("track_id is not null")
    plan = T.gop_closure(rows, per=50)._jdf.queryExecution().optimizedPlan().toString()
    spec = [line for line in plan.splitlines() if "Window [" in line]
    assert spec and all("_bucket" in line for line in spec)


# --- parameter sets


def h264_sps(number, frame_bits):
    return escaped(Writer().u(0x67, 8).u(77, 8).u(0, 8).u(30, 8).ue(number).ue(frame_bits - 4).ue(2).ue(1).u(0, 1).ue(19).ue(10).u(1, 1).u(1, 1).u(0, 1).u(0, 1).bytes())


def h264_pps(number, sps):
    return escaped(Writer().u(0x68, 8).ue(number).ue(sps).u(0, 1).u(0, 1).ue(0).ue(0).ue(0).u(0, 1).u(0, 2).se(0).se(0).se(0).u(0, 1).u(0, 1).u(0, 1).bytes())


def h264_slice(pps, frame, frame_bits):
    return escaped(Writer().u(0x41, 8).ue(0).ue(0).ue(pps).u(frame, frame_bits).u(0, 1).u(0, 1).u(0, 1).se(3).bytes())


@pytest.mark.parametrize("per", [None, 3])
def test_each_slice_has_its_own_sets(spark, per):
    units = [h264_slice(0, 1, 4), h264_sps(0, 4), h264_pps(0, 0), h264_pps(1, 5), h264_slice(0, 9, 4), h264_slice(1, 9, 4), h264_sps(0, 9), h264_slice(0, 300, 9), h264_sps(5, 12), h264_slice(1, 4000, 12), h264_pps(0, 5), h264_slice(0, 3000, 12), b"\x06\x01"]
    rows = spark.createDataFrame([(s, i, bytearray(u)) for s in "ab" for i, u in enumerate(units) if s == "a" or i not in (6, 7)], "source_id string, n int, unit binary").repartition(3)
    slices = bits.with_active_sets(rows, ["source_id"], ["n"], per=per)
    got = {(r.source_id, r.n): (None if r.sps is None else r.f.get("frame_num")) for r in slices.select("source_id", "n", "sps", bits.slice_header(F.col("unit"), F.col("sps"), F.col("pps")).alias("f")).collect()}
    assert got == {("a", 0): None, ("a", 4): 9, ("a", 5): None, ("a", 7): 300, ("a", 9): 4000, ("a", 11): 3000, ("b", 0): None, ("b", 4): 9, ("b", 5): None, ("b", 9): 4000, ("b", 11): 3000}


def test_hevc_sets_by_number(spark):
    pps = lambda number, sps, extra: Writer().u(0, 1).u(34, 6).u(0, 6).u(1, 3).ue(number).ue(sps).u(0, 2).u(extra, 3).u(0, 2).ue(0).ue(0).se(0).u(0, 3).se(0).se(0).u(0, 6).u(0, 1).u(0, 2).ue(0).u(0, 1).bytes()
    slice_ = Writer().u(0, 1).u(1, 6).u(0, 6).u(1, 3).u(1, 1).ue(3).bytes()
    units = [pps(3, 0, 1), slice_, pps(3, 0, 4), slice_]
    rows = spark.createDataFrame([(i, bytearray(u)) for i, u in enumerate(units)], "n int, unit binary").withColumn("s", F.lit(1))
    assert [(r.n, r.pps["num_extra_slice_header_bits"], r.sps) for r in bits.with_active_sets(rows, ["s"], ["n"], "h265").orderBy("n").collect()] == [(1, 1, None), (3, 4, None)]


def test_whole_hevc_slice():
    sps = {"pic_width_in_luma_samples": 640, "pic_height_in_luma_samples": 480, "log2_min_luma_coding_block_size_minus3": 0, "log2_diff_max_min_luma_coding_block_size": 3, "log2_max_pic_order_cnt_lsb_minus4": 4, "chroma_format_idc": 1,
           "num_short_term_ref_pic_sets": 2, "long_term_ref_pics_present_flag": 1, "num_long_term_ref_pics_sps": 2, "used_by_curr_pic_lt_sps_flag[0]": 0, "used_by_curr_pic_lt_sps_flag[1]": 1, "sps_temporal_mvp_enabled_flag": 1, "sample_adaptive_offset_enabled_flag": 1}
    for i, deltas in enumerate(((-1, -3), (-1, -2, 2))):
        bits._told_set(sps, f"short_term_ref_pic_set[{i}]", [(x, 1) for x in deltas])
    pps = {"lists_modification_present_flag": 1, "cabac_init_present_flag": 1, "weighted_bipred_flag": 1, "pps_slice_chroma_qp_offsets_present_flag": 1, "deblocking_filter_override_enabled_flag": 1,
           "pps_loop_filter_across_slices_enabled_flag": 1, "entropy_coding_sync_enabled_flag": 1, "slice_segment_header_extension_present_flag": 1, "num_extra_slice_header_bits": 2}
    w = Writer().u(0, 1).u(1, 6).u(0, 6).u(1, 3).u(0, 1).ue(0).u(50, 7).u(0, 2).ue(0).u(200, 8)  # address of ten times eight blocks, a B slice
    w.u(0, 1).u(1, 1).ue(0).u(1, 1).ue(0)  # inline, as a change of the last set by -1
    w.u(1, 1).u(0, 1).u(1, 1).u(1, 1).u(0, 1).u(0, 1)  # -2 used, -3 known but unused, 1 used, -1 neither
    w.ue(1).ue(1).u(1, 1).u(0, 1).u(77, 8).u(1, 1).u(1, 1).ue(5)  # long-term: one of the sequence set (used), one of its own
    w.u(1, 1).u(1, 1).u(0, 1).u(1, 1).ue(1).ue(0)  # motion vectors of other pictures, SAO of luma, two and one references
    w.u(1, 1).u(2, 2).u(3, 2).u(0, 1)  # list 0 in another order, of four pictures
    w.u(1, 1).u(0, 1).u(1, 1).ue(1)  # mvd_l1_zero, cabac_init, collocated from list 0, its second
    w.ue(3).se(-1).u(1, 1).u(0, 1).u(0, 1).u(1, 1).se(4).se(-5).se(1).se(2).se(3).se(4).u(0, 1).u(0, 1)  # weights: flags of list 0 first, then values
    w.ue(2).se(-7).se(1).se(-1).u(1, 1).u(0, 1).se(2).se(-2).u(1, 1)
    w.ue(2).ue(4).u(9, 5).u(31, 5).ue(0)
    f = bits.parse(escaped(w.bytes()), bits.hevc_slice_steps(sps, pps))
    assert [(f[f"slice_ref_pic_set.delta_poc[{i}]"], f[f"slice_ref_pic_set.used_by_curr_pic_flag[{i}]"]) for i in range(3)] == [(-2, 1), (-3, 0), (1, 1)]
    assert (f["slice_segment_address"], f["slice_type"], f["poc_lsb_lt[1]"], f["delta_poc_msb_cycle_lt[1]"], f["list_entry_l0[1]"], f["collocated_ref_idx"]) == (50, 0, 77, 5, 3, 1)
    assert (f["delta_luma_weight_l0[0]"], f["luma_offset_l0[0]"], f["delta_chroma_weight_l0[1][1]"], f["delta_chroma_offset_l0[1][1]"], f["five_minus_max_num_merge_cand"]) == (4, -5, 3, 4, 2)
    assert (f["slice_qp_delta"], f["slice_cr_qp_offset"], f["slice_tc_offset_div2"], f["slice_loop_filter_across_slices_enabled_flag"], f["entry_point_offset_minus1[1]"], f["slice_segment_header_extension_length"]) == (-7, -1, -2, 1, 31, 0)
    assert list(bits.parse(escaped(w.bytes()), bits.hevc_slice_steps({}, {})))[-1] == "slice_pic_parameter_set_id"


def test_picture_set_with_slice_groups():
    for kind, extra in ((0, lambda w: w.ue(3).ue(4)), (2, lambda w: w.ue(1).ue(9)), (4, lambda w: w.u(1, 1).ue(6)), (6, lambda w: w.ue(2).u(1, 1).u(0, 1).u(1, 1)), (1, lambda w: w)):
        w = extra(Writer().u(0x68, 8).ue(1).ue(0).u(1, 1).u(0, 1).ue(1).ue(kind))
        f = bits.parse(escaped(w.ue(2).ue(3).u(1, 1).u(2, 2).se(-4).se(0).se(0).u(1, 1).u(0, 1).u(1, 1).bytes()), bits.PPS)
        assert (f["slice_group_map_type"], f["num_ref_idx_l0_default_active_minus1"], f["num_ref_idx_l1_default_active_minus1"], f["weighted_bipred_idc"], f["pic_init_qp_minus26"], f["redundant_pic_cnt_present_flag"]) == (kind, 2, 3, 2, -4, 1)


def test_monochrome_crop():
    w = Writer().u(0x67, 8).u(100, 8).u(0, 8).u(30, 8).ue(0).ue(0).ue(0).ue(0).u(0, 1).u(0, 1).ue(0).ue(0).ue(2).ue(3).u(0, 1).ue(19).ue(10).u(1, 1).u(1, 1).u(1, 1).ue(0).ue(3).ue(1).ue(2).u(0, 1)
    f = bits.parse(escaped(w.bytes()), bits.SPS)
    assert (f["width"], f["height"]) == (320 - 3, 176 - 3)
