"""Headers of H.264 and H.265 units, described as lists of fields and read bit by bit in tasks.

A syntax is a list of steps: (name, kind) or (name, kind, condition). A kind is a number of bits, ``ue`` or ``se`` for Exp-Golomb codes, or a function of
the reader and the fields so far for what repeats. A condition is a function of the fields so far. :func:`header` runs one over a column of units and gives a
map of field to number; a unit that ends early has the fields before its end. Fields of lists carry their place, as in ``offset_for_ref_frame[2]``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fields = dict[str, int]


class Ended(Exception):
    """The unit has no more bits."""


class Bits:
    """Bits of a unit, the most significant first; ``at`` counts them."""

    def __init__(self, data: bytes) -> None:
        self.number, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def u(self, n: int) -> int:
        if self.at + n > self.size:
            raise Ended
        self.at += n
        return (self.number >> (self.size - self.at)) & ((1 << n) - 1)

    def ue(self) -> int:
        left = self.size - self.at
        zeros = left - (self.number & ((1 << left) - 1)).bit_length()
        if zeros > 32 or zeros >= left:
            self.at = min(self.size, self.at + 33)
            raise Ended
        self.at += zeros
        return self.u(zeros + 1) - 1

    def se(self) -> int:
        n = self.ue()
        return (n + 1) // 2 if n % 2 else -(n // 2)

    def read(self, steps: list[tuple], f: Fields) -> None:
        for name, kind, *condition in steps:
            if condition and not condition[0](f):
                continue
            if callable(kind):
                kind(self, f)
            else:
                f[name] = self.u(kind) if isinstance(kind, int) else self.ue() if kind == "ue" else self.se()


def unescaped(data: bytes) -> bytes:
    """A unit without its emulation prevention bytes: 03 after 00 00."""
    out, at = [], 0
    while (found := data.find(b"\0\0\3", at)) >= 0:
        out.append(data[at : found + 2])
        at = found + 3
    return b"".join([*out, data[at:]])


def _on(name: str) -> Callable[[Fields], bool]:
    return lambda f: bool(f.get(name))


def _off(name: str) -> Callable[[Fields], bool]:
    return lambda f: not f.get(name)


def _given(name: str, steps: list[tuple]) -> list[tuple]:
    """Steps that are there if a flag is set."""
    both = lambda condition: lambda f: bool(f.get(name)) and condition(f)
    return [(k, kind, both(*condition) if condition else _on(name)) for k, kind, *condition in steps]


def _each(count: Callable[[Fields], int], steps: list[tuple]) -> Callable[[Bits, Fields], None]:
    """Steps that repeat, their names followed by [place]."""

    def run(b: Bits, f: Fields) -> None:
        for i in range(min(count(f), 256)):
            own: Fields = {}
            try:
                b.read(steps, own)
            finally:
                f.update({f"{k}[{i}]": v for k, v in own.items()})

    return run


# --- H.264

NAL = [("forbidden_zero_bit", 1), ("nal_ref_idc", 2), ("nal_unit_type", 5)]
# Profiles whose parameter sets tell the chroma format.
HIGH = {44, 83, 86, 100, 110, 118, 122, 128, 134, 138, 139, 244}


def _scaling(b: Bits, f: Fields) -> None:
    for i in range(12 if f["chroma_format_idc"] == 3 else 8):
        if b.u(1):
            last = following = 8
            for _ in range(16 if i < 6 else 64):
                if following:
                    following = (last + b.se()) % 256
                last = following or last


_HRD = [
    ("cpb_cnt_minus1", "ue"), ("bit_rate_scale", 4), ("cpb_size_scale", 4),
    ("cpb", _each(lambda f: f["cpb_cnt_minus1"] + 1, [("bit_rate_value_minus1", "ue"), ("cpb_size_value_minus1", "ue"), ("cbr_flag", 1)])),
    ("initial_cpb_removal_delay_length_minus1", 5), ("cpb_removal_delay_length_minus1", 5), ("dpb_output_delay_length_minus1", 5), ("time_offset_length", 5),
]


def _hrd(prefix: str) -> Callable[[Bits, Fields], None]:
    def run(b: Bits, f: Fields) -> None:
        own: Fields = {}
        try:
            b.read(_HRD, own)
        finally:
            f.update({f"{prefix}.{k}": v for k, v in own.items()})

    return run


_SIGNAL = [
    ("aspect_ratio_info_present_flag", 1), ("aspect_ratio_idc", 8, _on("aspect_ratio_info_present_flag")),
    ("sar_width", 16, lambda f: f.get("aspect_ratio_idc") == 255), ("sar_height", 16, lambda f: f.get("aspect_ratio_idc") == 255),
    ("overscan_info_present_flag", 1), ("overscan_appropriate_flag", 1, _on("overscan_info_present_flag")),
    ("video_signal_type_present_flag", 1), ("video_format", 3, _on("video_signal_type_present_flag")),
    ("video_full_range_flag", 1, _on("video_signal_type_present_flag")), ("colour_description_present_flag", 1, _on("video_signal_type_present_flag")),
    ("colour_primaries", 8, _on("colour_description_present_flag")), ("transfer_characteristics", 8, _on("colour_description_present_flag")),
    ("matrix_coefficients", 8, _on("colour_description_present_flag")),
    ("chroma_loc_info_present_flag", 1), ("chroma_sample_loc_type_top_field", "ue", _on("chroma_loc_info_present_flag")),
    ("chroma_sample_loc_type_bottom_field", "ue", _on("chroma_loc_info_present_flag")),
]
_VUI = [
    *_SIGNAL, ("timing_info_present_flag", 1), ("num_units_in_tick", 32, _on("timing_info_present_flag")), ("time_scale", 32, _on("timing_info_present_flag")),
    ("fixed_frame_rate_flag", 1, _on("timing_info_present_flag")),
    ("nal_hrd_parameters_present_flag", 1), ("nal_hrd", _hrd("nal_hrd"), _on("nal_hrd_parameters_present_flag")),
    ("vcl_hrd_parameters_present_flag", 1), ("vcl_hrd", _hrd("vcl_hrd"), _on("vcl_hrd_parameters_present_flag")),
    ("low_delay_hrd_flag", 1, lambda f: f["nal_hrd_parameters_present_flag"] or f["vcl_hrd_parameters_present_flag"]),
    ("pic_struct_present_flag", 1), ("bitstream_restriction_flag", 1), ("motion_vectors_over_pic_boundaries_flag", 1, _on("bitstream_restriction_flag")),
    ("max_bytes_per_pic_denom", "ue", _on("bitstream_restriction_flag")), ("max_bits_per_mb_denom", "ue", _on("bitstream_restriction_flag")),
    ("log2_max_mv_length_horizontal", "ue", _on("bitstream_restriction_flag")), ("log2_max_mv_length_vertical", "ue", _on("bitstream_restriction_flag")),
    ("max_num_reorder_frames", "ue", _on("bitstream_restriction_flag")), ("max_dec_frame_buffering", "ue", _on("bitstream_restriction_flag")),
]


def _crop(b: Bits | None, f: Fields) -> None:
    """Width and height of what is shown; reads nothing, and takes columns of numbers as well."""
    chroma, lines = f.get("chroma_format_idc", 1), 2 - f["frame_mbs_only_flag"]
    across, down = 1 + ((chroma != 0) & (chroma != 3)), 1 + ((chroma != 0) & (chroma != 3) & (chroma != 2))
    crop = lambda *names: sum(f.get(f"frame_crop_{n}_offset", 0) for n in names)
    f["width"] = (f["pic_width_in_mbs_minus1"] + 1) * 16 - crop("left", "right") * across
    f["height"] = (f["pic_height_in_map_units_minus1"] + 1) * lines * 16 - crop("top", "bottom") * down * lines


_HIGH = lambda f: f["profile_idc"] in HIGH
SPS = [
    *NAL, ("profile_idc", 8), ("constraint_flags", 8), ("level_idc", 8), ("seq_parameter_set_id", "ue"),
    ("chroma_format_idc", "ue", _HIGH), ("separate_colour_plane_flag", 1, lambda f: f.get("chroma_format_idc") == 3),
    ("bit_depth_luma_minus8", "ue", _HIGH), ("bit_depth_chroma_minus8", "ue", _HIGH), ("qpprime_y_zero_transform_bypass_flag", 1, _HIGH),
    ("seq_scaling_matrix_present_flag", 1, _HIGH), ("scaling", _scaling, _on("seq_scaling_matrix_present_flag")),
    ("log2_max_frame_num_minus4", "ue"), ("pic_order_cnt_type", "ue"), ("log2_max_pic_order_cnt_lsb_minus4", "ue", _off("pic_order_cnt_type")),
    ("delta_pic_order_always_zero_flag", 1, lambda f: f["pic_order_cnt_type"] == 1), ("offset_for_non_ref_pic", "se", lambda f: f["pic_order_cnt_type"] == 1),
    ("offset_for_top_to_bottom_field", "se", lambda f: f["pic_order_cnt_type"] == 1), ("num_ref_frames_in_pic_order_cnt_cycle", "ue", lambda f: f["pic_order_cnt_type"] == 1),
    ("offsets", _each(lambda f: f.get("num_ref_frames_in_pic_order_cnt_cycle", 0), [("offset_for_ref_frame", "se")])),
    ("max_num_ref_frames", "ue"), ("gaps_in_frame_num_allowed_flag", 1), ("pic_width_in_mbs_minus1", "ue"), ("pic_height_in_map_units_minus1", "ue"),
    ("frame_mbs_only_flag", 1), ("mb_adaptive_frame_field_flag", 1, _off("frame_mbs_only_flag")), ("direct_8x8_inference_flag", 1),
    ("frame_cropping_flag", 1), *[(f"frame_crop_{side}_offset", "ue", _on("frame_cropping_flag")) for side in ("left", "right", "top", "bottom")],
    ("size", _crop), ("vui_parameters_present_flag", 1), *_given("vui_parameters_present_flag", _VUI),
]


def _slice_groups(b: Bits, f: Fields) -> None:
    """Which macroblocks belong to which slice group, read over but for the kind of map."""
    groups = f["num_slice_groups_minus1"]
    f["slice_group_map_type"] = kind = b.ue()
    if kind == 0:
        f.update({f"run_length_minus1[{i}]": b.ue() for i in range(groups + 1)})
    elif kind == 2:
        for i in range(groups):
            f[f"top_left[{i}]"], f[f"bottom_right[{i}]"] = b.ue(), b.ue()
    elif kind in (3, 4, 5):
        f["slice_group_change_direction_flag"], f["slice_group_change_rate_minus1"] = b.u(1), b.ue()
    elif kind == 6:
        f["pic_size_in_map_units_minus1"] = count = b.ue()
        b.u((count + 1) * groups.bit_length())


PPS = [
    *NAL, ("pic_parameter_set_id", "ue"), ("seq_parameter_set_id", "ue"), ("entropy_coding_mode_flag", 1),
    ("bottom_field_pic_order_in_frame_present_flag", 1), ("num_slice_groups_minus1", "ue"), ("groups", _slice_groups, _on("num_slice_groups_minus1")),
    ("num_ref_idx_l0_default_active_minus1", "ue"), ("num_ref_idx_l1_default_active_minus1", "ue"), ("weighted_pred_flag", 1), ("weighted_bipred_idc", 2),
    ("pic_init_qp_minus26", "se"), ("pic_init_qs_minus26", "se"), ("chroma_qp_index_offset", "se"), ("deblocking_filter_control_present_flag", 1),
    ("constrained_intra_pred_flag", 1), ("redundant_pic_cnt_present_flag", 1),
]


def _modifications(suffix: str) -> Callable[[Bits, Fields], None]:
    def run(b: Bits, f: Fields) -> None:
        for i in range(100):
            f[f"modification_of_pic_nums_idc{suffix}[{i}]"] = kind = b.ue()
            if kind > 2:
                return
            f[f"{'abs_diff_pic_num_minus1' if kind < 2 else 'long_term_pic_num'}{suffix}[{i}]"] = b.ue()

    return run


def _marking(b: Bits, f: Fields) -> None:
    for i in range(100):
        f[f"memory_management_control_operation[{i}]"] = op = b.ue()
        for name, ops in (("difference_of_pic_nums_minus1", (1, 3)), ("long_term_pic_num", (2,)), ("long_term_frame_idx", (3, 6)), ("max_long_term_frame_idx_plus1", (4,))):
            if op in ops:
                f[f"{name}[{i}]"] = b.ue()
        if not op:
            return


def weights(b: Bits, f: Fields, lists: dict[str, int], chroma: bool) -> None:
    """Weights of predicted pictures: for each list so many references."""
    f["luma_log2_weight_denom"] = b.ue()
    if chroma:
        f["chroma_log2_weight_denom"] = b.ue()
    for name, count in lists.items():
        for i in range(count):
            f[f"luma_weight_{name}_flag[{i}]"] = flag = b.u(1)
            if flag:
                f[f"luma_weight_{name}[{i}]"], f[f"luma_offset_{name}[{i}]"] = b.se(), b.se()
            if chroma:
                f[f"chroma_weight_{name}_flag[{i}]"] = flag = b.u(1)
                for j in range(2 if flag else 0):
                    f[f"chroma_weight_{name}[{i}][{j}]"], f[f"chroma_offset_{name}[{i}][{j}]"] = b.se(), b.se()


def _slice_kind(*kinds: int) -> Callable[[Fields], bool]:
    return lambda f: f["slice_type"] % 5 in kinds


def slice_steps(sps: Fields, pps: Fields) -> list[tuple]:
    """The header of a slice under its parameter sets; without a sequence set only its first three fields."""
    first = [*NAL, ("first_mb_in_slice", "ue"), ("slice_type", "ue"), ("pic_parameter_set_id", "ue")]
    if not sps:
        return first
    order, idr = sps.get("pic_order_cnt_type", 0), lambda f: f["nal_unit_type"] == 5
    both = pps.get("bottom_field_pic_order_in_frame_present_flag")
    cabac, weighted, bipred = (pps.get(k, 0) for k in ("entropy_coding_mode_flag", "weighted_pred_flag", "weighted_bipred_idc"))
    chroma = not sps.get("separate_colour_plane_flag") and sps.get("chroma_format_idc", 1) != 0
    refs = lambda f, k: f.get(f"num_ref_idx_{k}_active_minus1", pps.get(f"num_ref_idx_{k}_default_active_minus1", 0)) + 1
    is_weighted = lambda f: (weighted and f["slice_type"] % 5 in (0, 3)) or (bipred == 1 and f["slice_type"] % 5 == 1)
    return [
        *first, ("colour_plane_id", 2, lambda f: sps.get("separate_colour_plane_flag")), ("frame_num", sps.get("log2_max_frame_num_minus4", 0) + 4),
        ("field_pic_flag", 1, lambda f: not sps.get("frame_mbs_only_flag", 1)), ("bottom_field_flag", 1, _on("field_pic_flag")), ("idr_pic_id", "ue", idr),
        ("pic_order_cnt_lsb", sps.get("log2_max_pic_order_cnt_lsb_minus4", 0) + 4, lambda f: order == 0),
        ("delta_pic_order_cnt_bottom", "se", lambda f: order == 0 and both and not f.get("field_pic_flag")),
        ("delta_pic_order_cnt_0", "se", lambda f: order == 1 and not sps.get("delta_pic_order_always_zero_flag")),
        ("delta_pic_order_cnt_1", "se", lambda f: "delta_pic_order_cnt_0" in f and both and not f.get("field_pic_flag")),
        ("redundant_pic_cnt", "ue", lambda f: pps.get("redundant_pic_cnt_present_flag")), ("direct_spatial_mv_pred_flag", 1, _slice_kind(1)),
        ("num_ref_idx_active_override_flag", 1, _slice_kind(0, 1, 3)), ("num_ref_idx_l0_active_minus1", "ue", _on("num_ref_idx_active_override_flag")),
        ("num_ref_idx_l1_active_minus1", "ue", lambda f: f.get("num_ref_idx_active_override_flag") and f["slice_type"] % 5 == 1),
        ("ref_pic_list_modification_flag_l0", 1, _slice_kind(0, 1, 3)), ("l0", _modifications(""), _on("ref_pic_list_modification_flag_l0")),
        ("ref_pic_list_modification_flag_l1", 1, _slice_kind(1)), ("l1", _modifications("_l1"), _on("ref_pic_list_modification_flag_l1")),
        ("weights", lambda b, f: weights(b, f, {k: refs(f, k) for k in (("l0", "l1") if f["slice_type"] % 5 == 1 else ("l0",))}, chroma), is_weighted),
        ("no_output_of_prior_pics_flag", 1, lambda f: f["nal_ref_idc"] and idr(f)), ("long_term_reference_flag", 1, lambda f: f["nal_ref_idc"] and idr(f)),
        ("adaptive_ref_pic_marking_mode_flag", 1, lambda f: f["nal_ref_idc"] and not idr(f)), ("marking", _marking, _on("adaptive_ref_pic_marking_mode_flag")),
        ("cabac_init_idc", "ue", lambda f: cabac and f["slice_type"] % 5 in (0, 1, 3)), ("slice_qp_delta", "se"),
        ("sp_for_switch_flag", 1, _slice_kind(3)), ("slice_qs_delta", "se", _slice_kind(3, 4)),
        ("disable_deblocking_filter_idc", "ue", lambda f: pps.get("deblocking_filter_control_present_flag", 1)),
        ("slice_alpha_c0_offset_div2", "se", lambda f: f.get("disable_deblocking_filter_idc", 1) != 1),
        ("slice_beta_offset_div2", "se", lambda f: f.get("disable_deblocking_filter_idc", 1) != 1),
    ]


# --- H.265

HEVC_NAL = [("forbidden_zero_bit", 1), ("nal_unit_type", 6), ("nuh_layer_id", 6), ("nuh_temporal_id_plus1", 3)]
PROFILE = [
    ("general_profile_space", 2), ("general_tier_flag", 1), ("general_profile_idc", 5), ("general_profile_compatibility_flags", 32),
    ("general_progressive_source_flag", 1), ("general_interlaced_source_flag", 1), ("general_non_packed_constraint_flag", 1),
    ("general_frame_only_constraint_flag", 1), ("general_reserved_bits", 43), ("general_inbld_flag", 1), ("general_level_idc", 8),
]


def _sub_layers(prefix: str) -> Callable[[Bits, Fields], None]:
    """Flags and levels of lower temporal layers, which the format writes after the general level."""

    def run(b: Bits, f: Fields) -> None:
        count = f[f"{prefix}_max_sub_layers_minus1"]
        flags = [(b.u(1), b.u(1)) for _ in range(count)]
        b.u(2 * (8 - count) if count else 0)
        for profile, level in flags:
            b.u(88 * profile)
            b.u(8 * level)

    return run


def _ordering(prefix: str) -> Callable[[Bits, Fields], None]:
    def run(b: Bits, f: Fields) -> None:
        last = f[f"{prefix}_max_sub_layers_minus1"]
        for i in range(0 if f[f"{prefix}_sub_layer_ordering_info_present_flag"] else last, last + 1):
            for name in ("max_dec_pic_buffering_minus1", "max_num_reorder_pics", "max_latency_increase_plus1"):
                f[f"{prefix}_{name}[{i}]"] = b.ue()

    return run


VPS = [
    *HEVC_NAL, ("vps_video_parameter_set_id", 4), ("vps_base_layer_internal_flag", 1), ("vps_base_layer_available_flag", 1), ("vps_max_layers_minus1", 6),
    ("vps_max_sub_layers_minus1", 3), ("vps_temporal_id_nesting_flag", 1), ("vps_reserved_0xffff_16bits", 16), *PROFILE, ("layers", _sub_layers("vps")),
    ("vps_sub_layer_ordering_info_present_flag", 1), ("ordering", _ordering("vps")), ("vps_max_layer_id", 6), ("vps_num_layer_sets_minus1", "ue"),
    ("sets", lambda b, f: [b.u(f["vps_max_layer_id"] + 1) for _ in range(min(f["vps_num_layer_sets_minus1"], 1024))]),
    ("vps_timing_info_present_flag", 1), ("vps_num_units_in_tick", 32, _on("vps_timing_info_present_flag")), ("vps_time_scale", 32, _on("vps_timing_info_present_flag")),
    ("vps_poc_proportional_to_timing_flag", 1, _on("vps_timing_info_present_flag")), ("vps_num_ticks_poc_diff_one_minus1", "ue", _on("vps_poc_proportional_to_timing_flag")),
    ("vps_num_hrd_parameters", "ue", _on("vps_timing_info_present_flag")), ("vps_extension_flag", 1, _off("vps_num_hrd_parameters")),
]


def _hevc_crop(b: Bits | None, f: Fields) -> None:
    """Width and height of what is shown; reads nothing, and takes columns of numbers as well."""
    chroma = f["chroma_format_idc"]
    across, down = 1 + ((chroma == 1) | (chroma == 2)), 1 + (chroma == 1)
    crop = lambda *names: sum(f.get(f"conf_win_{n}_offset", 0) for n in names)
    f["width"] = f["pic_width_in_luma_samples"] - crop("left", "right") * across
    f["height"] = f["pic_height_in_luma_samples"] - crop("top", "bottom") * down


def _hevc_scaling(b: Bits, f: Fields) -> None:
    """Scaling lists, read over: four sizes, of the largest only every third."""
    for size in range(4):
        for _ in range(0, 6, 3 if size == 3 else 1):
            if not b.u(1):
                b.ue()
                continue
            if size > 1:
                b.se()
            for _ in range(min(64, 1 << (4 + 2 * size))):
                b.se()


Pocs = list[tuple[int, int]]


def _reference_set(b: Bits, known: list[Pocs], in_slice: bool = False) -> Pocs:
    """(difference of order, whether it is used) of one set of short-term reference pictures, the nearest first, those before the picture before those after it.

    It may be written as a change of a set that is known: the last one, or in a slice one so many back.
    """
    if known and b.u(1):
        back = b.ue() if in_slice else 0
        delta = (1 - 2 * b.u(1)) * (b.ue() + 1)
        base, flags = known[max(0, len(known) - 1 - back)], []
        for _ in range(len(base) + 1):
            used = b.u(1)
            flags.append((used, 1 if used else b.u(1)))
        steps = [x + delta for x, _ in base] + [delta]
        found = [(x, used) for x, (used, take) in zip(steps, flags, strict=True) if take and x]
    else:
        sizes, found = (b.ue(), b.ue()), []
        for sign, n in zip((-1, 1), sizes, strict=True):
            at = 0
            for _ in range(min(n, 16)):
                at += sign * (b.ue() + 1)
                found.append((at, b.u(1)))
    return sorted((x for x in found if x[0] < 0), reverse=True) + sorted(x for x in found if x[0] > 0)


def _told_set(f: Fields, name: str, pocs: Pocs) -> None:
    down = sum(x < 0 for x, _ in pocs)
    f[f"{name}.num_negative_pics"], f[f"{name}.num_positive_pics"] = down, len(pocs) - down
    for j, (x, used) in enumerate(pocs):
        f[f"{name}.delta_poc[{j}]"], f[f"{name}.used_by_curr_pic_flag[{j}]"] = x, used


def _known_set(f: Fields, i: int) -> Pocs:
    name = f"short_term_ref_pic_set[{i}]"
    count = f.get(f"{name}.num_negative_pics", 0) + f.get(f"{name}.num_positive_pics", 0)
    return [(f[f"{name}.delta_poc[{j}]"], f[f"{name}.used_by_curr_pic_flag[{j}]"]) for j in range(count)]


def _reference_sets(b: Bits, f: Fields) -> None:
    """Short-term reference picture sets; one may be written as a change of the set before it."""
    sets: list[Pocs] = []
    for i in range(min(f["num_short_term_ref_pic_sets"], 64)):
        sets.append(_reference_set(b, sets))
        _told_set(f, f"short_term_ref_pic_set[{i}]", sets[-1])


def _long_term_sets(b: Bits, f: Fields) -> None:
    for i in range(min(f["num_long_term_ref_pics_sps"], 32)):
        f[f"lt_ref_pic_poc_lsb_sps[{i}]"], f[f"used_by_curr_pic_lt_sps_flag[{i}]"] = b.u(f["log2_max_pic_order_cnt_lsb_minus4"] + 4), b.u(1)


_HEVC_VUI = [
    *_SIGNAL, ("neutral_chroma_indication_flag", 1), ("field_seq_flag", 1), ("frame_field_info_present_flag", 1), ("default_display_window_flag", 1),
    *[(f"def_disp_win_{side}_offset", "ue", _on("default_display_window_flag")) for side in ("left", "right", "top", "bottom")],
    ("vui_timing_info_present_flag", 1), ("num_units_in_tick", 32, _on("vui_timing_info_present_flag")), ("time_scale", 32, _on("vui_timing_info_present_flag")),
    ("vui_poc_proportional_to_timing_flag", 1, _on("vui_timing_info_present_flag")), ("vui_num_ticks_poc_diff_one_minus1", "ue", _on("vui_poc_proportional_to_timing_flag")),
    ("vui_hrd_parameters_present_flag", 1, _on("vui_timing_info_present_flag")),
]
HEVC_SPS = [
    *HEVC_NAL, ("sps_video_parameter_set_id", 4), ("sps_max_sub_layers_minus1", 3), ("sps_temporal_id_nesting_flag", 1), *PROFILE, ("layers", _sub_layers("sps")),
    ("sps_seq_parameter_set_id", "ue"), ("chroma_format_idc", "ue"), ("separate_colour_plane_flag", 1, lambda f: f["chroma_format_idc"] == 3),
    ("pic_width_in_luma_samples", "ue"), ("pic_height_in_luma_samples", "ue"), ("conformance_window_flag", 1),
    *[(f"conf_win_{side}_offset", "ue", _on("conformance_window_flag")) for side in ("left", "right", "top", "bottom")], ("size", _hevc_crop),
    ("bit_depth_luma_minus8", "ue"), ("bit_depth_chroma_minus8", "ue"), ("log2_max_pic_order_cnt_lsb_minus4", "ue"),
    ("sps_sub_layer_ordering_info_present_flag", 1), ("ordering", _ordering("sps")), ("log2_min_luma_coding_block_size_minus3", "ue"),
    ("log2_diff_max_min_luma_coding_block_size", "ue"), ("log2_min_luma_transform_block_size_minus2", "ue"), ("log2_diff_max_min_luma_transform_block_size", "ue"),
    ("max_transform_hierarchy_depth_inter", "ue"), ("max_transform_hierarchy_depth_intra", "ue"), ("scaling_list_enabled_flag", 1),
    ("sps_scaling_list_data_present_flag", 1, _on("scaling_list_enabled_flag")), ("scaling", _hevc_scaling, _on("sps_scaling_list_data_present_flag")),
    ("amp_enabled_flag", 1), ("sample_adaptive_offset_enabled_flag", 1), ("pcm_enabled_flag", 1), ("pcm_sample_bit_depth_luma_minus1", 4, _on("pcm_enabled_flag")),
    ("pcm_sample_bit_depth_chroma_minus1", 4, _on("pcm_enabled_flag")), ("log2_min_pcm_luma_coding_block_size_minus3", "ue", _on("pcm_enabled_flag")),
    ("log2_diff_max_min_pcm_luma_coding_block_size", "ue", _on("pcm_enabled_flag")), ("pcm_loop_filter_disabled_flag", 1, _on("pcm_enabled_flag")),
    ("num_short_term_ref_pic_sets", "ue"), ("sets", _reference_sets), ("long_term_ref_pics_present_flag", 1),
    ("num_long_term_ref_pics_sps", "ue", _on("long_term_ref_pics_present_flag")),
    ("long_term", _long_term_sets, _on("long_term_ref_pics_present_flag")),
    ("sps_temporal_mvp_enabled_flag", 1), ("strong_intra_smoothing_enabled_flag", 1), ("vui_parameters_present_flag", 1),
    *_given("vui_parameters_present_flag", _HEVC_VUI),
]
HEVC_PPS = [
    *HEVC_NAL, ("pps_pic_parameter_set_id", "ue"), ("pps_seq_parameter_set_id", "ue"), ("dependent_slice_segments_enabled_flag", 1), ("output_flag_present_flag", 1),
    ("num_extra_slice_header_bits", 3), ("sign_data_hiding_enabled_flag", 1), ("cabac_init_present_flag", 1), ("num_ref_idx_l0_default_active_minus1", "ue"),
    ("num_ref_idx_l1_default_active_minus1", "ue"), ("init_qp_minus26", "se"), ("constrained_intra_pred_flag", 1), ("transform_skip_enabled_flag", 1),
    ("cu_qp_delta_enabled_flag", 1), ("diff_cu_qp_delta_depth", "ue", _on("cu_qp_delta_enabled_flag")), ("pps_cb_qp_offset", "se"), ("pps_cr_qp_offset", "se"),
    ("pps_slice_chroma_qp_offsets_present_flag", 1), ("weighted_pred_flag", 1), ("weighted_bipred_flag", 1), ("transquant_bypass_enabled_flag", 1),
    ("tiles_enabled_flag", 1), ("entropy_coding_sync_enabled_flag", 1), ("num_tile_columns_minus1", "ue", _on("tiles_enabled_flag")),
    ("num_tile_rows_minus1", "ue", _on("tiles_enabled_flag")), ("uniform_spacing_flag", 1, _on("tiles_enabled_flag")),
    ("tiles", _each(lambda f: 0 if f.get("uniform_spacing_flag", 1) else f["num_tile_columns_minus1"] + f["num_tile_rows_minus1"], [("tile_size_minus1", "ue")])),
    ("loop_filter_across_tiles_enabled_flag", 1, _on("tiles_enabled_flag")), ("pps_loop_filter_across_slices_enabled_flag", 1),
    ("deblocking_filter_control_present_flag", 1), ("deblocking_filter_override_enabled_flag", 1, _on("deblocking_filter_control_present_flag")),
    ("pps_deblocking_filter_disabled_flag", 1, _on("deblocking_filter_control_present_flag")),
    ("pps_beta_offset_div2", "se", lambda f: f.get("pps_deblocking_filter_disabled_flag") == 0),
    ("pps_tc_offset_div2", "se", lambda f: f.get("pps_deblocking_filter_disabled_flag") == 0),
    ("pps_scaling_list_data_present_flag", 1), ("scaling", _hevc_scaling, _on("pps_scaling_list_data_present_flag")),
    ("lists_modification_present_flag", 1), ("log2_parallel_merge_level_minus2", "ue"), ("slice_segment_header_extension_present_flag", 1),
]


_B, _P = 0, 1  # kinds of slices that are predicted


def _hevc_weights(b: Bits, f: Fields, lists: dict[str, int], chroma: bool) -> None:
    """Weights of predicted pictures: for each list first all flags, then the differences."""
    f["luma_log2_weight_denom"] = b.ue()
    if chroma:
        f["delta_chroma_log2_weight_denom"] = b.se()
    for name, count in lists.items():
        for part in ("luma", *["chroma"] * chroma):
            f.update({f"{part}_weight_{name}_flag[{i}]": b.u(1) for i in range(count)})
        for i in range(count):
            if f[f"luma_weight_{name}_flag[{i}]"]:
                f[f"delta_luma_weight_{name}[{i}]"], f[f"luma_offset_{name}[{i}]"] = b.se(), b.se()
            for j in range(2 if f.get(f"chroma_weight_{name}_flag[{i}]") else 0):
                f[f"delta_chroma_weight_{name}[{i}][{j}]"], f[f"delta_chroma_offset_{name}[{i}][{j}]"] = b.se(), b.se()


def hevc_slice_steps(sps: Fields, pps: Fields) -> list[tuple]:
    """The header of a slice segment under its parameter sets; without a sequence set only what comes before fields that depend on it."""
    block = sps.get("log2_min_luma_coding_block_size_minus3", 0) + 3 + sps.get("log2_diff_max_min_luma_coding_block_size", 1)
    across, down = (-(-sps.get(f"pic_{side}_in_luma_samples", n) >> block) for side, n in (("width", 1920), ("height", 1080)))
    chroma = bool(sps.get("chroma_format_idc", 1)) and not sps.get("separate_colour_plane_flag")
    order, long_sets, count = sps.get("log2_max_pic_order_cnt_lsb_minus4", 4) + 4, sps.get("num_long_term_ref_pics_sps", 0), sps.get("num_short_term_ref_pic_sets", 0)
    own = lambda f: not f.get("dependent_slice_segment_flag")
    moves = lambda f: own(f) and f["nal_unit_type"] not in (19, 20)
    predicted = lambda f: own(f) and f["slice_type"] in (_B, _P)
    both = lambda f: own(f) and f["slice_type"] == _B
    refs = lambda f, k: f.get(f"num_ref_idx_{k}_active_minus1", pps.get(f"num_ref_idx_{k}_default_active_minus1", 0)) + 1
    lists = lambda f: ("l0", "l1") if f["slice_type"] == _B else ("l0",)

    def inline(b: Bits, f: Fields) -> None:
        _told_set(f, "slice_ref_pic_set", _reference_set(b, [_known_set(sps, i) for i in range(count)], in_slice=True))

    def long_term(b: Bits, f: Fields) -> None:
        from_sps = f["num_long_term_sps"] = b.ue() if long_sets else 0
        f["num_long_term_pics"] = b.ue()
        for i in range(min(from_sps + f["num_long_term_pics"], 33)):
            if i < from_sps:
                f[f"lt_idx_sps[{i}]"] = k = b.u((long_sets - 1).bit_length())
                f[f"used_by_curr_pic_lt_flag[{i}]"] = sps.get(f"used_by_curr_pic_lt_sps_flag[{k}]", 0)
            else:
                f[f"poc_lsb_lt[{i}]"], f[f"used_by_curr_pic_lt_flag[{i}]"] = b.u(order), b.u(1)
            f[f"delta_poc_msb_present_flag[{i}]"] = b.u(1)
            if f[f"delta_poc_msb_present_flag[{i}]"]:
                f[f"delta_poc_msb_cycle_lt[{i}]"] = b.ue()

    def current(f: Fields) -> int:
        """Pictures that the lists are made of."""
        if f["nal_unit_type"] in (19, 20):
            return 0
        near = [f.get(k, 0) for k in f if k.startswith("slice_ref_pic_set.used")] if not f.get("short_term_ref_pic_set_sps_flag") else [u for _, u in _known_set(sps, f.get("short_term_ref_pic_set_idx", 0))]
        return sum(near) + sum(v for k, v in f.items() if k.startswith("used_by_curr_pic_lt_flag"))

    def changes(b: Bits, f: Fields) -> None:
        for name in lists(f):
            f[f"ref_pic_list_modification_flag_{name}"] = b.u(1)
            if f[f"ref_pic_list_modification_flag_{name}"]:
                f.update({f"list_entry_{name}[{i}]": b.u((current(f) - 1).bit_length()) for i in range(refs(f, name))})

    def entry_points(b: Bits, f: Fields) -> None:
        f["num_entry_point_offsets"] = n = b.ue()
        if n:
            f["offset_len_minus1"] = size = b.ue()
            f.update({f"entry_point_offset_minus1[{i}]": b.u(size + 1) for i in range(min(n, 1 << 16))})

    weighted = lambda f: (f["slice_type"] == _P and pps.get("weighted_pred_flag")) or (f["slice_type"] == _B and pps.get("weighted_bipred_flag"))
    collocated = lambda f: refs(f, "l0" if f.get("collocated_from_l0_flag", 1) else "l1") > 1
    filtered = lambda f: f.get("slice_sao_luma_flag") or f.get("slice_sao_chroma_flag") or not f.get("slice_deblocking_filter_disabled_flag", pps.get("pps_deblocking_filter_disabled_flag", 0))
    first = [
        *HEVC_NAL, ("first_slice_segment_in_pic_flag", 1), ("no_output_of_prior_pics_flag", 1, lambda f: 16 <= f["nal_unit_type"] <= 23), ("slice_pic_parameter_set_id", "ue"),
    ]
    if not sps:
        return first
    return [
        *first, ("dependent_slice_segment_flag", 1, lambda f: not f["first_slice_segment_in_pic_flag"] and pps.get("dependent_slice_segments_enabled_flag")),
        ("slice_segment_address", (across * down - 1).bit_length(), lambda f: not f["first_slice_segment_in_pic_flag"]),
        ("reserved", lambda b, f: b.u(pps.get("num_extra_slice_header_bits", 0)), own), ("slice_type", "ue", own),
        ("pic_output_flag", 1, lambda f: own(f) and pps.get("output_flag_present_flag")), ("colour_plane_id", 2, lambda f: own(f) and sps.get("separate_colour_plane_flag")),
        ("slice_pic_order_cnt_lsb", order, moves), ("short_term_ref_pic_set_sps_flag", 1, moves), ("set", inline, lambda f: f.get("short_term_ref_pic_set_sps_flag") == 0),
        ("short_term_ref_pic_set_idx", max(0, count - 1).bit_length(), lambda f: f.get("short_term_ref_pic_set_sps_flag") and count > 1),
        ("long_term", long_term, lambda f: moves(f) and sps.get("long_term_ref_pics_present_flag")), ("slice_temporal_mvp_enabled_flag", 1, lambda f: moves(f) and sps.get("sps_temporal_mvp_enabled_flag")),
        ("slice_sao_luma_flag", 1, lambda f: own(f) and sps.get("sample_adaptive_offset_enabled_flag")), ("slice_sao_chroma_flag", 1, lambda f: "slice_sao_luma_flag" in f and chroma),
        ("num_ref_idx_active_override_flag", 1, predicted), ("num_ref_idx_l0_active_minus1", "ue", _on("num_ref_idx_active_override_flag")),
        ("num_ref_idx_l1_active_minus1", "ue", lambda f: f.get("num_ref_idx_active_override_flag") and f["slice_type"] == _B),
        ("changes", changes, lambda f: predicted(f) and pps.get("lists_modification_present_flag") and current(f) > 1), ("mvd_l1_zero_flag", 1, both),
        ("cabac_init_flag", 1, lambda f: predicted(f) and pps.get("cabac_init_present_flag")),
        ("collocated_from_l0_flag", 1, lambda f: both(f) and f.get("slice_temporal_mvp_enabled_flag")),
        ("collocated_ref_idx", "ue", lambda f: predicted(f) and f.get("slice_temporal_mvp_enabled_flag") and collocated(f)),
        ("weights", lambda b, f: _hevc_weights(b, f, {k: refs(f, k) for k in lists(f)}, chroma), lambda f: predicted(f) and weighted(f)),
        ("five_minus_max_num_merge_cand", "ue", predicted), ("slice_qp_delta", "se", own),
        *[(f"slice_{c}_qp_offset", "se", lambda f: own(f) and pps.get("pps_slice_chroma_qp_offsets_present_flag")) for c in ("cb", "cr")],
        ("deblocking_filter_override_flag", 1, lambda f: own(f) and pps.get("deblocking_filter_override_enabled_flag")),
        ("slice_deblocking_filter_disabled_flag", 1, _on("deblocking_filter_override_flag")),
        *[(f"slice_{c}_offset_div2", "se", lambda f: f.get("slice_deblocking_filter_disabled_flag") == 0) for c in ("beta", "tc")],
        ("slice_loop_filter_across_slices_enabled_flag", 1, lambda f: own(f) and pps.get("pps_loop_filter_across_slices_enabled_flag") and filtered(f)),
        ("entry_points", entry_points, lambda f: pps.get("tiles_enabled_flag") or pps.get("entropy_coding_sync_enabled_flag")),
        ("slice_segment_header_extension_length", "ue", lambda f: pps.get("slice_segment_header_extension_present_flag")),
    ]


# --- over columns

SYNTAX = {"h264_sps": SPS, "h264_pps": PPS, "h265_vps": VPS, "h265_sps": HEVC_SPS, "h265_pps": HEVC_PPS}


def parse(unit: bytes | None, steps: list[tuple]) -> Fields:
    """Fields of one unit, as far as it goes."""
    f: Fields = {}
    try:
        Bits(unescaped(unit or b"")).read(steps, f)
    except Ended:
        pass
    return f


def _maps(rows: list[Fields]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    keys, values = pa.array([k for r in rows for k in r], pa.string()), pa.array([v for r in rows for v in r.values()], pa.int64())
    return pa.MapArray.from_arrays(pa.array(offsets), keys, values)


def _known(maps: pa.Array) -> tuple[list[bytes], Callable[[int], Fields]]:
    """(what tells the maps of a column apart, the map of a row): maps are compared as bytes, and read only where they are new."""
    offsets, names = np.asarray(maps.offsets), maps.keys.dictionary_encode()
    keys, values = np.asarray(names.indices), np.asarray(maps.items)
    told = [keys[x:y].tobytes() + values[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return told, lambda i: dict(maps[i].as_py() or [])


#: Steps that only reckon, with fields or with columns of them.
RECKONED = {_crop, _hevc_crop}
#: Sorts of units by what a condition looks at or by what repeats in them, and units, up to which a batch is read column-wise.
SORTS, FEW = 64, 16


def _columnar(steps: list[tuple]) -> bool:
    """Whether a syntax can be read column-wise: fields of fixed or Exp-Golomb length with names of their own, with conditions; what repeats may come too."""
    names = [step[0] for step in steps]
    return len(set(names)) == len(names) and all(callable(step[1]) or step[1] in ("ue", "se") or (isinstance(step[1], int) and 0 <= step[1] <= 57) for step in steps)


class _Asked(dict):
    """Fields of a unit that remember which of them were looked at, and what was added."""

    def __init__(self, fields: Fields) -> None:
        super().__init__(fields)
        self.asked: set[str] = set()
        self.told: Fields = {}

    def _ask(self, k: str) -> None:
        if k not in self.told:
            self.asked.add(k)

    def __getitem__(self, k: str) -> int:
        self._ask(k)
        return super().__getitem__(k)

    def get(self, k: str, default: int | None = None) -> int | None:
        self._ask(k)
        return super().get(k, default)

    def __contains__(self, k: object) -> bool:
        self._ask(k)
        return super().__contains__(k)

    def __setitem__(self, k: str, v: int) -> None:
        self.told[k] = v
        super().__setitem__(k, v)

    def update(self, more: Fields) -> None:
        for k, v in more.items():
            self[k] = v

    def _all(self, *_: object) -> None:
        raise NotImplementedError

    __iter__ = items = keys = values = __len__ = _all


def _agree(names: set[str], rows: np.ndarray, values: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows have the fields of the first one, or lack them as it does."""
    one, same = rows[0], np.ones(len(rows), bool)
    for k in names & known.keys():
        has = known[k][rows]
        same &= (has & (values[k][rows] == values[k][one])) if known[k][one] else ~has
    return same


class _Reckoned(dict):
    """Fields of some rows as columns; what is set is kept apart."""

    def __init__(self, rows: np.ndarray, values: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> None:
        super().__init__()
        self.rows, self.values_, self.known = rows, values, known

    def __getitem__(self, k: str) -> np.ndarray:
        return self.values_[k][self.rows]

    def get(self, k: str, default: int) -> np.ndarray | int:
        return np.where(self.known[k][self.rows], self.values_[k][self.rows], default) if k in self.known else default


def _holds(condition: Callable[[Fields], bool], rows: np.ndarray, values: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows for which a condition holds, rows for which it was not found): it is asked once for each combination of the fields that it looks at."""
    yes, rest = [np.zeros(0, np.int64)], rows
    for _ in range(SORTS):
        if not len(rest):
            break
        one = rest[0]
        fields = _Asked({k: int(values[k][one]) for k, has in known.items() if has[one]})
        try:
            holds = condition(fields)
        except NotImplementedError:  # it looks at all fields
            break
        same = _agree(fields.asked, rest, values, known)
        if holds:
            yes.append(rest[same])
        rest = rest[~same]
    return np.concatenate(yes), rest


def read_columns(units: pa.Array, steps: list[tuple], only: frozenset[str] | None = None) -> pa.Array:
    """The fields of units, read for all units of a batch at once, field by field; the same maps as :func:`parse` gives one by one, or of them the fields in ``only``.

    What repeats is run once for all units that agree in the fields it looks at and in the bits it reads; units of many sorts are read alone.
    """
    plain = units.to_pylist()
    rows = [unescaped(u) if b"\0\0\3" in u else u for u in (x or b"" for x in plain)]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    data = np.frombuffer(b"".join(rows) + bytes(16), np.uint8)
    ends = np.cumsum(sizes)
    at, end = 8 * (ends - sizes), 8 * ends
    places = np.arange(len(data) - 7)
    words = np.zeros(len(places), np.uint64)
    for k in range(8):
        words |= data[places + k].astype(np.uint64) << np.uint64(56 - 8 * k)

    def take(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """So many bits, at most 57, from each place."""
        n = np.asarray(n)
        shifted = words[at >> 3] << (at & 7).astype(np.uint64)
        return np.where(n > 0, shifted >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)

    # the first 1 at or after each bit tells how many zeros a code starts with
    ones = np.flatnonzero(np.unpackbits(data)) if any(step[1] in ("ue", "se") for step in steps) else np.zeros(0, np.int64)
    ones = np.append(ones, 8 * len(data) + (1 << 20))
    good, alone = np.ones(len(rows), bool), np.zeros(len(rows), bool)
    values: dict[str, np.ndarray] = {}
    known: dict[str, np.ndarray] = {}
    names: dict[str, int] = {}
    columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # whether a row has a field there, the number of its name, and the field

    def tell(name: str, own: np.ndarray, found: np.ndarray | int) -> None:
        has = known.setdefault(name, np.zeros(len(rows), bool))
        alone[own[has[own]]] = True  # a field that is told again
        values.setdefault(name, np.zeros(len(rows), np.int64))[own] = found
        has[own] = True

    def column() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns.append((np.zeros(len(rows), bool), np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64)))
        return columns[-1]

    def show(name: str, own: np.ndarray, found: np.ndarray | int, place: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        for x, new in zip(place, (True, names.setdefault(name, len(names)), found), strict=True):
            x[own] = new

    def repeated(kind: Callable[[Bits, Fields], None], rest: np.ndarray) -> None:
        places: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(SORTS):
            if not len(rest):
                break
            one = rest[0]
            f, b = _Asked({k: int(values[k][one]) for k, has in known.items() if has[one]}), Bits(rows[one])
            b.at = first = int(at[one] - 8 * (ends[one] - sizes[one]))
            try:
                kind(b, f)
            except Ended:
                alone[one], rest = True, rest[1:]
                continue
            except NotImplementedError:  # it looks at all fields
                break
            n = b.at - first
            same = _agree(f.asked, rest, values, known) & (at[rest] + n <= end[rest])
            for k in range(0, n, 57):
                some = min(57, n - k)
                same[same] = take(at[rest[same]] + k, some) == take(at[one : one + 1] + k, some)
            own, rest = rest[same], rest[~same]
            at[own] += n
            for k, v in f.told.items():
                tell(k, own, v)
            for i, k in enumerate(k for k in f.told if only is None or k in only):
                if i == len(places):
                    places.append(column())
                show(k, own, f.told[k], places[i])
        alone[rest] = True

    for name, kind, *condition in steps:
        own = np.flatnonzero(good & ~alone)
        if condition:
            own, unknown = _holds(condition[0], own, values, known)
            alone[unknown] = True
        if kind in RECKONED:
            made = _Reckoned(own, values, known)
            kind(None, made)
            told = [(k, own, found) for k, found in made.items()]
        elif callable(kind):
            repeated(kind, own)
            continue
        else:
            here, last = at[own], end[own]
            if isinstance(kind, int):
                fits = here + kind <= last
                value, after = take(np.where(fits, here, 0), kind), here + kind
            else:
                zeros = ones[np.searchsorted(ones, here)] - here
                fits = (zeros <= 32) & (here + 2 * zeros + 1 <= last)
                zeros = np.where(fits, zeros, 0)
                value, after = take(np.where(fits, here + zeros, 0), zeros + 1) - 1, here + 2 * zeros + 1
                if kind == "se":
                    value = np.where(value % 2 == 1, (value + 1) // 2, -(value // 2))
            good[own[~fits]] = False
            at[own] = after
            told = [(name, own[fits], value[fits])]
        for k, some, found in told:
            tell(k, some, found)
            if len(some) and (only is None or k in only):
                show(k, some, found, column())
    mask, ids, found = (np.stack([*x, np.zeros(len(rows), kind)], 1) for x, kind in zip(zip(*columns, strict=True) if columns else ((), (), ()), (bool, np.int32, np.int64), strict=True))
    return _joined_maps(list(names), mask, ids, found, {int(i): _some(parse(plain[i], steps), only) for i in np.flatnonzero(alone)})


def _some(fields: Fields, only: frozenset[str] | None) -> Fields:
    return fields if only is None else {k: v for k, v in fields.items() if k in only}


def _joined_maps(names: list[str], mask: np.ndarray, ids: np.ndarray, values: np.ndarray, alone: dict[int, Fields]) -> pa.Array:
    """Maps of the fields that each row has, but for rows that were read alone."""
    mask[list(alone)] = False
    keys = pa.DictionaryArray.from_arrays(pa.array(ids[mask]), pa.array([*names, ""], pa.string())).cast(pa.string())
    offsets = np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(offsets), keys, pa.array(values[mask]))
    if not alone:
        return maps
    order = np.arange(len(mask))
    order[list(alone)] = len(mask) + np.arange(len(alone))
    return pa.concat_arrays([maps, _maps(list(alone.values()))]).take(pa.array(order))


def header(unit: Column, kind: str | list[tuple], fields: Iterable[str] | None = None) -> Column:
    """map<string, bigint> of the fields of units, or of those that are named; ``kind`` is a key of ``SYNTAX``, or a syntax. Most are read column-wise."""
    steps, only = SYNTAX[kind] if isinstance(kind, str) else kind, None if fields is None else frozenset(fields)

    def run(units: pa.Array) -> pa.Array:
        return read_columns(units, steps, only) if len(units) > FEW and _columnar(steps) else _maps([_some(parse(u, steps), only) for u in units.to_pylist()])

    return F.arrow_udf(run, "map<string,bigint>", F.ArrowUDFType.SCALAR)(unit)


def slice_header(unit: Column, sps: Column, pps: Column, codec: str = "h264") -> Column:
    """map<string, bigint> of a slice's header, under the maps of its parameter sets; either may be null."""
    steps = slice_steps if codec == "h264" else hevc_slice_steps

    def run(units: pa.Array, sets: pa.Array, pictures: pa.Array) -> pa.Array:
        (told, own), (also, picture) = _known(sets), _known(pictures)
        same: dict[tuple, list[int]] = {}  # slices of a stream share their sets, and so their syntax
        for i, key in enumerate(zip(told, also, strict=True)):
            same.setdefault(key, []).append(i)
        out = []
        for places in same.values():
            syntax, some = steps(own(places[0]), picture(places[0])), units if len(same) == 1 else units.take(pa.array(places))
            out.append(read_columns(some, syntax) if len(places) > FEW and _columnar(syntax) else _maps([parse(u, syntax) for u in some.to_pylist()]))
        if len(out) < 2:
            return out[0] if out else _maps([])
        return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(list(same.values())))))

    return F.arrow_udf(run, "map<string,bigint>", F.ArrowUDFType.SCALAR)(unit, sps, pps)


#: What tells a set or a slice by, and the fields that hold the numbers of sets: (kinds of units, syntax, own number, number of the set it refers to).
_SETS = {
    "h264": {"sps": ((7,), SPS, "seq_parameter_set_id", None), "pps": ((8,), PPS, "pic_parameter_set_id", "seq_parameter_set_id"), "slice": ((1, 2, 5), slice_steps({}, {}), None, "pic_parameter_set_id")},
    "h265": {"sps": ((33,), HEVC_SPS, "sps_seq_parameter_set_id", None), "pps": ((34,), HEVC_PPS, "pps_pic_parameter_set_id", "pps_seq_parameter_set_id"), "slice": ((*range(10), *range(16, 22)), hevc_slice_steps({}, {}), None, "slice_pic_parameter_set_id")},
}


def with_active_sets(units: DataFrame, stream: list[str], order: list[str], codec: str = "h264", per: int | None = None) -> DataFrame:
    """The slices among rows (stream, order, unit) with ``sps`` and ``pps``: the fields of the last picture set of its number before it, and of that one's sequence set.

    A set that comes again replaces the one of its number from there on; slices without a set before them have null. ``per`` cuts streams into ranges of so
    many units, for streams that are too long for a task (:mod:`tracklake.operators.buckets`).
    """
    from tracklake.operators.buckets import bucketed, over

    first, kinds = F.conv(F.hex(F.substring("unit", 1, 1)), 16, 10).cast("int"), _SETS[codec]
    kind = first.bitwiseAND(31) if codec == "h264" else F.shiftright(first, 1).bitwiseAND(63)
    parts = []
    for name, (numbers, steps, number, refers) in kinds.items():
        fields = F.col("_f")
        rows = units.withColumn("_kind", kind).where(F.col("_kind").isin(*numbers)).withColumns({"_kind": F.lit(name), "_f": header(F.col("unit"), steps)})
        parts.append(rows.withColumns({"_own": fields[number] if number else F.lit(None).cast("long"), "_refers": fields[refers] if refers else F.lit(None).cast("long"), "_f": F.col("_f") if number else F.lit(None).cast("map<string,bigint>")}))
    cut = lambda rows, group: bucketed(rows, group, order, per) if per else rows
    sps, pps, slices = parts
    group = [*stream, "_n"]
    both = pps.withColumn("_n", F.col("_own")).unionByName(slices.withColumn("_n", F.col("_refers")))
    found = over(cut(both, group), group, order, lasts={"pps": F.col("_f"), "_seq": F.when(F.col("_kind") == "pps", F.col("_refers"))}).where("_kind = 'slice'").drop("_bucket", "_n")
    none = F.lit(None)
    both = sps.withColumns({"_n": F.col("_own"), "pps": none.cast("map<string,bigint>"), "_seq": none.cast("long")}).unionByName(found.withColumn("_n", F.col("_seq")))
    found = over(cut(both, group), group, order, lasts={"sps": F.when(F.col("_kind") == "sps", F.col("_f"))}).where("_kind = 'slice'")
    return found.withColumn("sps", F.when(F.col("_seq").isNotNull(), F.col("sps"))).drop("_bucket", "_n", "_kind", "_f", "_own", "_refers", "_seq")


#: The fields that a frame rate is made of.
TIMING = ("num_units_in_tick", "time_scale")


def frame_rate(fields: Column, codec: str = "h264") -> Column:
    """Pictures a second by a sequence set's timing: two ticks a picture for H.264, one for H.265."""
    step = fields["num_units_in_tick"] * (2 if codec == "h264" else 1)
    return F.when(step > 0, fields["time_scale"] / step)


def sei_payloads(unit: bytes, head: int) -> Iterator[tuple[int, int, bytes]]:
    """(type, size, payload) of the messages of a unit whose header has ``head`` bytes."""
    data, at = unescaped(unit), head
    while at < len(data) - 1:
        numbers = []
        for _ in range(2):
            n = 0
            while at < len(data) and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= len(data):
                return
            numbers.append(n + data[at])
            at += 1
        kind, size = numbers
        if at + size > len(data):
            return
        yield kind, size, data[at : at + size]
        at += size


def sei_messages(unit: Column, codec: str = "h264") -> Column:
    """array<struct<type, size, payload>> of a unit's messages, to be exploded."""
    head = 1 if codec == "h264" else 2
    kind = pa.list_(pa.struct([("type", pa.int64()), ("size", pa.int64()), ("payload", pa.binary())]))

    def run(units: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("type", "size", "payload"), m, strict=True)) for m in sei_payloads(u.as_py() or b"", head)] for u in units], kind)

    return F.arrow_udf(run, "array<struct<type:bigint,size:bigint,payload:binary>>", F.ArrowUDFType.SCALAR)(unit)


def sei_fields(kind: Column, payload: Column) -> Column:
    """struct<country, provider, user, captions, uuid> of registered (4) and unregistered (5) user data, natively."""
    byte = lambda at, n: F.lower(F.hex(F.substring(payload, at + 1, n)))
    registered, size = kind == 4, F.length(payload)
    american = registered & (size >= 4) & (byte(0, 1) == "b5")
    user = F.when(american & (size >= 7) & (byte(1, 2) == "0031"), F.decode(F.substring(payload, 4, 4), "ISO-8859-1"))
    uuid = F.regexp_replace(byte(0, 16), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    return F.struct(
        F.when(registered & (size >= 3), F.concat(F.lit("0x"), byte(0, 1))).alias("country"), F.when(american, F.concat(F.lit("0x"), byte(1, 2))).alias("provider"),
        user.alias("user"), F.coalesce(user == "GA94", F.lit(False)).alias("captions"), F.when((kind == 5) & (size >= 16), uuid).alias("uuid"),
    )
