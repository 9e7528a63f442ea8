"""Names of numbers in stream headers, as native lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats: ISO/IEC 14496-10 (AVC), 23008-2 (HEVC), 14496-3 (AAC) and 13818-1 (transport streams).
AVC_PROFILES = {
    44: "CAVLC 4:4:4 Intra", 66: "Baseline", 77: "Main", 83: "Scalable Baseline", 86: "Scalable High", 88: "Extended", 100: "High", 110: "High 10",
    118: "Multiview High", 122: "High 4:2:2", 128: "Stereo High", 134: "MFC High", 135: "MFC Depth High", 138: "Multiview Depth High",
    139: "Enhanced Multiview Depth High", 244: "High 4:4:4 Predictive",
}
CHROMA = {0: "Monochrome", 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}
SLICES = {0: "P slice (Predicted)", 1: "B slice (Bi-directional predicted)", 2: "I slice (Intra)", 3: "SP slice", 4: "SI slice"}
HEVC_PROFILES = {0: "No Profile", 1: "Main", 2: "Main 10", 3: "Main Still Picture", 4: "Format Range Extensions", 5: "High Throughput", 9: "Screen Content Coding Extensions"}
HEVC_UNITS = {
    0: "TRAIL_N", 1: "TRAIL_R", 19: "IDR_W_RADL", 20: "IDR_N_LP", 21: "CRA_NUT", 32: "VPS_NUT", 33: "SPS_NUT", 34: "PPS_NUT",
    39: "PREFIX_SEI_NUT", 40: "SUFFIX_SEI_NUT",
}
HEVC_TIERS = {0: "Main", 1: "High"}
AAC_OBJECTS = {
    0: "NULL", 1: "AAC Main", 2: "AAC LC (Low Complexity)", 3: "AAC SSR", 4: "AAC LTP", 5: "SBR", 6: "AAC Scalable", 17: "ER AAC LC", 19: "ER AAC LTP",
    20: "ER AAC Scalable", 22: "ER BSAC", 23: "ER AAC LD", 29: "PS (Parametric Stereo)", 42: "USAC (no SBR)", 45: "USAC",
}
AAC_LAYOUTS = {0: "Defined in AOT", 1: "Mono", 2: "Stereo", 3: "3.0", 4: "4.0", 5: "5.0", 6: "5.1", 7: "7.1"}
AAC_PROFILES = {1: "Main", 2: "LC (Low Complexity)", 3: "SSR", 4: "LTP", 5: "SBR (HE-AAC)", 6: "Scalable"}
STREAM_TYPES = {
    0x01: "MPEG-1 Video", 0x02: "MPEG-2 Video", 0x03: "MPEG-1 Audio", 0x04: "MPEG-2 Audio", 0x06: "PES private data", 0x0F: "AAC (ADTS)", 0x10: "MPEG-4 Video", 0x11: "AAC (LATM)",
    0x1B: "H.264 (AVC)", 0x1C: "AAC", 0x24: "HEVC (H.265)", 0x42: "AVS3",
}
SEI_TYPES = {
    0: "buffering_period", 1: "pic_timing", 2: "pan_scan_rect", 3: "filler_payload", 4: "user_data_registered_itu_t_t35", 5: "user_data_unregistered",
    6: "recovery_point", 7: "dec_ref_pic_marking_repetition", 8: "spare_pic", 9: "scene_info", 19: "film_grain_characteristics", 23: "tone_mapping_info",
    45: "frame_packing_arrangement", 47: "display_orientation", 137: "mastering_display_info", 144: "content_light_level_info",
    147: "alternative_transfer_characteristics",
}


def named(number: Column, table: dict[int, str], otherwise: str | Column = "Unknown (%d)") -> Column:
    """The name of a number; ``otherwise`` may hold %d for it."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[number.cast("int")]
    return F.coalesce(found, F.format_string(otherwise, number.cast("long")) if isinstance(otherwise, str) and "%d" in otherwise else F.lit(otherwise))


def avc_profile(number: Column) -> Column:
    return named(number, AVC_PROFILES, "Unknown Profile (%d)")


def level(number: Column, step: int = 10) -> Column:
    """A level by its number: tenths for AVC, thirtieths for HEVC."""
    return F.concat(F.lit("Level "), F.format_string("%.1f", number / step))


def slice_name(number: Column) -> Column:
    whole = F.concat(named(number % 5, {k: v.split(" ")[0] for k, v in SLICES.items()}), F.lit(" slice (all slices in picture are "), named(number % 5, {k: v.split(" ")[0] for k, v in SLICES.items()}), F.lit(")"))
    return F.when(number.between(5, 9), whole).otherwise(named(number, SLICES))
