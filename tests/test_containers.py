"""Headers, program tables and files built by hand or by the library, read as tables."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklake.functions import bits
from tracklake.functions import bitstream as N
from tracklake.functions import writers as W
from tracklake.plans import workflows as flows
from tracklake.sources import audio as A
from tracklake.sources import flv, mp4, transport
from tracklake.sources import media as M

from .test_sources import box, full, packet, sources, stamp, tag, wav


class Writer:
    def __init__(self):
        self.bits = ""

    def u(self, value, n):
        self.bits += f"{value:0{n}b}" if n else ""
        return self

    def ue(self, value):
        code = f"{value + 1:b}"
        self.bits += "0" * (len(code) - 1) + code
        return self

    def se(self, value):
        return self.ue(2 * value - 1 if value > 0 else -2 * value)

    def bytes(self):
        text = self.bits + "1"
        text += "0" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def escaped(data):
    out, zeros = bytearray(), 0
    for byte in data:
        if zeros >= 2 and byte <= 3:
            out.append(3)
            zeros = 0
        out.append(byte)
        zeros = zeros + 1 if byte == 0 else 0
    return bytes(out)


def sps(width=320, height=180, fps=25):
    w, h = -(-width // 16), -(-height // 16)
    out = Writer().u(0x67, 8).u(100, 8).u(0, 8).u(30, 8).ue(0).ue(1).ue(0).ue(0).u(0, 1).u(0, 1).ue(0).ue(0).ue(2).ue(3).u(0, 1).ue(w - 1).ue(h - 1).u(1, 1).u(1, 1)
    out.u(1, 1).ue(0).ue((w * 16 - width) // 2).ue(0).ue((h * 16 - height) // 2)
    out.u(1, 1).u(0, 4).u(1, 1).u(1, 32).u(2 * fps, 32).u(1, 1).u(1, 1).ue(0).u(0, 8).ue(9).ue(9).u(0, 1).u(1, 5).u(1, 5).u(1, 5).u(1, 5).u(0, 1).u(0, 1).u(0, 1).u(0, 1)
    return escaped(out.bytes())


def test_sequence_set_with_buffer_model(spark):
    f = bits.parse(sps(322, 180, 30), bits.SPS)
    assert (f["width"], f["height"], f["profile_idc"], f["time_scale"], f["nal_hrd.bit_rate_value_minus1[0]"], f["low_delay_hrd_flag"]) == (322, 180, 100, 60, 9, 0)
    cut = bits.parse(sps()[:8], bits.SPS)
    assert cut["profile_idc"] == 100 and "width" not in cut and bits.parse(None, bits.SPS) == {}


def test_random_syntax_round_trip():
    rng = random.Random(3)
    for _ in range(200):
        steps = [(f"f{i}", rng.choice(["ue", "se", rng.randint(1, 32)])) for i in range(rng.randint(1, 20))]
        values, w = {}, Writer()
        for name, kind in steps:
            values[name] = rng.randint(-500, 500) if kind == "se" else rng.randrange(1 << kind) if isinstance(kind, int) else rng.randint(0, 70_000)
            w.u(values[name], kind) if isinstance(kind, int) else getattr(w, kind)(values[name])
        assert bits.parse(escaped(w.bytes()), steps) == values


def test_columns_read_what_rows_read(spark):
    rng = random.Random(5)
    for _ in range(30):
        steps = [(f"f{i}", rng.choice(["ue", "se", rng.randint(1, 32)])) for i in range(rng.randint(1, 12))]
        units = [bytes(rng.choice([0, 0, 0, 1, 3, rng.randrange(256)]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, b"", b"\0" * 9]
        got = bits.read_columns(pa.array(units, pa.binary()), steps).to_pylist()
        assert [dict(x) for x in got] == [bits.parse(u, steps) for u in units]
    texts = ["", "1", "01", "11111111", "111111110", None, "0" * 17 + "1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", W.bits_to_bytes(F.col("t")).alias("b")).collect()
    assert {r.i: r.b and bytes(r.b) for r in rows} == {i: None if t is None else (t and bytes(int(t[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(t), 8))) or bytearray() for i, t in enumerate(texts)}


def test_slice_with_lists_and_weights():
    sets, pictures = {"log2_max_frame_num_minus4": 0, "pic_order_cnt_type": 2, "frame_mbs_only_flag": 1}, {"weighted_pred_flag": 1, "deblocking_filter_control_present_flag": 0}
    w = Writer().u(0b01100001, 8).ue(0).ue(0).ue(0).u(5, 4).u(1, 1).ue(1).u(1, 1).ue(0).ue(7).ue(3)
    w.ue(2).ue(1)  # weights of two references, luma of the second only, chroma of the first only
    w.u(0, 1).u(1, 1).se(1).se(-2).se(3).se(-4)
    w.u(1, 1).se(9).se(-9).u(0, 1)
    w.u(1, 1).ue(1).ue(4).ue(0).se(-3)
    f = bits.parse(escaped(w.bytes()), bits.slice_steps(sets, pictures))
    assert (f["frame_num"], f["num_ref_idx_l0_active_minus1"], f["abs_diff_pic_num_minus1[0]"], f["chroma_offset_l0[0][1]"], f["luma_weight_l0[1]"]) == (5, 1, 7, -4, 9)
    assert (f["memory_management_control_operation[1]"], f["difference_of_pic_nums_minus1[0]"], f["slice_qp_delta"]) == (0, 4, -3)
    assert list(bits.parse(escaped(w.bytes()), bits.slice_steps({}, {})))[-1] == "pic_parameter_set_id"


def test_hevc_reference_sets_follow_one_another():
    fields = {"num_short_term_ref_pic_sets": 2}
    w = Writer().ue(2).ue(0).ue(0).u(1, 1).ue(1).u(1, 1)  # -1, -3
    w.u(1, 1).u(1, 1).ue(0)  # the second: one step back from the first
    w.u(1, 1).u(1, 1).u(1, 1)
    bits._reference_sets(bits.Bits(w.bytes()), fields)
    assert [fields[f"short_term_ref_pic_set[1].delta_poc[{i}]"] for i in range(3)] == [-1, -2, -4]


def test_hevc_picture_set_and_slice(spark):
    pps = Writer().u(0, 1).u(34, 6).u(0, 6).u(1, 3).ue(1).ue(0).u(1, 1).u(1, 1).u(2, 3).u(0, 1).u(1, 1).ue(2).ue(3).se(-4).u(0, 2).u(1, 1).ue(1).se(1).se(-1).u(0, 4).u(1, 1).u(0, 1).ue(1).ue(1).u(0, 1).ue(5).ue(6).u(1, 1).u(1, 1).u(1, 1).u(1, 1).u(0, 1).se(2).se(-2).u(0, 1).u(1, 1).ue(0).u(0, 1)
    f = bits.parse(pps.bytes(), bits.HEVC_PPS)
    assert (f["init_qp_minus26"], f["tile_size_minus1[1]"], f["pps_tc_offset_div2"], f["lists_modification_present_flag"]) == (-4, 6, -2, 1)
    sets = {"pic_width_in_luma_samples": 1920, "pic_height_in_luma_samples": 1080, "log2_min_luma_coding_block_size_minus3": 0, "log2_diff_max_min_luma_coding_block_size": 3, "log2_max_pic_order_cnt_lsb_minus4": 4}
    head = Writer().u(0, 1).u(1, 6).u(0, 6).u(1, 3).u(0, 1).ue(1).u(0, 1).u(300, 9).u(3, 2).ue(1).u(1, 1).u(77, 8).u(0, 1).ue(1).ue(0).ue(0).u(1, 1)
    got = spark.createDataFrame([(bytearray(head.bytes()), sets, f)], "u binary, s map<string,bigint>, p map<string,bigint>").select(bits.slice_header(F.col("u"), F.col("s"), F.col("p"), "h265").alias("f")).first().f
    assert (got["slice_segment_address"], got["slice_type"], got["slice_pic_order_cnt_lsb"], got["slice_ref_pic_set.delta_poc[0]"], got["slice_ref_pic_set.used_by_curr_pic_flag[0]"]) == (300, 1, 77, -1, 1)


def test_video_parameter_set():
    w = Writer().u(0, 1).u(32, 6).u(0, 6).u(1, 3).u(0, 4).u(3, 2).u(0, 6).u(1, 3).u(1, 1).u(0xFFFF, 16).u(0, 2).u(0, 1).u(1, 5).u(0, 32).u(0, 4).u(0, 43).u(0, 1).u(93, 8)
    w.u(1, 1).u(1, 1).u(0, 14).u(0, 88).u(60, 8).u(0, 1).ue(4).ue(2).ue(5).u(0, 6).ue(0).u(1, 1).u(1001, 32).u(30000, 32).u(0, 1).ue(0).u(0, 1)
    f = bits.parse(escaped(w.bytes()), bits.VPS)
    assert (f["general_level_idc"], f["vps_max_num_reorder_pics[1]"], f["vps_time_scale"]) == (93, 2, 30000)


def test_mp3_with_junk_and_a_cut_frame(spark):
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    data = b"ID3\4\0\x10\0\0\0\5" + bytes(15) + b"\xff\x00junk" + frame * 3 + frame[:416] + b"TAG"
    rows = A.mp3_frames(sources(spark, a=data, b=b"\xff\xfb\x00\x00" + bytes(40), c=b"ID3\4\0\0\0\0\0\5")).orderBy("index").collect()
    assert [(r.source_id, r.offset, r["size"], r.pts_us) for r in rows] == [("a", 31 + 417 * i, 417, round(i * 1152e6 / 44100)) for i in range(4)]
    t = A.mp3_tracks(A.mp3_frames(sources(spark, a=data))).first()
    assert (t.rate, t.channels, t.bitrate, t.frames) == (44100, 2, 128000, 4)


def test_transport_stream_resync_and_stated_length(spark):
    pes = b"\x00\x00\x01\xe0\x00\x0a\x80\x80\x05" + stamp(500_000, 2) + b"vv"
    good = [packet(0x100, True, pes + b"stuffing") for _ in range(8)]
    data = b"".join(good[:6]) + b"\x00\x01" + good[6] + b"\xff" + good[7]
    packets = M.ts_packets(sources(spark, a=data))
    rows = M.ts_pes(packets, with_data=True).collect()
    assert len(rows) == 8 and {(r["size"], bytes(r.data)) for r in rows} == {(2, b"vv")}


def test_program_stream_without_lengths(spark):
    pack = b"\0\0\1\xba\x44\0\4\0\4\1\0\0\3\xf8"
    data = pack + b"\0\0\1\xbb\0\6aaaaaa" + b"\0\0\1\xe0\0\0\x80\xc0\x0a" + stamp(1_000_000, 3) + stamp(960_000, 1) + b"video" + b"\0\0\1\xbe\0\4xxxx" + b"\0\0\1\xc0\0\x0b\x80\x80\5" + stamp(500_000, 2) + b"abc" + b"\0\0\1\xb9"
    rows = transport.ps_packets(sources(spark, a=data)).orderBy("index").collect()
    assert [(r.kind, r.pts_us, r.dts_us, data[r.offset : r.offset + r["size"]]) for r in rows] == [("video", 1_000_000, 960_000, b"video"), ("audio", 500_000, 500_000, b"abc")]


def amf(value):
    if isinstance(value, bool):
        return b"\1" + bytes([value])
    if isinstance(value, (int, float)):
        return b"\0" + struct.pack(">d", value)
    if isinstance(value, str):
        return b"\2" + struct.pack(">H", len(value)) + value.encode()
    return b"\3" + b"".join(struct.pack(">H", len(k)) + k.encode() + amf(v) for k, v in value.items()) + b"\0\0\x09"


def test_script_objects(spark):
    inner = {"audiosamplerate": 22050, "audiochannels": 1, "deep": {"x": True, "name": "n"}}
    data = b"FLV\x01\x05\x00\x00\x00\x09" + bytes(4) + tag(18, 0, amf("onMetaData") + amf(inner)) + tag(18, 0, amf("cut") + b"\0\0") + tag(8, 0, b"\xaf\0\x12\x10") + tag(8, 5, b"\xaf\1raw")
    got = {r.key: r.number if r.number is not None else r.text for r in flv.script_values(sources(spark, a=data)).collect()}
    assert got == {"audiosamplerate": 22050.0, "audiochannels": 1.0, "deep.x": 1.0, "deep.name": "n"}
    a = flv.audio_streams(sources(spark, a=data)).first()
    assert (a.codec, a.rate, a.channels) == ("aac", 44100, 2)


def movie_bytes(config):
    entry = struct.pack(">I4s6xH16xHHIIIH32xHh", 86 + len(config), b"avc1", 1, 64, 48, 0x480000, 0x480000, 0, 1, 24, -1) + config
    sound = struct.pack(">I4s6xH8xHH4xI", 36 + 39, b"mp4a", 1, 1, 16, 8000 << 16) + box(b"esds", bytes(4), b"\3\x19\0\1\0\4\x11\x40\x15" + bytes(11) + b"\5\x02\x12\x10\6\1\2")[:39]
    video = box(b"trak", full(b"tkhd", 0, 0, 5, 0, 0), box(b"mdia", full(b"mdhd", 0, 0, 1000, 2000, 0), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), entry)))))
    audio = box(b"trak", full(b"tkhd", 0, 0, 9, 0, 0), box(b"mdia", full(b"mdhd", 0, 0, 8000, 8000, 0), box(b"hdlr", bytes(8), b"soun", bytes(12)), box(b"minf", box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), sound)))))
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", full(b"mvhd", 0, 0, 1000, 2500), video, audio)


def test_sample_entries(spark):
    s = sps(322, 180, 25)
    avcc = box(b"avcC", b"\x01" + s[1:4] + b"\xff\xe1" + struct.pack(">H", len(s)) + s + b"\x01\0\2\x68\xce")
    boxes = M.mp4_boxes(sources(spark, a=movie_bytes(avcc), b=movie_bytes(b"")))
    got = {r.source_id: (r.entry, r.width, r.height, r.profile, r.frame_rate) for r in mp4.video_entries(boxes).collect()}
    assert got == {"a": ("avc1", 322, 180, 100, 25.0), "b": ("avc1", 64, 48, None, None)}
    a = mp4.audio_entries(boxes.where("source_id = 'a'")).first()
    assert (a.entry, a.rate, a.channels, a.object_type, bytes(a.config)) == ("mp4a", 44100, 2, 2, b"\x12\x10")
    assert sorted(r.track_id for r in mp4.track_ids(boxes.where("source_id = 'a'")).collect()) == [5, 9]
    m = mp4.movie_summary(boxes.where("source_id = 'b'")).first()
    assert (m.duration_ms, m.n_tracks, m.n_video, m.n_audio) == (2500.0, 2, 1, 1)


def flv_movie():
    s = sps(320, 180, 25)
    config = b"\x01" + s[1:4] + b"\xff\xe1" + struct.pack(">H", len(s)) + s + b"\x01\0\2\x68\xce"
    tags = [tag(9, 0, b"\x17\0\0\0\0" + config), tag(8, 0, b"\xaf\0\x12\x10")]
    tags += [tag(9, 40 * i, (b"\x17" if i % 3 == 0 else b"\x27") + b"\1\0\0\x28" + struct.pack(">I", 4) + b"\x65abc") for i in range(6)]
    tags += [tag(8, 23 * i, b"\xaf\1" + bytes([65 + i]) * 5) for i in range(9)]
    return b"FLV\x01\x05\x00\x00\x00\x09" + bytes(4) + b"".join(tags)


def test_remux_reads_back(spark):
    both = sources(spark, f=flv_movie(), w=wav(5000))
    row = flows.remux(both, formats=("flv",))[0].first()
    assert (row.file_id, row.n_video, row.n_audio) == ("f", 6, 9)
    again = sources(spark, f=bytes(row.data))
    samples = flows.analyse(again, ("mp4",))[1].cache()
    data = {(r.kind, r["index"]): bytes(r.data) for r in flows.sample_bytes(samples, again).collect()}
    assert data["audio", 3] == b"DDDDD" and data["video", 0] == struct.pack(">I", 4) + b"\x65abc"
    video = samples.where("kind = 'video'").orderBy("index").collect()
    assert [(r.pts_us, r.dts_us, r.is_key) for r in video] == [(40_000 * i + 40_000, 40_000 * i, i % 3 == 0) for i in range(6)]


def test_transport_stream_tracks(spark):
    s = sps(320, 180, 25)
    adts = lambda n: b"\xff\xf1\x50\x80" + ((n + 7) << 5 | 0x1F).to_bytes(2, "big") + b"\xfc" + bytes([n]) * n
    section = lambda body: b"\0" + body + bytes(4)
    pmt = b"\2\xb0\x17\0\1\xc1\0\0\xe1\1\xf0\0\x1b\xe1\1\xf0\0\x0f\xe1\2\xf0\0"
    data = packet(0, True, section(b"\0\xb0\x0d\0\1\xc1\0\0\0\1\xe1\0")) + packet(256, True, section(pmt))
    for i in range(4):
        unit = b"\0\0\0\1" + s + b"\0\0\0\1\x68\xce\0\0\1\x65key" if i == 0 else b"\0\0\1\x41p%d" % i
        data += packet(257, True, b"\0\0\1\xe0\0\0\x80\x80\5" + stamp(40_000 * i, 2) + unit)
        data += packet(258, True, b"\0\0\1\xc0\0\0\x80\x80\5" + stamp(40_000 * i, 2) + adts(5) + adts(6))
    told = {r.kind: r for r in flows.streams(sources(spark, t=data), ("mpegts",)).collect()}
    assert (told["video"].family, told["video"].width, told["video"].fps, told["audio"].rate, told["audio"].channels, bytes(told["audio"].config)) == ("h264", 320, 25.0, 44100, 2, b"\x12\x10")
    frames = spark.createDataFrame([(bytearray(adts(5) + adts(6) + b"\xff"),)], "d binary").select(N.adts_frames(F.col("d"))).first()[0]
    assert [bytes(x) for x in frames] == [b"\5" * 5, b"\6" * 6]


def test_annexb_and_lengths(spark):
    rows = spark.createDataFrame([(bytearray(b"\0\0\0\3abc\0\0\0\1d"),), (bytearray(b"\0\0\0\3abc\0\0\0\7d"),), (bytearray(b"zz"),), (None,)], "d binary")
    got = [r[0] and bytes(r[0]) for r in rows.select(N.annexb_of_lengths(F.col("d"))).collect()]
    assert got == [b"\0\0\0\1abc\0\0\0\1d", b"\0\0\0\1abc", b"zz", None]
    strict = [r[0] and [bytes(x) for x in r[0]] for r in rows.select(N.units_of_lengths(F.col("d"), strict=True)).collect()]
    assert strict == [[b"abc", b"d"], None, None, None]


@pytest.mark.parametrize("size", [0, 1, 255, 256, 600])
def test_sei_sizes(size):
    head = bytes([255] * (size // 255) + [size % 255])
    assert list(bits.sei_payloads(b"\x06\x07" + head + b"\x05" * size + b"\x80", 1)) == ([(7, size, b"\x05" * size)] if size else [(7, 0, b"")])
