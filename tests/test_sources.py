"""Containers built byte by byte, read as tables."""

import math
import struct

from pyspark.sql import functions as F

from tracklake.plans import workflows as W
from tracklake.sources import media as M


def sources(spark, **files):
    return M.probe(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "source_id string, data binary"))


def wav(frames, rate=48000, channels=2, extra=True):
    body = bytes(frames * channels * 2)
    more = b"LIST" + struct.pack("<I", 3) + b"abc\0" if extra else b""
    return b"RIFF" + struct.pack("<I", 36 + len(body) + len(more)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + more + b"data" + struct.pack("<I", len(body)) + body


def test_wav_walks_chunks(spark):
    tracks = M.wav_tracks(sources(spark, a=wav(10_000), b=b"FLV123456789", c=b""))
    r = tracks.first()
    assert (r.rate, r.channels, r.bits, r.frames, r.data_offset, r.duration_us) == (48000, 2, 16, 10_000, 56, 208_333)
    packets = M.wav_packets(tracks).orderBy("index").collect()
    assert [(p.offset, p.size) for p in packets] == [(56, 16384), (56 + 16384, 16384), (56 + 32768, 7232)]


def tag(kind, time, body):
    return bytes([kind]) + len(body).to_bytes(3, "big") + (time & 0xFFFFFF).to_bytes(3, "big") + bytes([time >> 24 & 255]) + bytes(3) + body + (len(body) + 11).to_bytes(4, "big")


def test_flv_tags(spark):
    data = b"FLV\x01\x05\x00\x00\x00\x09" + bytes(4)
    data += tag(9, 0, b"\x17\x00\x00\x00\x00cfg") + tag(9, 40, b"\x17\x01\x00\x00\x50key") + tag(9, 80, b"\x27\x01\xff\xff\xd8p") + tag(8, 81, b"\xaf\x01aac") + tag(8, 90, b"\x2fmp3") + b"\x99broken"
    rows = M.flv_tags(sources(spark, a=data)).orderBy("offset").collect()
    assert [(r.kind, r.pts_us, r.dts_us, r.is_key, r.config, r.size) for r in rows] == [
        ("video", 0, 0, True, True, 3), ("video", 120_000, 40_000, True, False, 3), ("video", 40_000, 80_000, False, False, 1), ("audio", 81_000, 81_000, True, False, 3), ("audio", 90_000, 90_000, True, False, 3)]
    assert data[rows[1].offset :][:3] == b"key"


def stamp(us, mark):
    t = us * 9 // 100
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def packet(pid, start, payload):
    fill = 184 - len(payload)
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x30 if fill else 0x10])
    return head + (bytes([fill - 1]) + (b"\0" + b"\xff" * (fill - 2) if fill > 1 else b"") if fill else b"") + payload


def test_transport_stream(spark):
    pes = b"\x00\x00\x01\xe0\x00\x00\x80\xc0\x0a" + stamp(1_000_000, 3) + stamp(960_000, 1)
    data = packet(0x100, True, pes + b"v" * 100) + packet(0x100, False, b"w" * 184) + packet(0x101, True, b"\x00\x00\x01\xc0\x00\x00\x80\x80\x05" + stamp(500_000, 2) + b"aaaa") + packet(0x100, True, pes + b"x") + packet(0x1FFF, False, b"")
    rows = M.ts_pes(M.ts_packets(sources(spark, a=data))).orderBy("pid", "index").collect()
    assert [(r.pid, r.kind, r.pts_us, r.dts_us, r["size"]) for r in rows] == [(256, "video", 1_000_000, 960_000, 284), (256, "video", 1_000_000, 960_000, 1), (257, "audio", 500_000, 500_000, 4)]


def box(name, *body):
    data = b"".join(body)
    return struct.pack(">I", len(data) + 8) + name + data


def full(name, *numbers):
    return box(name, bytes(4), struct.pack(f">{len(numbers)}I", *numbers))


def test_mp4_sample_tables(spark):
    tables = box(b"stbl", full(b"stsz", 0, 5, 10, 20, 30, 40, 50), full(b"stts", 2, 2, 100, 3, 50), full(b"ctts", 1, 2, 7), full(b"stss", 2, 1, 4), full(b"stsc", 2, 1, 2, 1, 2, 1, 1), full(b"stco", 4, 1000, 2000, 3000, 4000))
    track = box(b"trak", box(b"mdia", full(b"mdhd", 0, 0, 1000, 350, 0), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", tables)))
    data = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", track) + box(b"mdat", b"x" * 50)
    boxes = M.mp4_boxes(sources(spark, a=data))
    rows = M.mp4_samples(boxes).orderBy("sample").collect()
    assert [(r.offset, r["size"], r.dts, r.pts, r.is_key) for r in rows] == [(1000, 10, 0, 7, True), (1010, 20, 100, 107, False), (2000, 30, 200, 200, False), (3000, 40, 250, 250, True), (4000, 50, 300, 300, False)]
    t = M.mp4_tracks(boxes).first()
    assert (t.kind, t.timescale, t.duration) == ("video", 1000, 350)


def test_workflows(spark, tmp_path):
    flv = b"FLV\x01\x05\x00\x00\x00\x09" + bytes(4) + b"".join(tag(9, 40 * i, (b"\x17" if i % 3 == 0 else b"\x27") + b"\x01\x00\x00\x00data") for i in range(7)) + b"".join(tag(8, 20 * i, b"\xaf\x01abc") for i in range(5))
    (tmp_path / "a.flv").write_bytes(flv)
    (tmp_path / "b.wav").write_bytes(wav(9000))
    (tmp_path / "c.bin").write_bytes(b"\1\2\3\4")
    files = M.load_files(spark, str(tmp_path))
    assert {r.name: r.format for r in files.collect()} == {"a.flv": "flv", "b.wav": "wav", "c.bin": "unknown"}
    tracks, samples = W.analyse(files)
    assert sorted((r.kind, r.n_samples) for r in tracks.collect()) == [("audio", 3), ("audio", 5), ("video", 7)]
    assert W.overview(spark, str(tmp_path)).count() == 3
    first = W.sample_bytes(W.first_key_sample(samples), files).collect()
    assert [(r.position, bytes(r.data)) for r in first] == [(0, b"data")]
    assert W.audio_packets(samples, 1, 2).count() == 4
    plan = W.remux_plan(samples.where(F.col("track_id").startswith("flv")), "trim_to_audio").orderBy("offset").collect()
    assert [r["size"] for r in plan] == [3] * 5 + [4] * 2
    assert W.source_hex(files.where("name = 'c.bin'")).first().hex == "01 02 03 04"


def test_wav_round_trip(spark):
    values = [math.sin(i / 5) for i in range(100)]
    rows = M.wav_bytes(spark.createDataFrame([("a", values)], "source_id string, v array<double>"), "v", 8000)
    out = rows.select("source_id", F.col("wav").alias("data"))
    t = M.wav_tracks(M.probe(out)).first()
    assert (t.rate, t.channels, t.frames) == (8000, 1, 100)
    data = bytes(out.first().data)
    assert list(struct.unpack("<100h", data[44:])) == [math.floor(v * 32767 + 0.5) for v in values]
