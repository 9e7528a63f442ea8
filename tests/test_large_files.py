"""Files in byte ranges against walks over whole files, files as a sink, and one walk against the readers of each container."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tracklake.plans import workflows as flows
from tracklake.sources import audio as A
from tracklake.sources import media as M
from tracklake.sources import mp4, ranges, sink, walk
from tracklake.sources import flv as V

from .test_containers import flv_movie, sps
from .test_sources import packet, sources, stamp, wav


def transport_stream(n=60, seed=1, junk=True):
    """Streams with packets of many sizes, some junk between packets, and a packet cut at the end."""
    rng, out, left = random.Random(seed), b"", {}
    for i in range(n):
        pid, kind = rng.choice([(257, 0xE0), (258, 0xC0)])
        pes = b"\0\0\1" + bytes([kind]) + b"\0\0\x80\x80\5" + stamp(40_000 * i, 2) + bytes(rng.randrange(256) for _ in range(rng.randrange(700)))
        parts = [pes[j : j + 184] for j in range(0, len(pes), 184)]
        left.setdefault(pid, []).extend((k == 0, p) for k, p in enumerate(parts))
    while any(left.values()):
        pid = rng.choice([p for p, q in left.items() if q])
        first, payload = left[pid].pop(0)
        out += packet(pid, first, payload)
        if junk and rng.random() < 0.05:
            out += bytes(rng.randrange(256) for _ in range(rng.randrange(1, 250)))
    return out + b"\x47" + bytes(50)


def write(folder, **files):
    for name, data in files.items():
        (folder / name).write_bytes(data)


@pytest.mark.parametrize("split", [700, 4096, 1 << 20])
def test_transport_splits(spark, tmp_path, split):
    data = {"a.ts": transport_stream(), "b.ts": transport_stream(30, 2, junk=False), "c.ts": b"", "d.ts": bytes(3000)}
    write(tmp_path, **data)
    got = {(os.path.basename(r.path), r.pid, r["index"], r.kind, r.pts_us, r["size"], bytes(r.data)) for r in ranges.ts_pes(spark, str(tmp_path), split, with_data=True).collect()}
    whole = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "source_id string, data binary")
    # the packets of a whole file, without the test by which files are sniffed
    rows = whole.mapInArrow(M._packets, "source_id string, index long, p binary")
    rows = [(r.source_id, r["index"], bytes(r.p)) for r in rows.collect()]
    expected = set()
    for name in data:
        for pid in (257, 258):
            now = None
            for index, p in [(i, p) for s, i, p in rows if s == name and (p[1] & 31) << 8 | p[2] == pid and p[3] >> 4 & 3 in (1, 3)] + [(None, None)]:
                start = p is None or p[1] & 0x40
                if start and now:
                    kind = walk.pes_kind(now[2])
                    if kind:
                        t = now[2][9:14]
                        ticks = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
                        expected.add((name, pid, now[0], kind, int(ticks * 100 / 9 + 0.5), len(now[1]) - 14, now[1][14:]))
                if p is not None:
                    skip = 5 + p[4] if p[3] >> 4 & 2 else 4
                    if start:
                        now = [index, p[skip:], p[skip:]]
                    elif now:
                        now[1] += p[skip:]
    assert got == expected and len(got) > 80


def sound(n=80, seed=3, tail=b"TAG", head=b"ID3\4\0\0\0\0\0\x0a" + bytes(10)):
    rng, out = random.Random(seed), head
    for _ in range(n):
        rate = rng.randrange(1, 15)
        size = 144 * A.RATES_1[rate] * 1000 // 44100
        out += b"\xff\xfb" + bytes([rate << 4, 0xC0]) + bytes(rng.choice([0xFF, 0xFB, 0x90, 0]) for _ in range(size - 4))  # false headers inside
    return out + tail


@pytest.mark.parametrize("split", [1500, 5000, 1 << 20])
def test_mp3_splits(spark, tmp_path, split):
    big = b"ID3\4\0\0" + bytes([0, 0, 40, 0]) + bytes(5120)
    files = {"a.mp3": sound(), "b.mp3": sound(40, 4, head=big), "c.mp3": sound(20, 5) + sound(5, 6), "d.mp3": b"ID3" + bytes(100), "e.mp3": b"\xff\xfb" + bytes(9000) + sound(9, 7, head=b"")}
    write(tmp_path, **files)
    names = ["index", "offset", "size", "rate", "bitrate", "pts_us", "duration_us"]
    got = {(os.path.basename(r.path), *[r[k] for k in names]) for r in ranges.mp3_frames(spark, str(tmp_path), split).collect()}
    whole = A.mp3_frames(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "source_id string, data binary"))
    assert got == {(r.source_id, *[r[k] for k in names]) for r in whole.collect()} and len(got) > 100


def test_wav_heads(spark, tmp_path):
    write(tmp_path, **{"a.wav": wav(5000), "b.wav": wav(77, 8000, 1, extra=False), "c.wav": b"RIFF", "d.wav": b""})
    got = {os.path.basename(r.path): (r.rate, r.channels, r.bits, r.data_offset, r.frames, r.duration_us) for r in ranges.wav_tracks(spark, str(tmp_path)).collect()}
    whole = M.wav_tracks(sources(spark, **{"a.wav": wav(5000), "b.wav": wav(77, 8000, 1, extra=False)}))
    assert got == {r.source_id: (r.rate, r.channels, r.bits, r.data_offset, r.frames, r.duration_us) for r in whole.collect()} and len(got) == 2


# --- files as a sink


def test_pieces_become_files(spark, tmp_path):
    rows = [(f"f{i % 7}/x", i, bytearray(b"%d," % i)) for i in range(500)] + [("empty", 0, None)]
    sink.write_files(spark.createDataFrame(rows, "name string, n int, data binary").repartition(5), str(tmp_path / "out"), order=["n"])
    found = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert found == {**{f"f{k}%2Fx": b"".join(b"%d," % i for i in range(500) if i % 7 == k) for k in range(7)}, "empty": b""}


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    def fail(batches):
        for batch in batches:
            if "f3" in batch.column("name").to_pylist():
                raise RuntimeError("lost")
            yield batch

    spark.dataSource.register(sink.Pieces)
    rows = spark.createDataFrame([(f"f{i}", bytearray(b"x" * 10)) for i in range(8)], "name string, data binary").repartition(8, "name")
    with pytest.raises(Exception, match="lost"):
        rows.mapInArrow(fail, rows.schema).write.format("pieces").option("path", str(tmp_path / "out")).mode("append").save()
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="side by side"):
        rows.coalesce(1).union(rows.coalesce(1)).coalesce(1).write.format("pieces").option("path", str(tmp_path / "two")).mode("append").save()
    assert not [p for p in (tmp_path / "two").rglob("*") if p.is_file()]


def movie_rows(spark):
    rows = []
    for f, n in (("m", 40), ("k/1", 7)):
        rows += [(f, "v", i, 40_000 * i + (20_000 if i % 3 else 0), 40_000 * i, None, i % 5 == 0, bytearray(bytes([i]) * (i % 9 + 1))) for i in range(n)]
        rows += [(f, "a", i, 21_333 * i, 21_333 * i, 21_333, True, bytearray(b"s" * (i % 4 + 1))) for i in range(2 * n)]
    samples = spark.createDataFrame(rows, "file_id string, track_id string, index long, pts_us long, dts_us long, duration_us long, is_key boolean, data binary")
    config = bytes.fromhex("0142c01effe100046742c01e01000268ce")
    tracks = [(f, t, k, c, bytearray(b), 320, 180, 48_000, 2) for f in ("m", "k/1") for t, k, c, b in (("v", "video", "h264", config), ("a", "audio", "aac", b"\x11\x90"))]
    return rows, samples, spark.createDataFrame(tracks, "file_id string, track_id string, kind string, codec string, config binary, width int, height int, rate int, channels int")


def read_back(rows):
    return sorted((r.source_id, r.kind, r["index"], r.dts_us, r.pts_us, r.is_key, bytes(r.data)) for r in rows.where("what = 'sample'").collect())


@pytest.mark.parametrize("wide", [False, True])
def test_movies_on_disk(spark, tmp_path, monkeypatch, wide):
    """Interleaved chunks, 32-bit and 64-bit places; the same samples as the movie in one cell."""
    if wide:
        monkeypatch.setattr(mp4, "MOST_PLACE", (1 << 28) + 10)
    rows, samples, tracks = movie_rows(spark)
    made = mp4.mux(samples, tracks).select(F.col("file_id").alias("source_id"), "data")
    sink.write_files(mp4.segments(samples, tracks, 200_000), str(tmp_path / "out"), "file_id", order=["start_us", "number", "n"])
    disk = M.load_files(spark, str(tmp_path / "out")).select(F.regexp_replace("name", "%2F", "/").alias("source_id"), "data")
    expected, got = (read_back(walk.files(x, ("mp4",), with_data=True)) for x in (made, disk))
    assert got == expected and len(got) == len(rows)
    assert [x[-1] for x in got if x[:2] == ("m", "video")] == [bytes(r[-1]) for r in rows if r[0] == "m" and r[1] == "v"]
    boxes = M.mp4_boxes(disk)
    names = {r.name for r in boxes.collect()}
    assert ("co64" in names) == wide and ("stco" in names) != wide
    table = boxes.where("name in ('stco', 'co64')").select(F.max(F.conv(F.hex(F.substring("body", 5, 4)), 16, 10).cast("int"))).first()[0]
    assert table > 5  # chunks
    whole = {r.source_id: bytes(r.data) for r in disk.collect()}
    assert b"mdat" in whole["m"] and len(whole["m"]) == sum(r["size"] for r in boxes.where("source_id = 'm' and name in ('ftyp', 'moov', 'mdat')").collect())


# --- one walk


def adts(n):
    return b"\xff\xf1\x50\x80" + ((n + 7) << 5 | 0x1F).to_bytes(2, "big") + b"\xfc" + bytes([n]) * n


def mapped_stream():
    section = lambda body: b"\0" + body + bytes(4)
    pmt = b"\2\xb0\x17\0\1\xc1\0\0\xe1\1\xf0\0\x1b\xe1\1\xf0\0\x0f\xe1\2\xf0\0"
    out = packet(0, True, section(b"\0\xb0\x0d\0\1\xc1\0\0\0\1\xe1\0")) + packet(256, True, section(pmt))
    for i in range(6):
        unit = b"\0\0\0\1" + sps(320, 180, 25) + b"\0\0\0\1\x68\xce\0\0\1\x65key" if i % 3 == 0 else b"\0\0\1\x41p%d" % i
        pes = b"\0\0\1\xe0\0\0\x80\x80\5" + stamp(40_000 * i, 2) + unit + bytes([i + 1]) * 300
        out += packet(257, True, pes[:184]) + b"".join(packet(257, False, pes[j : j + 184]) for j in range(184, len(pes), 184))
        out += packet(258, True, b"\0\0\1\xc0\0\0\x80\x80\5" + stamp(40_000 * i, 2) + adts(5)) + packet(300, True, b"\0\0\1\xe0\0\0\x80\x80\5" + stamp(1, 2) + b"not in the map")
    return out


def program_stream():
    return b"\0\0\1\xba\x44\0\4\0\4\1\0\0\3\xf8" + b"".join(b"\0\0\1" + bytes([k]) + (8 + n).to_bytes(2, "big") + b"\x80\x80\5" + stamp(40_000 * n, 2) + b"p" * n for n, k in ((3, 0xE0), (5, 0xC0), (7, 0xE0)))


def every_container(spark):
    _, samples, tracks = movie_rows(spark)
    movie = bytes(mp4.mux(samples, tracks).where("file_id = 'm'").first().data)
    flac = b"fLaC\0\0\0\x22" + bytes(10) + struct.pack(">Q", 44100 << 44 | 1 << 41 | 15 << 36 | 88200) + bytes(16)
    opus = b"OggS" + bytes(24) + b"OpusHead\1\2" + struct.pack("<HI", 312, 48000) + bytes(3)
    return sources(spark, f=flv_movie(), w=wav(5000), m=sound(9), t=mapped_stream(), p=program_stream(), v=movie, c=flac, o=opus, x=b"nothing", e=b"").union(spark.createDataFrame([("n", None, None, None)], "s string, d binary, f string, c double"))


def test_one_walk_equals_the_readers(spark):
    every = every_container(spark)
    with flows.Walk(every) as found:
        samples = flows.analyse(found)[1]
        got = {k: sorted((r["index"] if k in "mv" else 0, r.pts_us, r["size"]) for r in samples.where(F.col("source_id") == k).collect()) for k in "fwmtpv"}
        plan = samples._jdf.queryExecution().executedPlan().toString()
        streams = {(r.source_id, r.kind): r for r in flows.streams(found).collect()}
        table = {(r.source_id, r.kind): r.n_samples for r in flows.track_table(found).collect()}
    rows = lambda df: sorted((0, r.pts_us, r["size"]) for r in df.collect())
    assert got["f"] == rows(M.flv_tags(every).where("not config and kind != 'script'"))
    assert got["w"] == rows(M.wav_packets(M.wav_tracks(every)))
    assert got["m"] == sorted((r["index"], r.pts_us, r["size"]) for r in A.mp3_frames(every.where("source_id = 'm'")).collect())
    assert got["t"] == rows(M.ts_pes(M.ts_packets(every)).where("pid != 300"))
    assert len(got["p"]) == 3 and len(got["v"]) == 120
    assert "InMemoryTableScan" in plan and "MapInArrow" in plan.split("InMemoryRelation")[1]
    assert {k: n for k, n in table.items() if k[0] != "e"} == {("f", "video"): 6, ("f", "audio"): 9, ("w", "audio"): 2, ("m", "audio"): 9, ("t", "video"): 6, ("t", "audio"): 6, ("p", "video"): 2, ("p", "audio"): 1, ("v", "video"): 40, ("v", "audio"): 80, ("c", "audio"): 0, ("o", "audio"): 0}
    assert (streams["t", "video"].width, streams["t", "audio"].rate, streams["v", "video"].codec, streams["c", "audio"].rate) == (320, 44100, "avc1", 44100)
    pictures = [(r.picture_type, r.is_key, r.is_idr) for r in samples.where("source_id = 't' and kind = 'video'").orderBy("index").collect()]
    assert pictures == [("I", True, True) if i % 3 == 0 else ("P", False, False) for i in range(6)]


def test_sniffing_in_a_walk(spark):
    """The walk tells containers apart as the column function does."""
    every = every_container(spark).where("data is not null")
    assert all((walk.sniff(bytes(r.data)) or "unknown") == r.format for r in every.collect())
    rng = random.Random(8)
    heads = [b"FLV", b"RIFF\0\0\0\0WAVE", b"\0\0\0\0ftyp", b"\x47", b"\xff\xe0", b"\xff\xdf", b"ID3", b"OggS", b"OggS" + bytes(24) + b"Opus", b"\0\0\1\xba", b"fLaC", b""]
    data = [h + bytes(rng.choice([0, 0x47, 255]) for _ in range(rng.choice([0, 1, 7, 8, 20, 186, 187, 188, 400]))) for h in heads for _ in range(6)]
    data += [bytes(0x47 if i % 188 == 0 else 0 for i in range(n)) for n in (187, 188, 189, 376, 939, 940, 1000)]
    rows = M.probe(spark.createDataFrame([(str(i), bytearray(d)) for i, d in enumerate(data)], "source_id string, data binary")).collect()
    assert [(walk.sniff(bytes(r.data)) or "unknown") for r in rows] == [r.format for r in rows]


def test_bytes_are_cut_per_file(spark):
    every = every_container(spark)
    samples = flows.analyse(every, ("flv", "mp4"))[1]
    got = {(r.track_id, r["index"]): bytes(r.data) for r in flows.sample_bytes(samples, every).collect()}
    with flows.Walk(every, ("flv", "mp4"), with_data=True) as found:
        assert got == {(r.track_id, r["index"]): bytes(r.data) for r in flows.samples_of(found.rows, True, ("flv", "mp4")).collect()} and len(got) == 135
    joined = flows.sample_bytes(samples, every)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in joined.splitlines()) == 1 and "collect_list" in joined


def test_sample_tables_that_end_early():
    be = lambda *x: struct.pack(f">{len(x)}I", *x)
    tables = {"stsz": be(0, 0, 5, 1, 2, 3, 4, 5), "stts": be(0, 1, 2, 10), "stsc": be(0, 2, 1, 1, 1, 2, 2, 1), "stco": be(0, 2, 100, 200), "stss": be(0, 1, 3), "ctts": be(0, 1, 1) + struct.pack(">i", -7)}
    got = M.sample_table(tables)
    assert {k: v.tolist() for k, v in got.items()} == {"offset": [100, 200, 202], "size": [1, 2, 3], "dts": [0, 10, 20], "pts": [-7, 10, 20], "is_key": [False, False, True]}
    assert all(not len(v) for v in M.sample_table({}).values())
    assert all(not len(v) for v in M.sample_table({"stsz": b"\0", "stts": None}).values())
    assert V.amf_values(b"\5", 0) == ([], 1)
