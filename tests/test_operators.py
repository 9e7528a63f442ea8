"""Operators on small tables with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tracklake.functions import bytesql as B
from tracklake.functions import pcm as P
from tracklake.operators import selection as S
from tracklake.operators import timeline as T

SCHEMA = "track_id string, index long, pts_us long, dts_us long, duration_us long, is_key boolean, picture_type string, is_idr boolean, size long, is_target boolean"


def samples(spark, rows=None, targets=()):
    rows = rows or [(0, 0, True, "IDR"), (1, 40_000, False, "P"), (2, 80_000, False, "B"), (3, 120_000, True, "I"), (4, 160_000, False, "P"), (5, 200_000, False, "B")]
    return spark.createDataFrame([("v1", i, 1_000_000 + t, 1_000_000 + t, 40_000, k, p, None, 100, i in targets) for i, t, k, p in rows], SCHEMA)


@pytest.mark.parametrize(
    ("criteria", "expected"),
    [
        ({"start_index": 1, "end_index": 3}, [1, 2, 3]),
        ({"start_us": 80_000, "end_us": 200_000, "frame_type": "B"}, [2]),
        ({"end_index": -1}, [0, 1, 2, 3, 4, 5]),
        ({"frame_type": "key"}, [0, 3]),
        ({"frame_type": "non_key"}, [1, 2, 4, 5]),
        ({"frame_type": "key", "limit": 1}, [0]),
        ({"frame_type": "IDR"}, [0]),
        ({"limit": 0}, []),
    ],
)
def test_selection(spark, criteria, expected):
    assert sorted(r["index"] for r in S.select_samples(samples(spark), S.Criteria(**criteria)).collect()) == expected


def test_no_track(spark):
    tracks = spark.createDataFrame([("v1", 0, "video")], "track_id string, index int, kind string")
    with pytest.raises(S.NoTrack):
        S.select_track(tracks, samples(spark), "other")
    assert S.select_track(tracks, samples(spark), kind="video", nth=0)[1].count() == 6


@pytest.mark.parametrize(("targets", "expected"), [([2], [0, 1, 2]), ([2, 5], [0, 1, 2, 3, 4, 5]), ([4], [3, 4])])
def test_gop_closure(spark, targets, expected):
    assert sorted(r["index"] for r in T.gop_closure(samples(spark, targets=targets)).collect()) == expected


def test_targets_without_key(spark):
    rows = samples(spark, [(0, 0, False, "P"), (1, 33_000, False, "P")], [1])
    assert T.gop_closure(rows).count() == 2
    assert [r["index"] for r in T.orphan_targets(rows).collect()] == [1]


def test_audio_overlap(spark):
    rows = samples(spark).withColumn("duration_us", F.lit(0).cast("long"))
    got = S.select_samples(rows, S.Criteria(start_us=50_000, end_us=90_000, kind="audio")).collect()
    assert sorted(r["index"] for r in got) == [1, 2]  # the first lasts until the next starts


def test_nearest_within_tolerance(spark):
    queries = samples(spark, [(10, 41_000, False, "B"), (11, 60_000, False, "B"), (12, 99_000, False, "B")])
    got = {r["query"]: r["target"] for r in T.nearest_target(queries, samples(spark), 20_000).collect()}
    assert got == {10: 1, 11: 1, 12: 2}
    assert {r["target"] for r in T.nearest_target(queries, samples(spark), 500).collect()} == {None}


@pytest.mark.parametrize(
    ("data", "name"),
    [(b"FLV\x01\x00\x00\x00\x00\x09\x00\x00\x00\x00", "flv"), ((b"\x47\x1f\xff\x10" + bytes(184)) * 5, "mpegts"), (b"\x00\x00\x01\xba" + bytes(8), "mpegps"), (b"\x00\x00\x00\x10ftypisom" + bytes(4), "mp4"),
     (b"RIFF\x00\x00\x00\x00WAVEfmt ", "wav"), (b"fLaC" + bytes(38), "flac"), (b"\xff\xfb\x90\x64", "mp3"), (b"OggS" + bytes(24) + b"OpusHead" + bytes(11), "opus"), (b"\x01\x02\x03\x04", "unknown"), (b"", "unknown")],
)
def test_container_format(spark, data, name):
    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(B.container_format(F.col("b"))).first()[0]
    assert got == name


def test_pcm(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    ramp = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    assert value(P.trim(ramp, 4, F.lit(0), F.lit(500_000), F.lit(1_000_000))) == [0.5, 0.75]
    assert value(P.resample_linear(F.array(F.lit(0.0), F.lit(1.0)), 8000, 16000)) == pytest.approx([0.0, 1 / 3, 2 / 3, 1.0])
    assert len(value(P.resample_linear(ramp, 48000, 24000))) == 3
    assert value(P.quantise16(F.array(F.lit(2.0), F.lit(-2.0), F.lit(0.0)))) == [32767, -32767, 0]
    assert value(P.interleave(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))) == [1, 3, 2, 4]
    assert value(P.moving_average(F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0)), 2)) == [1.0, 2.0, 4.0]
    header = bytes(value(P.wav_header(F.lit(100), 48000, 2)))
    assert header[:4] == b"RIFF" and len(header) == 44 and int.from_bytes(header[40:44], "little") == 400


def test_g711(spark):
    got = spark.range(256).select(B.ulaw_to_pcm16(F.col("id").cast("int")).alias("u"), B.alaw_to_pcm16(F.col("id").cast("int")).alias("a")).collect()
    assert (got[0].u, got[127].u, got[128].u, got[255].u) == (-32124, 0, 32124, 0)
    assert (got[0xD5].a, got[0x55].a, got[0x2A].a, got[0xAA].a) == (8, -8, -32256, 32256)


def test_ids(spark):
    def fnv(text):
        h = 2166136261
        for c in text.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        return f"selection:{h:08x}"

    rows = spark.createDataFrame([("",), ("a",), ("hello, world",)], "t string")
    assert [r[0] for r in rows.select(B.selection_id(F.col("t"))).collect()] == [fnv(t) for t in ("", "a", "hello, world")]
