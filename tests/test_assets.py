"""Tracks of many sources: mapping, picking, criteria from outside, and what decoders are asked for."""

import random

import pytest
from pyspark.sql import functions as F

from tracklake.operators import packets as K
from tracklake.operators import selection as S

TRACKS = "source_id string, track_id string, index int, stream_index int, kind string, family string, format string, config binary, rate int"
SAMPLES = "source_id string, stream_index int, kind string, index long, pts_us long, dts_us long, duration_us long, is_key boolean, picture_type string, is_idr boolean, data binary"
AVC, AAC = bytearray(b"\x01\x42\x00\x1e\xff\xe0"), bytearray(b"\x12\x10")


def track(source, n, kind, family=None, config=None, stream=None):
    return (source, f"{source}:{n}", n, n if stream is None else stream, kind, family or ("h264" if kind == "video" else "aac"), "mp4", config, 44_100)


def sample(source, stream, kind, index, pts=None, duration=None, key=False, data=b"\xaa"):
    pts = 1000 * index if pts is None else pts
    return (source, stream, kind, index, pts, pts, duration, key, None, None, None if data is None else bytearray(data))


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ({"start_index": "2.7", "end_index": 3.9, "limit": "4"}, {"start_index": 2, "end_index": 3, "limit": 4}),
        ({"start_index": -3, "end_index": -0.5, "limit": -7}, {"start_index": 0, "end_index": -1, "limit": -1}),
        ({"start_us": float("nan"), "end_us": float("inf"), "start_index": None}, {"start_us": 0, "end_us": -1, "start_index": 0}),
        ({"start_us": 0.5, "end_us": 2.0}, {"start_us": 0.5, "end_us": 2}),
        ({"frame_type": "keys", "order": "size"}, {"frame_type": "all", "order": "presentation"}),
        ({"frame_type": "IDR", "order": "decode"}, {"frame_type": "IDR", "order": "decode"}),
    ],
)
def test_criteria_from_outside(given, expected):
    c = S.Criteria(**given)
    assert {k: getattr(c, k) for k in expected} == expected


def test_map_to_tracks_against_a_loop(spark):
    rng = random.Random(5)
    tracks = [track(s, n, rng.choice(["video", "audio", None]), stream=rng.choice([0, 1, 2, None])) for s in "abc" for n in range(4)]
    samples = [sample(rng.choice(["a", "b", "c", "d", None]), rng.choice([0, 1, 2, 9, None]), rng.choice(["video", "audio", "text", None]), i) for i in range(300)]
    expected, lost = [], 0
    for s, stream, kind, index, *_ in samples:
        own = [t for t in tracks if t[0] == s]
        hit = [t for t in own if stream is not None and t[3] == stream] or [t for t in own if kind is not None and t[4] == kind]
        lost += not hit
        expected += [(index, hit[0][1], f"{hit[0][1]}:{index}")] if hit else []
    found, notes = S.map_to_tracks(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(tracks, TRACKS))
    assert sorted(tuple(r) for r in found.select("index", "track_id", "sample_id").collect()) == sorted(expected)
    assert notes.count() == lost > 0 and expected
    none, notes = S.map_to_tracks(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame([], TRACKS))
    assert none.isEmpty() and notes.count() == 300
    assert notes.columns == ["source_id", "severity", "code", "message"]


def test_one_track_of_each_source(spark):
    tracks = spark.createDataFrame([track("a", 0, "audio"), track("a", 1, "video"), track("a", 2, "video"), track("b", 0, "video"), track("c", 0, "audio")], TRACKS)
    samples = spark.createDataFrame([("a:1", 1), ("a:2", 2), ("b:0", 3), ("c:0", 4)], "track_id string, index int")

    def got(**how):
        picked, own, errors = S.select_tracks(tracks, samples, **how)
        return sorted(r.track_id for r in picked.collect()), sorted(r["index"] for r in own.collect()), sorted(r.source_id for r in errors.collect())

    assert got(kind="video") == (["a:1", "b:0"], [1, 3], ["c"])
    assert got(kind="video", nth=1) == got(kind="video", nth="1.5") == (["a:2"], [2], ["b", "c"])
    assert got() == got(nth=-4) == got(nth="first") == (["a:0", "b:0", "c:0"], [3, 4], [])
    assert got(track_id=" c:0 ", kind="video") == (["c:0"], [4], ["a", "b"])  # an id is enough
    assert got(kind="text") == ([], [], ["a", "b", "c"])


def test_facts_of_selections(spark):
    rows = spark.createDataFrame([("a", i, 100 + 10 * i, 100 + 10 * i, d, i == 1) for i, d in enumerate([5, None, 7])], "track_id string, index long, pts_us long, dts_us long, duration_us long, is_key boolean")
    for c, n, span in ((S.Criteria(), 3, (100, 127)), (S.Criteria(start_us=15, end_us=18), 0, (115, 118)), (S.Criteria(start_us=5, frame_type="key"), 1, (105, 127))):
        facts, notes = S.selection_facts(rows, S.select_samples(rows, c), c)
        assert [tuple(r) for r in facts.collect()] == [("a", n, *span)]
        assert [r.code for r in notes.collect()] == ["selection.empty"] * (n == 0)


@pytest.mark.parametrize("order", ["presentation", "decode"])
def test_marked_samples_are_the_selected(spark, order):
    rng = random.Random(7)
    rows = [(t, i, rng.randrange(50), rng.randrange(50), None, rng.random() < 0.4, None, None) for t in "abc" for i in range(40)]
    samples = spark.createDataFrame(rows, "track_id string, index long, pts_us long, dts_us long, duration_us long, is_key boolean, picture_type string, is_idr boolean")
    for c in (S.Criteria(frame_type="key", order=order, limit=3), S.Criteria(start_us=2, order=order), S.Criteria(limit=0, order=order), S.Criteria(kind="audio", end_index=9, limit=4, order=order)):
        keys = lambda df: sorted((r.track_id, r["index"]) for r in df.collect())
        marked = S.mark_samples(samples, c)
        assert keys(marked.where("is_target")) == keys(S.select_samples(samples, c))
        assert marked.count() == 120


def mapped(spark, tracks, samples):
    tracks = spark.createDataFrame(tracks, TRACKS)
    return S.map_to_tracks(spark.createDataFrame(samples, SAMPLES), tracks)[0], tracks


def codes(notes):
    return sorted((r.source_id, r.severity, r.code) for r in notes.collect())


def test_video_decode(spark):
    tracks = [track("a", 0, "video", config=AVC), track("b", 0, "video"), track("c", 0, "audio", config=AAC), track("d", 0, "video", config=AVC)]
    samples = [sample("a", 0, "video", i, key=i in (1, 4)) for i in range(6)] + [sample(s, 0, k, 0, key=True) for s, k in (("b", "video"), ("c", "audio"))]
    samples += [sample("d", 0, "video", i, data=b"\xaa" if i else None) for i in range(3)]
    rows, tracks = mapped(spark, tracks, samples)
    packets, notes = K.video_decode(rows, tracks)
    # the first key sample; d has none, so all that has bytes
    assert sorted((r.sample_id, r.n) for r in packets.collect()) == [("a:0:1", 1), ("d:0:1", 1), ("d:0:2", 2)]
    assert codes(notes) == [("a:0", "info", "video_decode.eager_decode_skipped"), ("b:0", "error", "video_decode.track"), ("c", "error", "selection.no_track"), ("d:0", "info", "video_decode.eager_decode_skipped"), ("d:0", "warning", "selection.empty")]
    packets, notes = K.video_decode(rows, tracks, S.Criteria(start_index=5), eager=True)
    assert sorted(r.sample_id for r in packets.collect()) == ["a:0:4", "a:0:5"]
    assert ("d:0", "warning", "video_request.empty_targets") in codes(notes) and ("d:0", "warning", "selection.empty") in codes(notes)
    assert codes(K.video_decode(rows, tracks, track_id="c:0")[1]) == [("a", "error", "selection.no_track"), ("b", "error", "selection.no_track"), ("c:0", "error", "video_decode.track"), ("d", "error", "selection.no_track")]


def test_audio_decode(spark):
    tracks = [track("a", 0, "audio", config=AAC), track("m", 0, "audio", family="mp3"), track("x", 0, "audio"), track("v", 0, "video", config=AVC)]
    samples = [sample("a", 0, "audio", i, 1_000_000 * i, 1_000_000 if i != 2 else None) for i in range(5)]
    samples += [sample("m", 0, "audio", i, 1_000_000 * i, None, data=None) for i in range(5)] + [sample("x", 0, "audio", 0)]
    rows, tracks = mapped(spark, tracks, samples)
    packets, ranges, notes = K.audio_decode(rows, tracks, "1.5", 3)
    # a sample without duration ends where it starts, and the last packet's duration is its own or that of a frame
    assert [(r.sample_id, r.duration_us, r.is_key, r.n) for r in packets.orderBy("n").collect()] == [("a:0:1", 1_000_000, True, 1), ("a:0:2", 23_220, True, 2)]
    assert sorted(tuple(r) for r in ranges.collect()) == [("a:0", 1_500_000, 3_000_000), ("m:0", 1_500_000, 3_000_000)]
    assert codes(notes) == [("m:0", "error", "audio_request.missing_packet_data"), ("v", "error", "selection.no_track"), ("x:0", "error", "audio_decode.track")]
    loud = rows.withColumn("data", F.coalesce("data", F.lit(b"\xbb")))
    heard = K.audio_decode(loud, tracks, 1.5, 3)[0].where("track_id = 'm:0'")
    assert sorted((r.sample_id, r.duration_us) for r in heard.collect()) == [("m:0:1", 1_000_000), ("m:0:2", 23_220)]
    assert sorted(tuple(r) for r in K.audio_decode(rows, tracks)[1].collect()) == [("a:0", 0, 5_000_000), ("m:0", 0, 4_000_000)]
    empty = K.audio_decode(rows, tracks, 9)
    assert empty[0].isEmpty() and ("a:0", "warning", "audio_request.empty_range") in codes(empty[2])
