"""Packets, requests, pictures, filters and rings against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracklake.functions import pcm as P
from tracklake.functions import planes
from tracklake.functions import writers as W
from tracklake.operators import packets as K
from tracklake.streaming import rings as R

from .test_streaming import run


def samples(spark, n=6, keys=(0, 3), empty=()):
    rows = [("v", f"s{i}", i, 1000 * i, 1000 * i, None, i in keys, bytearray(b"" if i in empty else b"\xaa" * (i + 1))) for i in range(n)]
    return spark.createDataFrame(rows, "track_id string, sample_id string, index long, pts_us long, dts_us long, duration_us long, is_key boolean, data binary")


TRACK = [("v", "video", "h264", "mp4")]
TRACK_SCHEMA = "track_id string, kind string, family string, format string"


@pytest.mark.parametrize(
    ("targets", "expected"),
    [
        (K.Targets(sample_ids=("s2", "s5"), positions=(0,)), [2, 5]), (K.Targets(positions=(1, 4), pts_us=(0,)), [1, 4]), (K.Targets(pts_us=(3000, 9)), [3]),
        (K.Targets(start_index=1, end_index=4, start_us=2000), [2, 3, 4]), (K.Targets(end_us=2000), [0, 1, 2]), (K.Targets(frame_type="key", limit=1), [0]), (K.Targets(limit=0), []),
    ],
)
def test_targets(spark, targets, expected):
    assert sorted(r["index"] for r in K.target_samples(samples(spark), targets).where("is_target").collect()) == expected


def test_decode_request_tells_what_is_missing(spark):
    tracks = spark.createDataFrame(TRACK, TRACK_SCHEMA)
    packets, notes = K.decode_request(samples(spark, keys=(3,), empty=(4,)), tracks, K.Targets(positions=(1, 4)))
    assert [r.sample_id for r in packets.orderBy("n").collect()] == ["s0", "s1", "s3"]
    assert [(r.code, r.message) for r in notes.collect()] == [("video_request.no_preceding_keyframe", "1 targets before any key sample")]
    nothing = K.decode_request(samples(spark, empty=range(6)), tracks, K.Targets(positions=(1,)))[1]
    assert [r.code for r in nothing.collect()] == ["video_request.missing_packet_data"]
    assert [r.code for r in K.decode_request(samples(spark), tracks, K.Targets(limit=0))[1].collect()] == ["video_request.empty_targets"]
    whole, notes = K.decode_request(samples(spark), tracks, K.Targets())
    assert whole.count() == 6 and not notes.collect()
    some, notes = K.decode_request(samples(spark), tracks, K.Targets(), most_packets=4)
    assert some.count() == 4 and [(r.code, r.message) for r in notes.collect()] == [("video_request.truncated", "only the first 4 packets are taken, 2 are not")]


def test_long_ranges_are_told(spark):
    chosen = spark.createDataFrame([("a", 0), ("a", 400_000_000), ("b", 5)], "track_id string, pts_us long")
    assert not K.audio_range(chosen).where("too_long").collect()
    ranges = K.audio_range(chosen, most_us=300_000_000)
    assert [(r.code, r.message) for r in K.range_errors(ranges).collect()] == [("audio_request.range_too_long", "400.0 seconds")]


def test_filters_equal_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [([rng.uniform(-1, 1) for _ in range(n)],) for n in (0, 1, 7, 200)] + [(None,)]
    df = spark.createDataFrame(rows, "x array<double>").coalesce(1)
    for kind in ("lowpass", "highpass", "bandpass", "lowshelf", "highshelf", "peaking", "notch", "allpass"):
        b, a = P.biquad(kind, 900.0, 8000, 1.5, 6.0, 50.0)
        got = [r[0] for r in df.select(P.filtered(F.col("x"), b, a)).collect()]
        for (x,), y in zip(rows, got, strict=True):
            if x is None:
                assert y is None
                continue
            out = []
            for i, v in enumerate(x):
                past = lambda z, k: z[i - k] if i >= k else 0.0  # noqa: B023, E731
                out.append(b[0] * v + b[1] * past(x, 1) + b[2] * past(x, 2) - a[1] * past(out, 1) - a[2] * past(out, 2))
            assert y == pytest.approx(out)


def test_filters_at_their_ends():
    gain = lambda ba, w: abs(sum(c * complex(math.cos(w * k), -math.sin(w * k)) for k, c in enumerate(ba[0])) / sum(c * complex(math.cos(w * k), -math.sin(w * k)) for k, c in enumerate(ba[1])))
    assert gain(P.biquad("lowpass", 500, 8000), 0) == pytest.approx(1) and gain(P.biquad("lowpass", 500, 8000), math.pi) == pytest.approx(0, abs=1e-9)
    assert gain(P.biquad("highpass", 500, 8000), 0) == pytest.approx(0, abs=1e-9) and gain(P.biquad("allpass", 500, 8000), 1.0) == pytest.approx(1)
    assert gain(P.biquad("lowshelf", 500, 8000, gain_db=6.0), 0) == pytest.approx(10 ** (6 / 20)) and gain(P.biquad("highshelf", 500, 8000, gain_db=6.0), math.pi) == pytest.approx(10 ** (6 / 20))
    assert gain(P.biquad("peaking", 1000, 8000, 2.0, -6.0), 2 * math.pi / 8) == pytest.approx(10 ** (-6 / 20))


def test_pictures(spark):
    rng = random.Random(4)
    buffer = bytes(rng.randrange(256) for _ in range(400))
    one = spark.createDataFrame([(bytearray(buffer),)], "d binary")
    lit = F.lit
    got = one.select(planes.nv12_to_i420(F.col("d"), (lit(3), lit(20)), (lit(150), lit(18)), lit(9), lit(7)).alias("p")).first().p
    rows = [buffer[150 + 18 * r : 150 + 18 * r + 10] for r in range(4)]
    assert bytes(got.y) == b"".join(buffer[3 + 20 * r : 12 + 20 * r] for r in range(7))
    assert (bytes(got.u), bytes(got.v)) == (b"".join(r[::2] for r in rows), b"".join(r[1::2] for r in rows))
    assert one.select(planes.i420_planes(F.col("d"), lit(9), lit(7))).first()[0] is None


def test_numbers(spark):
    values = [0.0, 1.0, -2.5, 1e-300, 1.7976931348623157e308, 44100.0, 0.1, 3.0000000000000004]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in rows.select(W.float_be(W.double_be(F.col("x")), 0, 8)).collect()] == values
    one = spark.range(1)
    assert one.select(W.float_be(F.lit(b"\x3f\xc0\0\0"), 0, 4), W.float_be(F.lit(b"\x7f\x80\0\0"), 0, 4), W.float_be(F.lit(b"\1"), 0, 4)).first()[:] == (1.5, math.inf, None)
    assert one.select(W.base36(F.lit(-1295)), W.base36(F.lit(0))).first()[:] == ("-zz", "0")
    assert [bytes(x) for x in one.select(W.be(F.lit(-1), 4), W.be(F.lit(258), 2), W.joined(F.array(F.lit(b"a"), F.lit(None).cast("binary"), F.lit(b"b")))).first()] == [b"\xff" * 4, b"\1\2", b"ab"]


def plain_ring(rows, capacity, underrun, overrun):
    held, snapshot, under, over, out = [], [], 0, 0, []
    for idx, values, want in rows:
        taken, read = 0, []
        if values is not None:
            left = list(values)
            while left:
                free = capacity - len(held)
                if not free:
                    if overrun == "drop_newest":
                        over += len(left)
                    if overrun != "drop_oldest":
                        break
                    drop = min(len(held), max(len(left), capacity // 4))
                    held, over = held[drop:], over + drop
                    continue
                held, taken, left = held + left[:free], taken + len(left[:free]), left[free:]
            snapshot = snapshot or list(held)
        else:
            while len(read) < want:
                if held:
                    read.append(held.pop(0))
                elif underrun == "wait":
                    break
                elif underrun == "loop" and snapshot:
                    under, held = under + 1, snapshot[:capacity]
                else:
                    under += 1
                    read.append(0.0)
        out.append((idx, taken, read, len(held), under, over))
    return out


@pytest.mark.parametrize(("underrun", "overrun"), [("silence", "drop_oldest"), ("wait", "drop_newest"), ("loop", "block_producer")])
def test_sample_ring(spark, tmp_path, underrun, overrun):
    rng = random.Random(5)
    rows = [(1, i, [rng.random() for _ in range(rng.randint(1, 9))] if i % 3 != 2 else None, rng.randint(1, 12)) for i in range(30)]
    schema = "track_id long, idx long, samples array<double>, want long"
    spark.createDataFrame(rows[:14], schema).coalesce(1).write.parquet(str(tmp_path / "a" / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "a" / "in"))
    out = R.replayed(R.sample_ring(stream, 8, underrun, overrun), str(tmp_path)).orderBy("idx").collect()
    expected = plain_ring([r[1:] for r in rows[:14]], 8, underrun, overrun)
    assert [(r.idx, r.taken, list(r.samples), r.available, r.underruns, r.overruns) for r in out] == expected


def test_packet_ring_with_delay(spark, tmp_path):
    """Nothing leaves before its delay, a full ring drops its oldest, and an end lets out the rest."""
    rows = run(spark, tmp_path, lambda s: R.packet_ring(s.where("track_id = 1"), capacity=3, delay_us=2500, ends="idx = 11"), "delayed")
    assert all(r.pts_us <= r.clock_us for r in rows if r.clock_us < 8500) and rows
    spark.createDataFrame([(1, i, 1000 * i) for i in range(12)], "track_id long, idx long, pts_us long").coalesce(1).write.parquet(str(tmp_path / "b"))
    stream = spark.readStream.schema("track_id long, idx long, pts_us long").parquet(str(tmp_path / "b"))
    got = sorted((r.idx, r.clock_us, r.overruns) for r in R.replayed(R.packet_ring(stream, 2, 2500, ends="idx = 11"), str(tmp_path / "c")).collect())
    ring, clock, over, expected = [], -(1 << 62), 0, []
    for i in range(12):
        clock = max(clock, 1000 * i - 2500)
        if len(ring) == 2:
            ring, over = ring[1:], over + 1
        ring.append(i)
        expected += [(x, clock, over) for x in ring if 1000 * x <= clock or i == 11]
        ring = [x for x in ring if 1000 * x > clock and i != 11]
    assert got == sorted(expected) and over > 0


def test_ring_settings(spark):
    c = R.RingConfig(fill="?", rate=-3.0, capacity_seconds=0.0)
    assert (c.fill, c.rate, c.capacity_seconds) == ("static_once", 0.05, 0.05)
    with pytest.raises(ValueError, match="table or a stream"):
        R.ring_source(c)
    with pytest.raises(ValueError, match="needs a stream"):
        R.ring_source(R.RingConfig(fill="continuous"), static=spark.range(1))
    assert R.ring_source(c, static=spark.range(3)).count() == 3
