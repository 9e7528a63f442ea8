"""Streams over many micro-batches, out of order, and started again in the middle, against plain machines."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracklake.streaming import live

MS, DAY = 1000, 86_400_000_000  # times lie after the epoch, where watermarks start


def feed(spark, folder, parts, schema):
    """One file for each part; the last one only moves the watermark on."""
    for part in parts:
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros(F.col("us") + DAY)).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder, schema):
    return spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, tmp_path, name="out"):
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / name)).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()


def shuffled(rows, size, seed, reach):
    """Rows that come at most ``reach`` places too late, in parts."""
    rng = random.Random(seed)
    rows = [r for _, r in sorted((i + rng.randrange(reach), r) for i, r in enumerate(rows))]
    return [rows[i : i + size] for i in range(0, len(rows), size)]


PACKETS = "track_id long, idx long, pts_us long, us long"


def test_held_packets_leave_by_event_time(spark, tmp_path):
    rows = [(t, i, 200 * MS * i, 200 * MS * i) for i in range(40) for t in (1, 2) if t == 1 or i < 12]  # track 2 falls silent
    parts = shuffled(rows, 12, 1, 6)
    half = len(parts) // 2
    last = [(9, 0, 10**8, 10**8)]
    feed(spark, tmp_path / "in", parts[:half], PACKETS)
    first = run(live.released(source(spark, tmp_path / "in", PACKETS), late="1 second"), tmp_path)
    assert 0 < len(first) < len(rows)
    feed(spark, tmp_path / "in", [*parts[half:], last], PACKETS)  # the query starts again from its checkpoint
    got = run(live.released(source(spark, tmp_path / "in", PACKETS), late="1 second"), tmp_path)
    assert sorted((r.track_id, r.n, r.idx) for r in got) == sorted((t, i + 1, i) for t, i, _, _ in rows)


def test_gate_under_a_control_stream(spark, tmp_path):
    rng = random.Random(3)
    media = [(t, i, 10 * MS * i, 10 * MS * i + 1) for i in range(120) for t in (1, 2)]
    control = [(t, 1000 + k, rng.choice(["start", "stop", "start", "stop", "abort"]), 10 * MS * at) for t in (1, 2) for k, at in enumerate(sorted(rng.sample(range(120), 14)))]
    expected = []
    for t in (1, 2):
        on = False
        for us, rank, idx, what in sorted([(u, 1, i, None) for tt, i, _, u in media if tt == t] + [(u, 0, i, a) for tt, i, a, u in control if tt == t]):
            if what is None:
                expected += [(t, "media", idx)] * on
            elif what == "start":
                expected.append((t, "already_recording" if on else "started", idx))
                on = True
            else:
                expected += [(t, "stopped" if on else "not_recording", idx)] * (on or what == "stop")
                on = False
    end = 10**8
    feed(spark, tmp_path / "media", [*shuffled(media, 60, 4, 10), [(9, 0, end, end)]], PACKETS)
    feed(spark, tmp_path / "control", [*shuffled(sorted(control, key=lambda r: r[3]), 7, 5, 3), [(9, 0, "abort", end)]], "track_id long, idx long, action string, us long")
    stream = live.control_gate(source(spark, tmp_path / "media", PACKETS), source(spark, tmp_path / "control", "track_id long, idx long, action string, us long"), late="2 seconds")
    got = run(stream, tmp_path)
    assert sorted((r.track_id, r.event, r.idx) for r in got) == sorted(expected)
    assert {"already_recording", "not_recording", "started", "stopped", "media"} == {e for _, e, _ in expected}


RECORD = "session_id string, idx long, kind string, pts_us long, rate int, channels int, samples array<double>, us long"


def test_recorder_pieces(spark, tmp_path, monkeypatch):
    rows = [("s", 0, "audio", 5_000_000, 8000, 1, [float(i) for i in range(1500)], 0)]
    rows += [("s", 1, "video", 5_010_000, None, None, None, 10 * MS), ("s", 2, "audio", 5_187_500, 8000, 1, [float(i) for i in range(1500, 2100)], 20 * MS)]
    rows += [("s", 3, "audio", 5_300_000, 44100, 1, [1.0], 30 * MS), ("s", 4, "audio", 5_300_000, 8000, 2, [1.0, 2.0], 31 * MS), ("s", 5, "video", 4_000_000, None, None, None, 40 * MS), ("s", 6, "video", 5_050_000, None, None, None, 50 * MS)]
    feed(spark, tmp_path / "in", [rows[1:2], rows[:1], rows[2:5], rows[5:], [("z", 0, "video", 0, None, None, None, 10**8)]], RECORD)
    got = run(live.recorded(source(spark, tmp_path / "in", RECORD), 8000, fps=1, late="1 second"), tmp_path)
    assert [(r.kind, r.idx, r.pts_us, r.is_key) for r in sorted(got, key=lambda r: (r.idx, r.pts_us))] == [
        ("audio", 0, 0, True), ("video", 1, 10_000, True), ("audio", 2, 187_500, True), ("dropped", 3, 300_000, None), ("dropped", 4, 300_000, None), ("video", 5, 0, False), ("video", 6, 50_000, True)]
    assert [x for r in sorted(got, key=lambda r: r.idx) if r.kind == "audio" for x in r.samples] == [float(i) for i in range(2048)]


def test_batches_are_written_once(spark, tmp_path):
    write = live.by_batch(str(tmp_path / "out"))
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    for batch in (0, 1, 1):
        write(rows, batch)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_clock_meets_packets(spark, tmp_path):
    rng = random.Random(6)
    ticks = [(t, 100 * MS * i) for t in (1, 2) for i in range(60)]
    packets = [(t, us) for t in (1, 2) for us in sorted(rng.sample(range(0, 6_000 * MS, 7 * MS), 50)) if not 2_000 * MS < us < 3_300 * MS]
    schema = "track_id long, us long"
    table = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros(F.col("us") + DAY))
    expected = set()
    for t, c in ticks:
        own = [us for tt, us in packets if tt == t and abs(us - c) <= 400 * MS]
        past = [us for us in own if us <= c]
        found = max(past) if past else min(own) if own else None
        expected.add((t, c + DAY, None if found is None else found + DAY))
    lookahead = "400 milliseconds"
    assert {(r.track_id, r.clock_us, r.pts_us) for r in live.presentable(table(ticks), table(packets), lookahead).collect()} == expected
    end = [(9, 10**8)]
    feed(spark, tmp_path / "ticks", [*shuffled(sorted(ticks, key=lambda r: r[1]), 25, 7, 8), end, [(9, 10**8 + 1)]], schema)
    feed(spark, tmp_path / "packets", [*shuffled(sorted(packets, key=lambda r: r[1]), 15, 8, 8), end, [(9, 10**8 + 1)]], schema)
    got = run(live.presentable(source(spark, tmp_path / "ticks", schema), source(spark, tmp_path / "packets", schema), lookahead, "2 seconds"), tmp_path)
    assert {(r.track_id, r.clock_us, r.pts_us) for r in got if r.track_id != 9} == expected and None in {x[2] for x in expected}


def test_counters_are_metrics(spark, tmp_path):
    counters = live.listen(spark)
    try:
        feed(spark, tmp_path / "in", [[(1, i, i, i * MS) for i in range(k, k + 10)] for k in (0, 10, 20)], PACKETS)
        rows = run(live.counted(source(spark, tmp_path / "in", PACKETS), "packets", even=F.col("idx") % 2 == 0), tmp_path)
        for _ in range(50):
            if counters.totals.get("packets", {}).get("rows") == 30:
                break
            time.sleep(0.2)
        assert len(rows) == 30 and counters.totals["packets"] == {"rows": 30, "even": 15}
    finally:
        spark.streams.removeListener(counters)


@pytest.fixture(autouse=True)
def provider(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
