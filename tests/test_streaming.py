"""Streams fed in several files give what the batch queries give."""

import pytest
from pyspark.sql import functions as F

from tracklake.streaming import rings as R

ROWS = [(1, i, 1000 * i, i % 4 == 0, i % 4 == 2) for i in range(12)] + [(2, 100 + i, 500 * i, i == 1, False) for i in range(5)]
SCHEMA = "track_id long, idx long, pts_us long, is_key boolean, is_target boolean"


def run(spark, tmp_path, build, name):
    for part in range(3):
        spark.createDataFrame(ROWS[part::3], SCHEMA).sort("idx").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_packet_ring_releases_what_is_due(spark, tmp_path):
    rows = run(spark, tmp_path, lambda s: R.packet_ring(s, capacity=100), "ring")
    assert sorted(r.idx for r in rows) == sorted(r[1] for r in ROWS)
    assert all(r.pts_us <= r.clock_us and r.overruns == 0 for r in rows)


def test_packet_ring_overruns(spark, tmp_path):
    rows = run(spark, tmp_path, lambda s: R.packet_ring(s, capacity=2, delay_us=4000), "small")
    assert max(r.overruns for r in rows) > 0 if rows else True


def test_record_gate_in_one_batch(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = R.record_gate(stream, "is_key", "is_target").writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.idx for r in spark.sql("SELECT * FROM gate").collect()) == [0, 1, 4, 5, 8, 9, 101, 102, 103, 104]


def test_ticks_and_latest(spark, tmp_path):
    timed = lambda s: s.withColumn("ts", F.timestamp_micros(F.col("pts_us") + 86_400_000_000))
    rows = run(spark, tmp_path, lambda s: R.latest_frames(timed(s), "1 hour"), "latest")
    assert len(rows) == len(ROWS)
    ticks = R.clock_ticks(timed(spark.createDataFrame(ROWS, SCHEMA)), "4 milliseconds", "1 second").collect()
    assert sorted((r.track_id, r.n) for r in ticks) == [(1, 4), (1, 4), (1, 4), (2, 5)]


@pytest.mark.parametrize(
    ("arguments", "expected"),
    [((40_000, 1.0), (40_000, 0)), ((20_000, 2.0), (40_000, 0)), ((10_000, 1.0, 30), (0, 10_000)), ((25_000, 1.0, 30, 10_000), (33_333, 1667)), ((100_000, 1.0, 30), (99_999, 1))],
)
def test_clock(arguments, expected):
    assert R.advance(*arguments) == expected


def test_push_policies():
    rows = [(i, i) for i in range(3)]
    assert R.push([], rows, 2, "drop_oldest") == ([(1, 1), (2, 2)], 1)
    assert R.push([], rows, 2, "drop_newest") == ([(0, 0), (1, 1)], 1)
    assert R.decoded_window(2, 30) == 60 and R.decoded_window(0, None) == 4
