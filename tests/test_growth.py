"""What grows with the input stays divided: small files share batches, tables of few bytes are dealt over tasks."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklake import catalog, catalog_containers, tables
from tracklake.functions import bits, bitstream, writers
from tracklake.functions.bytesql import AAC_RATES
from tracklake.operators import buckets
from tracklake.sources import audio, flv, walk

from .test_sources import tag

SCRIPT = b"\2\0\x0aonMetaData\x08\0\0\0\2" + b"\0\x0faudiosamplerate\0\x40\xe5\x88\x80\0\0\0\0" + b"\0\x06stereo\1\1" + b"\0\0\x09"


def flv_file(i):
    return b"FLV\1\5\0\0\0\x09" + bytes(4) + tag(18, 0, SCRIPT) + b"".join(tag(8, 20 * n, b"\xaf\1abc") for n in range(i % 3))


def test_small_files_share_batches():
    files = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(100)]), pa.array([flv_file(i) if i != 50 else b"\1\2" for i in range(100)], pa.binary())], names=["source_id", "data"])
    one = pa.Table.from_batches(walk._run(iter([files]), ("flv",), True))
    assert len(list(walk._run(iter([files]), ("flv",), True))) == 1
    alone = [pa.Table.from_batches(walk._run(iter([files.slice(i, 1)]), ("flv",), True)) for i in range(100) if i != 50]
    assert one.combine_chunks().equals(pa.concat_tables(alone).combine_chunks())


def test_sound_of_flv_walks_once(spark):
    sources = spark.createDataFrame([(str(i), bytearray(flv_file(i))) for i in range(6)], "source_id string, data binary")
    rows = flv.audio_streams(sources)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.source_id, r.sound_format, r.codec, r.rate, r.channels) for r in rows.collect()) == [(str(i), 10, "aac", 44100, 2) for i in (1, 2, 4, 5)]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("parts")
    spark.range(0, 60, 1, 1).selectExpr("id AS p_partkey", "'a name' AS p_name", "cast(id % 50 + 1 AS int) AS p_size").write.parquet(f"{d}/part.parquet")
    return str(d)


def tasks_of(df):
    return df.rdd.getNumPartitions()


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(tables.spread, "__defaults__", (20,))


def test_files_made_of_parts_are_dealt_out(spark, parts, few_rows):
    assert tasks_of(catalog_containers.scripted(spark, parts)) == 3
    assert catalog.QUERIES["q_script_values"](spark, parts).count() == 240


def test_ranges_are_more_than_tasks(spark):
    rows = spark.range(3000).selectExpr("0L AS g", "id div 3 AS k", "id AS v")
    cut = buckets.bucketed(rows, ["g"], ["k"], 10)
    each = cut.groupBy("_bucket").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n")).orderBy("_bucket").collect()
    assert len(cut.inputFiles()) == 1 and len(each) >= 250 and max(r.n for r in each) <= 13
    assert all(a.high < b.low for a, b in zip(each, each[1:]))  # equal rows stay together


def test_slices_are_read_column_wise(monkeypatch):
    """Conditions, units that end early, and units with what repeats, which alone are read one by one."""
    rng = random.Random(3)
    sps = {"pic_order_cnt_type": 0, "log2_max_frame_num_minus4": 4, "log2_max_pic_order_cnt_lsb_minus4": 2, "frame_mbs_only_flag": 0}
    pps = {"entropy_coding_mode_flag": 1, "deblocking_filter_control_present_flag": 1, "bottom_field_pic_order_in_frame_present_flag": 1}
    units = [bytes([rng.choice([0x21, 0x41, 0x65])]) + rng.randbytes(rng.randrange(12)) for _ in range(3000)] + [None, b""]
    for steps in (bits.slice_steps(sps, pps), bits.slice_steps({}, {}), bits.hevc_slice_steps({"num_short_term_ref_pic_sets": 1}, {"cabac_init_present_flag": 1}), bits.SPS):
        want = [bits.parse(u, steps) for u in units]
        got = bits.read_columns(pa.array(units, pa.binary()), steps)
        assert [list(x) for x in got.to_pylist()] == [list(x.items()) for x in want]
    alone = []
    monkeypatch.setattr(bits, "parse", lambda u, s, real=bits.parse: alone.append(u) or real(u, s))
    simple = [b"\x21\xb0" + rng.randbytes(2) + b"\x40" for _ in range(500)]  # I slices without marking
    bits.read_columns(pa.array(simple), bits.slice_steps(sps | {"frame_mbs_only_flag": 1}, {}))
    assert len(alone) < 300


def test_units_are_made_in_pieces(monkeypatch):
    packets, made = pa.array([b"\0\0\0\1a" * 10, b"", None, b"\0\0\0\1b\0"] * 20, pa.binary()), []
    monkeypatch.setattr(bitstream, "UNITS_AT_ONCE", 100)
    monkeypatch.setattr(bitstream.pa, "array", lambda x, *a, real=pa.array: made.append(len(x)) or real(x, *a))
    out = bitstream._in_pieces(packets, lambda data: bitstream._length_units(data, 4, True))
    assert out.to_pylist() == [[b"a"] * 10, None, None, None] * 20 and max(made) <= 12


def test_sorts_are_divided_by_rows(spark, tmp_path, monkeypatch):
    """A session with few shuffle partitions does not make tasks that grow with the table."""
    monkeypatch.setitem(tables.dealt.__kwdefaults__, "per", 20)
    spark.range(0, 200, 1, 1).selectExpr("id AS l_orderkey", *[f"cast(id AS long) AS {c}" for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")], "current_date() AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(0, 100, 1, 1).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    plan = catalog.QUERIES["q_validation_union"](spark, str(tmp_path))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(track_id#" in text and ", 10), REPARTITION_BY_NUM" in text and plan.count() == 41


@pytest.mark.parametrize("name", ["q_adts_config", "q_hevc_sps_size", "q_sps_size", "q_asc_parse"])
def test_long_work_on_parts_is_dealt_out(spark, parts, few_rows, name):
    assert tasks_of(catalog.QUERIES[name](spark, parts)) == 3




def test_script_values_leave_python_once_and_alone(spark):
    """Only values of scripts are handed on by the walk, and they are read in its pass."""
    sources = spark.createDataFrame([(str(i), bytearray(flv_file(i))) for i in range(6)], "source_id string, data binary")
    found = flv.script_values(sources)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, flv.values_of(walk.files(sources)).collect())) and found.count() == 12
    few = walk.files(sources, ("flv",), columns=("source_id", "kind", "number"), kinds=("audio",))
    assert few.columns == ["source_id", "number", "kind"] and {(r.source_id, r.kind) for r in few.collect()} == {(i, "audio") for i in "1245"}


def test_numbers_of_all_sizes_are_written(spark):
    numbers = [0.0, 1.5, -0.1, 2.0**-1022, 5e-324, -2.2e-310, 1.7976931348623157e308]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", writers.double_be(F.col("x")).alias("data")).collect()
    assert [bytes(r.data) for r in rows] == [struct.pack(">d", r.x) for r in rows]


def plain_adts(data):
    for at in range(min(len(data), 256) - 6):
        index, channels = data[at + 2] >> 2 & 15, (data[at + 2] & 1) << 2 | data[at + 3] >> 6
        if data[at] == 255 and data[at + 1] & 0xF6 == 0xF0 and index < 13 and channels:
            return (data[at + 2] >> 6) + 1, index, AAC_RATES[index], channels
    return None


def test_adts_headers_are_searched_once(spark, parts):
    plan = catalog.QUERIES["q_adts_config"](spark, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and "sequence(" not in plan
    rng = random.Random(7)
    data = [b"\xff\xf1" * rng.randrange(3) + bytes(rng.choices([255, 0xF0, 0xF1, 0xF8, 0xF9, 0xF3, 0, 10, 13, 0x50, 0x34, 64], k=rng.choice([0, 6, 7, 9, 30]))) for _ in range(400)]
    data += [bytes([1, 255, 0xF9, x, y, 0, 10, 13]) for x in range(256) for y in (0, 63, 64, 255)] + [bytes(n) + b"\xff\xf1\x50\x80\1\2\3" for n in (248, 249, 250, 256)]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)] + [(-1, None)], "id long, data binary").select("id", audio.adts_header(F.col("data")).alias("h"), audio.asc_of_adts(F.col("data")).alias("asc"))
    for r in rows.collect():
        want = plain_adts(data[r.id]) if r.id >= 0 else None
        assert (r.h and tuple(r.h)) == want and (r.asc and bytes(r.asc)) == (want and (want[0] << 11 | want[1] << 7 | want[3] << 3).to_bytes(2, "big"))


def test_parameter_sets_are_read_column_wise(spark, parts, monkeypatch):
    """Whole units of a query are read without one of them alone; cut and changed ones as they are read one by one, all fields or some."""
    made, rng, real = [], random.Random(9), bits.parse
    monkeypatch.setattr(bits, "header", lambda unit, *a, real=bits.header: made.append(unit) or real(unit, *a))
    for name in ("q_hevc_sps_size", "q_sps_size"):
        catalog.QUERIES[name](spark, parts)
    for unit, steps in zip(made, (bits.HEVC_SPS, bits.SPS), strict=True):
        units = [bytes(r[0]) for r in spark.read.parquet(f"{parts}/part.parquet").select(unit).collect()]
        alone = []
        monkeypatch.setattr(bits, "parse", lambda u, s, alone=alone: alone.append(u) or real(u, s))
        assert bits.read_columns(pa.array(units), steps).to_pylist() == [list(real(u, steps).items()) for u in units] and not alone
        spoiled = [u[: rng.randrange(len(u) + 1)] for u in units] + [bytes(b ^ (rng.random() < 0.05) << rng.randrange(8) for b in u) for u in units * 5] + [None, b""]
        for only in (None, frozenset(["width", "time_scale", "short_term_ref_pic_set[0].num_negative_pics"])):
            want = [[x for x in real(u, steps).items() if only is None or x[0] in only] for u in spoiled]
            assert bits.read_columns(pa.array(spoiled, pa.binary()), steps, only).to_pylist() == want
