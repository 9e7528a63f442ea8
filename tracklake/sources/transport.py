"""Program tables of transport streams, and packets of program streams.

A transport stream's packets name their elementary stream by a number (PID); the association table names programs, and each program's map its streams
and their kinds. Both are read natively from the packets that carry them and joined to the streams' packets: the tables have a few rows for each file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import bytesql as B
from tracklake.functions.names import STREAM_TYPES, named

from .media import _walk, stamp

VIDEO, AUDIO = (0x1B, 0x24), (0x0F, 0x11, 0x1C)


def _section(payload: Column) -> Column:
    """The table that starts in a packet, after the pointer."""
    return F.substring(payload, B.uint_be(payload, 0, 1).cast("int") + 2, F.length(payload))


def _content(section: Column, head: Column | int) -> Column:
    """What stands between a table's head and its checksum, as far as the packet goes."""
    end = 3 + B.uint_be(section, 1, 2).bitwiseAND(0xFFF) - 4
    head = F.lit(head) if isinstance(head, int) else head
    size = F.least(end, F.length(section).cast("long")) - head
    return F.substring(section, (head + 1).cast("int"), F.greatest(F.lit(0), size).cast("int"))


def programs(packets: DataFrame) -> DataFrame:
    """(source_id, program, pmt_pid) of the association tables of a stream; network entries (program 0) are left out."""
    section = _section(F.col("payload"))
    rows = packets.where("pid = 0 and start").select("source_id", section.alias("s")).where(B.is_bytes(F.col("s"), 0, b"\x00"))
    rows = rows.select("source_id", _content(F.col("s"), 8).alias("body")).where("length(body) >= 4")
    rows = rows.select("source_id", "body", F.explode(F.expr("sequence(0, length(body) div 4 - 1)")).alias("i"))
    number, pid = B.uint_be(F.col("body"), F.col("i") * 4, 2), B.uint_be(F.col("body"), F.col("i") * 4 + 2, 2).bitwiseAND(0x1FFF)
    return rows.select("source_id", number.alias("program"), pid.alias("pmt_pid")).where("program != 0").distinct()


def _entries(bodies: pa.Array) -> pa.Array:
    """Entries (type, pid, descriptors) of program maps; each says how long it is."""
    out = []
    for body in bodies:
        data, at, found = body.as_py() or b"", 0, []
        while at + 5 <= len(data):
            size = int.from_bytes(data[at + 3 : at + 5], "big") & 0xFFF
            if at + 5 + size > len(data):
                break
            found.append({"stream_type": data[at], "pid": int.from_bytes(data[at + 1 : at + 3], "big") & 0x1FFF, "descriptors": data[at + 5 : at + 5 + size]})
            at += 5 + size
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("stream_type", pa.int64()), ("pid", pa.int64()), ("descriptors", pa.binary())])))


def streams(packets: DataFrame) -> DataFrame:
    """(source_id, program, pid, stream_type, stream_name, kind, codec, descriptors): by the first map of each program.

    The first packet with a map on a program's PID counts; streams that are neither pictures nor sound have a null kind.
    """
    section = _section(F.col("payload"))
    maps = packets.where("start").join(programs(packets).withColumnRenamed("pmt_pid", "pid"), ["source_id", "pid"]).select("source_id", "program", "index", section.alias("s"))
    maps = maps.where(B.is_bytes(F.col("s"), 0, b"\x02"))
    first = maps.groupBy("source_id", "program").agg(F.min_by("s", "index").alias("s"))
    head = 12 + B.uint_be(F.col("s"), 10, 2).bitwiseAND(0xFFF)
    read = F.arrow_udf(_entries, "array<struct<stream_type:bigint,pid:bigint,descriptors:binary>>", F.ArrowUDFType.SCALAR)
    rows = first.select("source_id", "program", F.explode(read(_content(F.col("s"), head))).alias("e")).select("source_id", "program", "e.*")
    kind = F.when(F.col("stream_type").isin(*VIDEO), "video").when(F.col("stream_type").isin(*AUDIO), "audio")
    codec = F.when(F.col("stream_type") == 0x1B, "h264").when(F.col("stream_type") == 0x24, "h265").when(F.col("stream_type").isin(*AUDIO), "aac")
    rows = rows.withColumns({"stream_name": named(F.col("stream_type"), STREAM_TYPES), "kind": kind, "codec": codec})
    return rows.dropDuplicates(["source_id", "pid"])


def track_spans(pes: DataFrame) -> DataFrame:
    """(source_id, pid, n, duration_us): packets of each stream and the time from the first to the last, null for fewer than two times."""
    span = F.max("pts_us") - F.min("pts_us")
    return pes.groupBy("source_id", "pid").agg(F.count("*").alias("n"), F.when(F.count("pts_us") >= 2, span).alias("duration_us"))


def first_configs(units: DataFrame) -> DataFrame:
    """(source_id, pid, sps, pps): the first parameter sets of each H.264 stream of rows (source_id, pid, index, n, unit)."""
    kind = B.uint_be(F.col("unit"), 0, 1).bitwiseAND(31)
    at = F.struct("index", "n")
    pick = lambda k: F.min_by(F.when(kind == k, F.col("unit")), F.when(kind == k, at))
    return units.where(kind.isin(7, 8)).groupBy("source_id", "pid").agg(pick(7).alias("sps"), pick(8).alias("pps"))


def packet_walk(data: bytes) -> Iterator[tuple]:
    """Index, stream id, head, offset and size of the elementary packets of a program stream."""
    at, found = data.find(b"\0\0\1"), 0
    while 0 <= at and at + 6 <= len(data):
        kind = data[at + 3]
        if kind < 0xBC:  # a pack header (BA), the system's end (B9) or a start code inside a stream
            at = data.find(b"\0\0\1", at + 4)
            continue
        stated = int.from_bytes(data[at + 4 : at + 6], "big")
        following = data.find(b"\0\0\1", at + 6)
        end = at + 6 + stated if stated else following if following >= 0 else len(data)
        if 0xC0 <= kind <= 0xEF and at + 9 <= len(data):
            start = min(at + 9 + data[at + 8], end)
            yield found, kind, data[at : at + 19], start, max(0, min(end, len(data)) - start)
            found += 1
        at = data.find(b"\0\0\1", end)


def ps_packets(sources: DataFrame) -> DataFrame:
    """(source_id, index, stream_id, kind, pts_us, dts_us, offset, size) of the elementary packets of program streams.

    Pack and system headers are stepped over by their start codes; a packet of stated length ends there, one without at the next start code. ``offset`` and
    ``size`` are those of the payload.
    """
    return timed_packets(_walk(sources.where(B.is_mpegps(F.col("data"))), packet_walk, "index long, stream_id long, head binary, offset long, size long"))


def timed_packets(rows: DataFrame, *more: str) -> DataFrame:
    """Kinds and times of rows (source_id, index, stream_id, head, offset, size), with ``more`` of their columns."""
    head, flags = F.col("head"), F.shiftright(B.uint_be(F.col("head"), 7, 1), 6)
    kind = F.when(F.col("stream_id") < 0xE0, "audio").otherwise("video")
    pts = F.when((flags >= 2) & (F.length(head) >= 14), stamp(head, 9))
    dts = F.when((flags == 3) & (F.length(head) >= 19), stamp(head, 14)).otherwise(pts)
    return rows.select("source_id", "index", "stream_id", kind.alias("kind"), pts.alias("pts_us"), dts.alias("dts_us"), "offset", "size", *more)


def numbered_units(pes: DataFrame, split) -> DataFrame:
    """Rows (source_id, pid, index, n, unit) of the units that ``split`` makes of the column ``data`` of packets."""
    return pes.select("source_id", "pid", "index", F.posexplode(split(F.col("data"))).alias("n", "unit"))


def access_units(units: DataFrame, codec: str) -> DataFrame:
    """(source_id, pid, index, picture_type, is_idr): by the first slice of each packet's units."""
    number = B.uint_be(F.col("unit"), 0, 1)
    kind = number.bitwiseAND(31) if codec == "h264" else F.shiftright(number, 1).bitwiseAND(63)
    idr = kind == 5 if codec == "h264" else kind.between(16, 21)
    slices = F.when(kind == 5, "I").when(kind == 1, "P") if codec == "h264" else F.when(kind.between(16, 21), "I").when(kind.between(0, 9), "P")
    rows = units.select("source_id", "pid", "index", "n", slices.alias("picture_type"), idr.alias("is_idr")).where("picture_type is not null")
    first = F.row_number().over(Window.partitionBy("source_id", "pid", "index").orderBy("n"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k", "n")
