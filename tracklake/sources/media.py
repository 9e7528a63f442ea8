"""Media files as tables: sources with their format, and packets, tags, boxes and samples of containers.

Files are read by Spark's binary-file source, so any store that Spark reaches will do; parallelism is per file, and each table keeps ``source_id``.
Formats of fixed packets (transport streams, PCM) are cut natively. Where a record's place follows from the length of the one before, a short
generator walks the lengths and yields rows; all that can be computed from rows is native again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.functions import bytesql as B
from tracklake.functions import pcm
from tracklake.functions import writers as W


#: Rows that a walk over a file hands on at once.
ROWS_AT_ONCE = 1 << 14


def load_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source_id, version, name, size, format, confidence, data) of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.concat_ws(":", F.lit("file"), name, F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string")).alias("version"), name.alias("name"), F.col("length").alias("size"), F.sha2("path", 256).alias("source_id"), F.col("content").alias("data"))
    return probe(rows)


def probe(sources: DataFrame) -> DataFrame:
    """Adds format and confidence by the first bytes."""
    return sources.withColumn("format", B.container_format(F.col("data"))).withColumn("confidence", B.probe_confidence(F.col("format")))


def _walk(sources: DataFrame, walk: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that a generator yields for the bytes of each source, after its id."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = walk(data.as_py() or b"")
                while rows := list(islice(found, ROWS_AT_ONCE)):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *columns], names=["source_id", *names])

    return sources.select(F.col("source_id").cast("string").alias("source_id"), "data").mapInArrow(run, f"source_id string, {schema}")


# --- RIFF/WAVE

def chunk_walk(data: bytes) -> Iterator[tuple]:
    """(name, offset, size) of the chunks of a WAVE file."""
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4].decode("latin-1"), at + 8, min(size, len(data) - at - 8)
        at += 8 + size + size % 2


def wav_chunks(sources: DataFrame) -> DataFrame:
    """(source_id, name, offset, size) of the chunks of WAVE files, wherever ``data`` lies."""
    return _walk(sources.where(B.is_wav(F.col("data"))), chunk_walk, "name string, offset long, size long")


def wav_tracks(sources: DataFrame) -> DataFrame:
    """(source_id, rate, channels, bits, data_offset, frames, duration_us) of PCM files."""
    chunks = wav_chunks(sources).groupBy("source_id").agg(*[F.min(F.when(F.col("name") == n, F.struct("offset", "size"))).alias(k) for n, k in (("fmt ", "fmt"), ("data", "body"))])
    rows = sources.join(chunks.where("fmt is not null and body is not null"), "source_id")
    data, at = F.col("data"), F.col("fmt.offset")
    rows = rows.select("source_id", B.uint_le(data, at + 4, 4).alias("rate"), B.uint_le(data, at + 2, 2).alias("channels"), B.uint_le(data, at + 14, 2).alias("bits"), F.col("body.offset").alias("data_offset"), F.col("body.size").alias("bytes"))
    return pcm_length(rows)


def pcm_length(rows: DataFrame) -> DataFrame:
    """Frames and duration of rows with ``bytes`` of PCM sound."""
    rows = rows.withColumn("frames", F.expr("bytes div greatest(1, channels * bits div 8)")).drop("bytes")
    return rows.withColumn("duration_us", F.floor(F.col("frames") * 1_000_000 / F.col("rate") + 0.5))


def wav_packets(tracks: DataFrame, size: int = 4096) -> DataFrame:
    """Packets of ``size`` frames, all key: (source_id, index, pts_us, duration_us, offset, size, is_key)."""
    each = tracks.where("frames > 0").withColumn("index", F.explode(F.expr(f"sequence(0L, (frames - 1) div {size})")))
    first, frames = F.col("index") * size, F.least(F.lit(size), F.col("frames") - F.col("index") * size)
    width = F.expr("channels * bits div 8")
    return each.select("source_id", "index", F.floor(first * 1_000_000 / F.col("rate") + 0.5).alias("pts_us"), F.floor(frames * 1_000_000 / F.col("rate") + 0.5).alias("duration_us"), (F.col("data_offset") + first * width).alias("offset"), (frames * width).alias("size"), F.lit(True).alias("is_key"))


# --- FLV

def tag_walk(data: bytes) -> Iterator[tuple]:
    """Kind, times, key flag, codec, configuration flag, offset and size of the tags of an FLV file."""
    at = 13
    while at + 11 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind not in (8, 9, 18) or not size or at + 11 + size > len(data):
            return
        time = int.from_bytes(bytes([data[at + 7]]) + data[at + 4 : at + 7], "big", signed=True)
        head, skip, shift, config = data[at + 11], 1, 0, False
        if kind == 9 and head & 15 in (7, 12) and size >= 5:
            config, skip = data[at + 12] == 0, 5
            shift = int.from_bytes(data[at + 13 : at + 16], "big", signed=True)
        elif kind == 8 and head >> 4 == 10 and size >= 2:
            config, skip = data[at + 12] == 0, 2
        codec = str(head & 15 if kind == 9 else head >> 4)
        yield {8: "audio", 9: "video", 18: "script"}[kind], (time + shift) * 1000, time * 1000, kind == 8 or head >> 4 == 1, codec, config, at + 11 + skip, size - skip
        at += 15 + size


def flv_tags(sources: DataFrame) -> DataFrame:
    """(source_id, kind, pts_us, dts_us, is_key, codec, config, offset, size) of the tags of FLV files.

    Configuration packets have ``config``; audio is always key. Times are those of the format, in milliseconds there.
    """
    return _walk(sources.where(B.is_flv(F.col("data"))), tag_walk, "kind string, pts_us long, dts_us long, is_key boolean, codec string, config boolean, offset long, size long")


# --- MPEG transport streams

def packet_offsets(data: np.ndarray) -> np.ndarray:
    """Where packets start: 188 bytes after the last one while a sync byte stands there, else at the next sync byte."""
    sync, out, at = np.flatnonzero(data == 0x47), [np.zeros(0, np.int64)], 0
    while True:
        k = np.searchsorted(sync, at)
        if k == len(sync):
            break
        places = np.arange(sync[k], len(data) - 187, 188)
        lost = np.flatnonzero(data[places] != 0x47)
        end = int(lost[0]) if len(lost) else len(places)
        out.append(places[:end])
        if end == len(places):
            break
        at = places[end]
    return np.concatenate(out)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)
            places = packet_offsets(data)
            for first in range(0, len(places), 4096):
                some = places[first : first + 4096]
                packets = pa.FixedSizeBinaryArray.from_buffers(pa.binary(188), len(some), [None, pa.py_buffer(data[some[:, None] + np.arange(188)].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(np.arange(first, first + len(some))), packets.cast(pa.binary())], names=["source_id", "index", "p"])


def ts_packets(sources: DataFrame) -> DataFrame:
    """(source_id, index, pid, start, payload) of the packets with payload, adaptation fields skipped; a lost or extra byte costs one packet."""
    rows = sources.where(B.is_mpegts(F.col("data"))).select(F.col("source_id").cast("string").alias("source_id"), "data")
    rows = rows.mapInArrow(_packets, "source_id string, index long, p binary")
    head = B.uint_be(F.col("p"), 1, 2)
    control = F.shiftright(B.uint_be(F.col("p"), 3, 1), 4).bitwiseAND(3)
    skip = F.when(control >= 2, 5 + B.uint_be(F.col("p"), 4, 1)).otherwise(4)
    payload = F.expr("substring(p, skip + 1, greatest(0, 188 - skip))")
    rows = rows.select("source_id", "index", head.bitwiseAND(0x1FFF).alias("pid"), (head.bitwiseAND(0x4000) != 0).alias("start"), control.alias("control"), skip.cast("int").alias("skip"), "p")
    return rows.where("control in (1, 3)").select("source_id", "index", "pid", "start", payload.alias("payload"))


def stamp(data, at):
    """A 33-bit time stamp of five bytes, as microseconds."""
    b = [B.uint_be(data, at + i, 1) for i in range(5)]
    ticks = F.shiftleft(F.shiftright(b[0], 1).bitwiseAND(7), 30) + F.shiftleft(b[1], 22) + F.shiftleft(F.shiftright(b[2], 1), 15) + F.shiftleft(b[3], 7) + F.shiftright(b[4], 1)
    return F.floor(ticks * 100 / 9 + 0.5)


def ts_pes(packets: DataFrame, with_data: bool = False) -> DataFrame:
    """(source_id, pid, index, kind, pts_us, dts_us, size) of PES packets: a running count of starts per PID numbers them, and an aggregate joins their packets.

    A packet that states its length ends there. ``with_data`` adds the payload; a packet is one access unit, so its bytes are bounded.
    """
    w = Window.partitionBy("source_id", "pid").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    rows = packets.where(F.col("pid") > 31).withColumn("pes", F.sum(F.col("start").cast("int")).over(w)).where("pes > 0")
    parts = [F.min("index").alias("index"), F.min_by("payload", "index").alias("head"), F.sum(F.length("payload")).alias("bytes")]
    out = rows.groupBy("source_id", "pid", "pes").agg(*parts, *[W.joined_in_order("payload", "index").alias("all")] * with_data)
    return pes_of(out, ["source_id", "pid", "index"], "all" if with_data else None)


def pes_of(rows: DataFrame, keys: list[str], data: str | None = None) -> DataFrame:
    """Kind, times, size and (from the column ``data``) payload of rows (keys, head, bytes) of what may be elementary packets of sound or pictures; others are left out."""
    head = F.col("head")
    out = pes_times(rows.where(B.is_bytes(head, 0, b"\x00\x00\x01")), "head")
    stream = B.uint_be(head, 3, 1)
    kind = F.when(stream.between(0xC0, 0xDF), "audio").when(stream.between(0xE0, 0xEF), "video")
    stated, skip = B.uint_be(head, 4, 2), B.uint_be(head, 8, 1)
    size = F.col("bytes") - 9 - skip
    size = F.when(stated > 0, F.least(size, F.greatest(F.lit(0), stated - 3 - skip))).otherwise(size)
    payload = [F.substring(F.col(data), (10 + skip).cast("int"), size.cast("int")).alias("data")] if data else []
    return out.select(*keys, kind.alias("kind"), "pts_us", "dts_us", size.alias("size"), *payload).where("kind is not null")


def pes_times(rows: DataFrame, head: str = "body") -> DataFrame:
    """Adds the times that the heads of elementary packets say."""
    flags = F.shiftright(B.uint_be(F.col(head), 7, 1), 6)
    pts = F.when(flags >= 2, stamp(F.col(head), 9))
    return rows.withColumns({"pts_us": pts, "dts_us": F.when(flags == 3, stamp(F.col(head), 14)).otherwise(pts)})


# --- ISO base media (MP4)

INNER = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"mfra"}


def box_walk(data: bytes) -> Iterator[tuple]:
    """Name, track, offset, size and body of the boxes of an MP4 file; boxes of boxes and the media data have no body."""
    track, stack = 0, [(0, len(data))]
    while stack:
        at, end = stack.pop()
        if at + 8 > end:
            continue
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            continue
        stack.append((at + size, end))
        track += name == b"trak"
        if name in INNER:
            stack.append((at + head, at + size))
        yield name.decode("latin-1"), track, at, size, None if name in INNER or name == b"mdat" else data[at + head : at + size]


def mp4_boxes(sources: DataFrame) -> DataFrame:
    """(source_id, name, track, offset, size, body) of the boxes of MP4 files, in file order; ``track`` counts trak boxes from 1, and the
    media data has no body here."""
    return _walk(sources.where(B.is_mp4(F.col("data"))), box_walk, "name string, track long, offset long, size long, body binary")


#: The tables of a track from which its samples follow.
TABLES = ["stsz", "stts", "ctts", "stss", "stsc", "stco", "co64"]


def sample_table(tables: dict[str, bytes | None]) -> dict[str, np.ndarray]:
    """Offset, size, decode and presentation time and key flag of the samples of a track, in its own scale, by its tables.

    Runs of sizes, times and shifts are repeated; a sample lies after those before it in its chunk. Samples without a chunk have no row; past the last
    run of times its delta goes on.
    """
    numbers = lambda name, skip, width, kind=">u4": np.frombuffer((t := tables.get(name) or b"")[skip : skip + (len(t) - skip) // width * width if len(t) > skip else skip], kind).astype(np.int64)
    head = lambda name, at: int.from_bytes((tables.get(name) or b"")[at : at + 4], "big")
    runs = lambda name, width, kind=">u4": numbers(name, 8, 4 * width, kind)[: head(name, 4) * width].reshape(-1, width)
    count = head("stsz", 8)
    sizes = np.full(count, head("stsz", 4)) if head("stsz", 4) else numbers("stsz", 12, 4)[:count]
    at = np.concatenate([runs("stco", 1)[:, 0], numbers("co64", 8, 8, ">u8")[: head("co64", 4)]])
    per, each = runs("stsc", 3), np.zeros(len(at), np.int64)
    for first, n, _ in per:  # one entry for each change
        each[max(0, first - 1) :] = min(n, count)
    chunk = np.repeat(np.arange(len(at)), each)[: len(sizes)]
    sizes = sizes[: len(chunk)]
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], ends])[np.searchsorted(chunk, np.arange(len(at)))] if len(at) else ends
    repeated = lambda r: np.repeat(r[:, 1], np.minimum(r[:, 0], len(sizes)))[: len(sizes)]
    deltas = repeated(runs("stts", 2))
    deltas = np.concatenate([deltas, np.full(len(sizes) - len(deltas), deltas[-1] if len(deltas) else 0)])
    shifts = repeated(runs("ctts", 2, ">i4"))
    dts = np.cumsum(deltas) - deltas
    keys = np.ones(len(sizes), bool)
    if head("stss", 4):
        keys[:] = False
        listed = runs("stss", 1)[:, 0] - 1
        keys[listed[(listed >= 0) & (listed < len(keys))]] = True
    pts = dts + np.concatenate([shifts, np.zeros(len(sizes) - len(shifts), np.int64)])
    return {"offset": at[chunk] + ends - sizes - before[chunk], "size": sizes, "dts": dts, "pts": pts, "is_key": keys}


def mp4_samples(boxes: DataFrame) -> DataFrame:
    """(source_id, track, sample, offset, size, dts, pts, is_key) from the tables of each track, times in its own scale.

    One exchange brings the tables of a track together; a track's tables are what a task holds at once.
    """
    pick = [F.min_by("body", F.when(F.col("name") == n, F.col("offset"))).alias(n) for n in TABLES]
    tables = boxes.where(F.col("name").isin(*TABLES)).groupBy("source_id", "track").agg(*pick)
    names = ["offset", "size", "dts", "pts", "is_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = sample_table(row)
                for at in range(0, len(found["size"]), ROWS_AT_ONCE):
                    some = {k: v[at : at + ROWS_AT_ONCE] for k, v in found.items()}
                    n = len(some["size"])
                    yield pa.RecordBatch.from_arrays([pa.array([row["source_id"]] * n, pa.string()), pa.array([row["track"]] * n, pa.int64()), pa.array(np.arange(at, at + n)), *[pa.array(some[k]) for k in names]], names=["source_id", "track", "sample", *names])

    return tables.mapInArrow(run, "source_id string, track long, sample long, offset long, size long, dts long, pts long, is_key boolean")


def mp4_tracks(boxes: DataFrame) -> DataFrame:
    """(source_id, track, kind, timescale, duration) of the tracks that have a handler for pictures or sound."""
    body = F.col("body")
    wide = B.uint_be(body, 0, 1) == 1
    scale = F.when(wide, B.uint_be(body, 20, 4)).otherwise(B.uint_be(body, 12, 4))
    length = F.when(wide, B.uint_be(body, 25, 7)).otherwise(B.uint_be(body, 16, 4))
    headers = boxes.where("name = 'mdhd'").select("source_id", "track", scale.alias("timescale"), length.alias("duration"))
    kind = F.when(B.is_bytes(body, 8, b"vide"), "video").when(B.is_bytes(body, 8, b"soun"), "audio")
    return boxes.where("name = 'hdlr'").select("source_id", "track", kind.alias("kind")).where("kind is not null").join(headers, ["source_id", "track"])


# --- G.711

def ulaw_table() -> np.ndarray:
    """The linear 16-bit values of the 256 mu-law bytes, by the formula of ITU G.711."""
    inverted = 255 - np.arange(256)
    size = ((inverted & 15) * 8 + 132) * (1 << (inverted >> 4 & 7)) - 132
    return np.where(inverted > 127, -size, size)


def ulaw_sums(rows: DataFrame) -> DataFrame:
    """Rows (id, total) of rows (id, data): the sum of the decoded bytes, 0 where there are none."""
    values, key = ulaw_table(), rows.schema.names[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [int(values[np.frombuffer(x.as_buffer(), np.uint8)].sum()) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], names=[key, "total"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("total", T.LongType())]))


# --- sinks

def wav_bytes(rows: DataFrame, samples: str, rate: int, channels: int = 1, form: str = "pcm16") -> DataFrame:
    """Adds ``wav``: a WAVE file of an array of floats, interleaved by channel, as ``pcm16`` or ``float32``."""
    wide = form == "float32"

    def body(values: np.ndarray) -> bytes:
        return values.astype("<f4").tobytes() if wide else np.floor(np.clip(values, -1, 1) * 32767 + 0.5).astype("<i2").tobytes()

    def run(heads: pa.Array, values: pa.Array) -> pa.Array:
        files = [h.as_py() + body(np.asarray(v.values, np.float64)) if v.is_valid else None for h, v in zip(heads, values, strict=True)]
        return pa.array(files, pa.binary())

    frames = F.floor(F.size(samples) / channels)
    make = F.arrow_udf(run, "binary", F.ArrowUDFType.SCALAR)
    return rows.withColumn("wav", make(pcm.wav_header(frames, rate, channels, 4 if wide else 2), F.col(samples).cast("array<double>")))
