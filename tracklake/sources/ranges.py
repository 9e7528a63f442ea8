"""Large files in byte ranges: every split is walked by a task of its own, and what crosses a boundary is stitched by small tables.

A record belongs to the split in which its first byte lies. Where a split's first record starts follows from the one before it; a task guesses it from what stands there (several
sync bytes, or several headers that lead to one another) and says where it started and where it ended. A *carry* table, one row for each split, compares each split's start
with the end of the last one before it that had records; splits that guessed wrong are walked again from the right place, until all agree. So rows are
those of a walk over the whole file, for every split size, and no cell holds more than a split.

The files must be reachable by path or URI from the executors (local or shared folders, and the object stores that Arrow knows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracklake.functions import bytesql as B
from tracklake.functions import writers as W
from tracklake.tables import delete, written

from . import audio, media, walk
from .sink import filesystem

#: Bytes of a split, and what a split sees of the next one: enough for a packet and for a frame's header.
SPLIT, AHEAD = 32 << 20, 188 + 64
#: Bytes of small ranges that one task reads together.
LEAST = 1 << 20
#: Packets or frames in a row that make a guess.
CHAIN = 4


class Ranges(InputPartition):
    """What one task reads: a range (path, split, start, stop, size), or several of small files."""

    def __init__(self, ranges: list[tuple]) -> None:
        super().__init__(ranges)


class RangeReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Ranges]:
        store, path = filesystem(self.path)
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out, held = [[]], 0
        for f in sorted(files, key=lambda f: f.path):
            for k, at in enumerate(range(0, f.size, self.split)):
                stop = min(at + self.split, f.size)
                if out[-1] and held + stop - at > max(self.split, LEAST):
                    out.append([])
                    held = 0
                out[-1].append((f.path, k, at, stop, f.size))
                held += stop - at
        return [Ranges(x) for x in out if x]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        for path, split, start, stop, size in partition.value:
            with store.open_input_file(path) as f:
                data = f.read_at(min(stop + AHEAD, size) - start, start)
            yield pa.RecordBatch.from_pydict({"path": [path], "split": [split], "start": [start], "stop": [stop], "size": [size], "data": [data]})


class ByteRanges(DataSource):
    """(path, split, start, stop, size, data): the ranges of the files under a path, each with some bytes of the next."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, split long, start long, stop long, size long, data binary"

    def reader(self, schema: object) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("split", SPLIT)))


def byte_ranges(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("path", path).option("split", split).load()


@dataclass
class Found:
    """What a walk over a split found: its rows, where it started, and where the next record is looked for, null where there is nothing to tell. A place whose complement
    is told (below zero) is one from which a first record is still searched for; ``first`` is where a search from the split's start would find it."""

    rows: list[dict]
    entry: int | None
    exit: int | None
    first: int | None = None


#: A walk over a split's bytes: (data, start, stop, size of the file, where to start if that is known).
Walk = Callable[[bytes, int, int, int, "int | None"], Found]


def _place(told: Column) -> Column:
    return F.when(told < 0, -told - 1).otherwise(told)


def _wrong() -> Column:
    """Whether a split did not start where the last one before it that had something to tell ends (``told``)."""
    told, entry, first = F.col("told"), F.col("entry"), F.col("first")
    # one that is reached over has no record; a search from before its start finds its first record or goes through
    return (
        F.when(_place(told) >= F.col("stop"), F.col("exit").isNotNull())
        .when((told < 0) & (_place(told) <= F.col("start")), ~entry.eqNullSafe(first) & ~entry.eqNullSafe(told))
        .otherwise(~told.eqNullSafe(entry))
    )


def _stitched(spark: SparkSession, path: str, split: int, walk_split: Walk, schema: str) -> DataFrame:
    """Rows of all splits, walked from where the splits before them end: (path, split, ``schema``).

    The first walk's rows are kept; what is repeated until all splits agree is only the walk of those that do not, and only for the carry table.
    """
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    given = ["path", "split", "start", "stop", "size"]
    whole = f"path string, split long, start long, stop long, size long, what string, entry long, exit long, first long, {schema}"
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in whole.split(", ")]

    def run(batches: Iterator[pa.RecordBatch], carry_only: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                told, data = row.pop("told", None), row.pop("data", None)
                if data is None:  # only a place: read again
                    with filesystem(path)[0].open_input_file(row["path"]) as f:
                        data = f.read_at(min(row["stop"] + AHEAD, row["size"]) - row["start"], row["start"])
                found = walk_split(data, row["start"], row["stop"], row["size"], told)
                rows = [{"what": "carry", "entry": found.entry, "exit": found.exit, "first": found.first}, *([] if carry_only else found.rows)]
                for at in range(0, len(rows), media.ROWS_AT_ONCE):
                    some = rows[at : at + media.ROWS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array([row[k] if k in row else r.get(k) for r in some], t) for k, t in fields], names=[k for k, _ in fields])

    rows = byte_ranges(spark, path, split).mapInArrow(run, whole).persist(StorageLevel.DISK_ONLY)
    carry, at = written(rows.where("what = 'carry'").select(*given, "entry", "exit", "first"), "carry")
    guessed, places = carry.select("path", "split", F.col("entry").alias("guess")), [at]
    before = F.last("exit", ignorenulls=True).over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    while True:
        known = carry.withColumn("told", before)
        wrong, at = written(known.where("split > 0").where(_wrong()).select(*given, "told"), "wrong")
        places.append(at)
        if wrong.isEmpty():
            break
        again = wrong.mapInArrow(lambda batches: run(batches, True), whole).select(carry.columns)
        carry, at = written(carry.join(wrong.select("path", "split"), ["path", "split"], "left_anti").unionByName(again), "carry")
        places.append(at)
    changed, at = written(known.join(guessed, ["path", "split"]).where("split > 0").where(~F.col("guess").eqNullSafe(F.col("entry"))).select(*given, "told"), "changed")
    for place in places:
        delete(spark, place)
    if changed.isEmpty():
        return rows
    return rows.join(changed.select("path", "split"), ["path", "split"], "left_anti").unionByName(changed.mapInArrow(run, whole))


def _before(rows: DataFrame, **sums: str) -> DataFrame:
    """Adds sums over the splits before a row's own: the splits' totals are few, and only they are ordered."""
    totals = rows.groupBy("path", "split").agg(*[F.sum(F.expr(v)).alias(k) for k, v in sums.items()])
    w = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("path", "split", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])
    return rows.join(totals, ["path", "split"])


# --- transport streams


def _packets_of(data: bytes, start: int, stop: int, size: int, told: int | None) -> tuple[np.ndarray, int | None, int | None]:
    """(places of a split's packets in its bytes, where it starts, where the next packet is searched for)."""
    buf = np.frombuffer(data, np.uint8)
    if told is None and start:
        sync = np.flatnonzero(buf == 0x47)
        sync = sync[sync < stop - start]
        for i in range(1, CHAIN + 1):
            sync = sync[(sync + 188 * i >= len(buf)) | (buf[np.minimum(sync + 188 * i, len(buf) - 1)] == 0x47)]
        told = start + int(sync[0]) if len(sync) else start
    entry = told if told is not None else start
    if entry >= stop:
        return np.zeros(0, np.int64), entry, None
    places = media.packet_offsets(buf[max(0, entry - start) :]) + max(0, entry - start)
    places = places[places < stop - start]
    return places, entry, max(stop, start + int(places[-1]) + 188) if len(places) else stop


def _ts_split(with_data: bool) -> Walk:
    def run(data: bytes, start: int, stop: int, size: int, told: int | None) -> Found:
        places, entry, exit_ = _packets_of(data, start, stop, size, told)
        packets, out = walk.Packets(data, places), [{"what": "packets", "index": len(places)}]
        for pid in np.unique(packets.pid[packets.has & (packets.pid > 31)]).tolist():
            own, body, at = packets.of(pid)
            first = np.flatnonzero(packets.start[own])
            cut = [*([] if len(first) and first[0] == 0 else [0]), *first.tolist()]  # what comes before the first start goes on from a split before
            for k, after in zip(cut, [*cut[1:], len(own)], strict=True):
                starts = bool(packets.start[own[k]])
                part = body[at[k] : at[after]]
                # ended by the next start: what has both needs no stitching
                what = "tail" if not starts else "whole" if after < len(own) else "open"
                out.append({"what": what, "index": int(own[k]), "pid": pid, "head": part[: at[k + 1] - at[k]] if starts else None, "bytes": len(part), "data": part if with_data else None})
        return Found(out, entry, exit_)

    return run


def ts_pes(spark: SparkSession, path: str, split: int = SPLIT, with_data: bool = False) -> DataFrame:
    """(path, pid, index, kind, pts_us, dts_us, size), with ``data`` if asked for: the elementary packets of the transport streams under a path, read in splits.

    Packets that start and end in a split are complete. Only the last open one of each stream and what goes on at a split's start meet in a window, a few rows for each split.
    """
    rows = _stitched(spark, path, split, _ts_split(with_data), "index long, pid long, head binary, bytes long, data binary")
    rows = _before(rows, packets_before="CASE WHEN what = 'packets' THEN index END")
    rows = rows.where("pid is not null").withColumn("index", F.col("index") + F.col("packets_before")).select("path", "split", "what", "pid", "index", "head", "bytes", "data")
    w = Window.partitionBy("path", "pid").orderBy("split", F.col("what") == "open", "index").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.where("what != 'whole'").withColumn("number", F.sum((F.col("what") == "open").cast("int")).over(w))
    # one of a split's whole packets ends what was open before it, and takes no part here: a tail belongs to the last open part
    joined = F.array_sort(F.collect_list(F.struct("split", "index", "data")))
    whole = parts.where("number > 0").groupBy("path", "pid", "number").agg(F.min("index").alias("index"), F.min_by("head", "index").alias("head"), F.sum("bytes").alias("bytes"), *[joined.alias("_d")] * with_data)
    if with_data:
        whole = whole.withColumn("data", W.joined(F.transform("_d", lambda x: x["data"])))
    columns = ["path", "pid", "index", "head", "bytes", *["data"] * with_data]
    return media.pes_of(rows.where("what = 'whole'").select(columns).unionByName(whole.select(columns)), ["path", "pid", "index"], "data" if with_data else None)


# --- MP3


def _frames_split(data: bytes, start: int, stop: int, size: int, told: int | None) -> Found:
    """Frames of a split. A walk that no frame follows ends for good: its exit is the file's size."""
    header = lambda at: int.from_bytes(data[at - start : at - start + 4], "big") if at + 4 <= min(size, start + len(data)) else 0
    length = lambda at: (n if (n := audio.frame_length(header(at))) and at + n <= size + 1 else 0)

    def search(at: int, chain: int) -> int | None:
        """The first place from ``at`` where so many frames follow one another, as far as the bytes go."""
        while at < stop:
            place, n = at, 0
            while n < chain and length(place):
                place, n = place + length(place), n + 1
            if n == chain or (n and place + 4 > start + len(data)):
                return at
            found = data.find(b"\xff", at + 1 - start)
            at = start + found if found >= 0 else stop
        return None

    first = search(start, 1)
    if told is None:
        told = ~audio._first_frame(data) if not start else search(start, CHAIN)
        if told is None:
            return Found([], None, None, first)
    at = told if told >= 0 else ~told
    if at >= stop:
        return Found([], told, None if start else told, first)
    if told < 0 and (found := search(at, 1)) is None:
        return Found([], told, ~stop, first)
    out, at = [], at if told >= 0 else found
    while at < stop and (n := length(at)):
        out.append({"what": "frame", "index": len(out), "offset": at, "bytes": n, "header": header(at)})
        at += n
    return Found(out, told, at if at >= stop else max(size, stop), first)


def mp3_frames(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The frames of the MP3 files under a path, read in splits: (path, index, offset, size, rate, channels, bitrate, n_samples, pts_us, duration_us)."""
    rows = _stitched(spark, path, split, _frames_split, "index long, offset long, bytes long, header long").where("what = 'frame'")
    frames = audio.header_fields(rows.select("path", "split", F.col("index").alias("n"), "offset", F.col("bytes").alias("size"), "header"))
    frames = _before(frames, frames_before="1", samples_before="n_samples")
    within = Window.partitionBy("path", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("samples_before") + F.coalesce(F.sum("n_samples").over(within), F.lit(0))
    us = lambda n: F.floor(n * 1_000_000 / F.col("rate") + 0.5)
    frames = frames.withColumns({"index": F.col("frames_before") + F.col("n"), "pts_us": us(before), "duration_us": us(F.col("n_samples"))})
    return frames.select("path", "index", "offset", "size", "rate", "channels", "bitrate", "n_samples", "pts_us", "duration_us")


# --- WAVE


def wav_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, bits, data_offset, frames, duration_us) of the WAVE files under a path; only the heads of their chunks are read, so files may have any size.

    :func:`tracklake.sources.media.wav_packets` cuts them into packets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("path", "fmt", "data_offset", "bytes")}
            for name, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                store, _ = filesystem(path)
                with store.open_input_file(name) as f:
                    head, at, chunks = f.read_at(min(12, size), 0), 12, {}
                    while head[:4] == b"RIFF" and head[8:12] == b"WAVE" and at + 8 <= size:
                        chunk = f.read_at(8, at)
                        length = int.from_bytes(chunk[4:8], "little")
                        chunks.setdefault(chunk[:4], (at + 8, min(length, size - at - 8)))
                        at += 8 + length + length % 2
                    if b"fmt " in chunks and b"data" in chunks:
                        for k, v in zip(out, (name, f.read_at(16, chunks[b"fmt "][0]), *chunks[b"data"]), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["fmt"], pa.binary()), pa.array(out["data_offset"], pa.int64()), pa.array(out["bytes"], pa.int64())], names=list(out))

    # one range of each file, of which no byte is read: the plan drops the column
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"))
    rows = files.mapInArrow(run, "path string, fmt binary, data_offset long, bytes long")
    rows = rows.select("path", B.uint_le(F.col("fmt"), 4, 4).alias("rate"), B.uint_le(F.col("fmt"), 2, 2).alias("channels"), B.uint_le(F.col("fmt"), 14, 2).alias("bits"), "data_offset", "bytes")
    return media.pcm_length(rows)
