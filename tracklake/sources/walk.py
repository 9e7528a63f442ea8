"""One walk over each file, whatever its container: a single Arrow operator sniffs a file, steps through it once and yields tagged rows.

``what`` tells the rows apart, and the other columns hold what that kind has:

* ``tag`` (FLV), ``frame`` (MP3), ``packet`` (program streams), ``pes`` (transport streams), ``sample`` (MP4): timed pieces, with ``offset`` and ``size``, or ``data`` if it is asked for
* ``pcm`` (WAVE): the format in ``body``, and where the sound lies
* ``box`` (MP4): boxes, with a ``body`` for headers
* ``section``, ``set``, ``sound`` (transport streams): tables, the first parameter sets and the first ADTS header of each stream
* ``head`` (FLAC, Opus): the first bytes

Tracks, samples and streams are relational questions to these rows. They hold no payload unless ``with_data`` is set, so they are small, and a table that
answers several questions is read from one ``persist()`` (see ``tracklake.plans.workflows.Walk``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions import bytesql as B

from . import audio, media, transport

SCHEMA = "source_id string, format string, what string, index long, track long, number long, name string, kind string, pts_us long, dts_us long, is_key boolean, config boolean, offset long, size long, ticks long, shift long, slices binary, body binary, data binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_FIELDS = [(x.split()[0], _KINDS[x.split()[1]]) for x in SCHEMA.split(", ")]
#: Boxes whose body says something of a movie or a track.
HEADERS = {"mvhd", "tkhd", "mdhd", "hdlr", "stsd"}
#: Bytes kept of a file, an elementary packet or a sound packet that has only a header to tell.
HEAD = 64
#: Rows of a step through a file, and bytes of files, up to which they share a batch with those of others.
SHARED_ROWS, SHARED_BYTES = 1 << 10, 1 << 22


def _rows(what: str, names: str, found: Iterator[tuple]) -> Iterator[dict]:
    """Tuples as columns, some thousand rows at a time."""
    while some := list(islice(found, media.ROWS_AT_ONCE)):
        yield {"what": [what] * len(some), **dict(zip(names.split(), zip(*some), strict=True))}


def _wav(data: bytes, with_data: bool) -> Iterator[dict]:
    chunks = {}
    for name, offset, size in media.chunk_walk(data):
        chunks.setdefault(name, (offset, size))
    if "fmt " in chunks and "data" in chunks:
        at = chunks["fmt "][0]
        yield from _rows("pcm", "kind offset size body", iter([("audio", *chunks["data"], data[at : at + 16])]))


def _mp3(data: bytes, with_data: bool) -> Iterator[dict]:
    yield from _rows("frame", "kind index offset size number data", (("audio", i, at, size, header, data[at : at + size] if with_data else None) for i, at, size, header in audio.frame_walk(data)))


def _flv(data: bytes, with_data: bool) -> Iterator[dict]:
    def tags() -> Iterator[tuple]:
        heard = False
        for kind, pts, dts, is_key, codec, config, offset, size in media.tag_walk(data):
            body = data[offset - (kind == "script") : offset + size] if kind == "script" or config else None  # script tags have no byte before their values
            if kind == "audio" and not config and not heard:
                body, heard = data[offset : offset + 5], True
            yield kind, pts, dts, is_key, int(codec), config, offset, offset, size, body, data[offset : offset + size] if with_data else None

    yield from _rows("tag", "kind pts_us dts_us is_key number config index offset size body data", tags())


def _ps(data: bytes, with_data: bool) -> Iterator[dict]:
    yield from _rows("packet", "index track body offset size data", ((i, kind, head, at, size, data[at : at + size] if with_data else None) for i, kind, head, at, size in transport.packet_walk(data)))


def _mp4(data: bytes, with_data: bool) -> Iterator[dict]:
    tables: dict[int, dict[str, bytes]] = {}
    tell: dict[int, dict[str, bytes]] = {}

    def boxes() -> Iterator[tuple]:
        for i, (name, track, offset, size, body) in enumerate(media.box_walk(data)):
            if name in media.TABLES:
                tables.setdefault(track, {}).setdefault(name, body)
            elif name in HEADERS:
                tell.setdefault(track, {}).setdefault(name, body)
            yield name, i, track, offset, size, body if name in HEADERS else None

    yield from _rows("box", "name index track offset size body", boxes())
    for track, own in tables.items():
        handler, head = (tell.get(track, {}).get(k) or b"" for k in ("hdlr", "mdhd"))
        kind = {b"vide": "video", b"soun": "audio"}.get(handler[8:12])
        at = 20 if head[:1] == b"\1" else 12
        scale = int.from_bytes(head[at : at + 4], "big")
        if not kind:
            continue
        found = media.sample_table(own)
        us = {k: np.floor(found[k] * 1_000_000 / scale + 0.5).astype(np.int64) if scale else np.full(len(found[k]), None) for k in ("dts", "pts")}
        for first in range(0, len(found["size"]), media.ROWS_AT_ONCE):
            some = slice(first, first + media.ROWS_AT_ONCE)
            offset, size = found["offset"][some], found["size"][some]
            n = len(size)
            given = {"index": np.arange(first, first + n), "pts_us": us["pts"][some], "dts_us": us["dts"][some], "is_key": found["is_key"][some], "offset": offset, "size": size, "ticks": found["dts"][some], "shift": (found["pts"] - found["dts"])[some]}
            if with_data:
                given["data"] = [data[a : a + b] if a + b <= len(data) else None for a, b in zip(offset.tolist(), size.tolist(), strict=True)]
            yield {"what": ["sample"] * n, "track": [track] * n, "kind": [kind] * n, **given}


def _head(data: bytes, with_data: bool) -> Iterator[dict]:
    yield from _rows("head", "body", iter([(data[:HEAD],)]))


def _starts_adts(data: bytes) -> bool:
    """Whether the first 256 bytes have what can be an ADTS header."""
    part = data[:256]
    at = part.find(b"\xff")
    while 0 <= at <= len(part) - 7:
        if part[at + 1] & 0xF6 == 0xF0 and part[at + 2] >> 2 & 15 < len(B.AAC_RATES) and (part[at + 2] & 1) << 2 | part[at + 3] >> 6:
            return True
        at = part.find(b"\xff", at + 1)
    return False


def _units(payload: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, unit) between start codes."""
    at, n = payload.find(b"\0\0\1"), 0
    while at >= 0:
        end = payload.find(b"\0\0\1", at + 3)
        unit = payload[at + 3 : end if end >= 0 else len(payload)].rstrip(b"\0")
        if unit:
            yield n, unit
            n += 1
        at = end


class Packets:
    """Headers of the packets of a transport stream, and their bytes."""

    def __init__(self, data: bytes, places: np.ndarray | None = None) -> None:
        buf = np.frombuffer(data, np.uint8)
        self.places = media.packet_offsets(buf) if places is None else places
        self.all = buf[self.places[:, None] + np.arange(188)]
        control = self.all[:, 3] >> 4 & 3
        self.pid = (self.all[:, 1].astype(np.int64) & 31) << 8 | self.all[:, 2]
        self.start = self.all[:, 1] & 0x40 != 0
        self.skip = np.minimum(np.where(control >= 2, 5 + self.all[:, 4].astype(np.int64), 4), 188)
        self.has = np.isin(control, (1, 3))

    def payload(self, i: int) -> bytes:
        return self.all[i, self.skip[i] :].tobytes()

    def of(self, pid: int) -> tuple[np.ndarray, bytes, np.ndarray]:
        """(the packets of a stream, their payloads side by side, where each starts, and the end)."""
        own = np.flatnonzero(self.has & (self.pid == pid))
        rows = self.all[own]
        ends = np.cumsum(188 - self.skip[own])
        return own, rows[np.arange(188) >= self.skip[own][:, None]].tobytes(), np.concatenate([[0], ends])


def pes_kind(head: bytes) -> str | None:
    """The kind of the elementary packet that starts so; null for other streams and for what starts none."""
    if head[:3] != b"\0\0\1" or len(head) < 9:
        return None
    return "audio" if 0xC0 <= head[3] <= 0xDF else "video" if 0xE0 <= head[3] <= 0xEF else None


def pes_payload(packet: bytes) -> bytes:
    """The payload of an elementary packet, to its stated length if it has one."""
    stated, skip = int.from_bytes(packet[4:6], "big"), packet[8]
    payload = packet[9 + skip :]
    return payload[: max(0, stated - 3 - skip)] if stated else payload


def _slices(units: list[bytes]) -> bytes:
    """First bytes of the first unit that would be a slice of H.264, and of H.265; 255 for none."""
    one = next((u[0] for u in units if u[0] & 31 in (1, 5)), 255)
    two = next((u[0] for u in units if (u[0] >> 1 & 63) <= 9 or 16 <= (u[0] >> 1 & 63) <= 21), 255)
    return bytes([one, two])


def _ts(data: bytes, with_data: bool) -> Iterator[dict]:
    packets = Packets(data)
    told: set[tuple[int, bytes]] = set()

    def sections() -> Iterator[tuple]:
        for i in np.flatnonzero(packets.has & packets.start).tolist():
            payload, pid = packets.payload(i), int(packets.pid[i])
            if payload[:3] != b"\0\0\1" and (pid, payload) not in told:
                told.add((pid, payload))
                yield i, pid, payload

    yield from _rows("section", "index track body", sections())
    for pid in np.unique(packets.pid[packets.has & (packets.pid > 31)]).tolist():
        own, body, at = packets.of(pid)
        first = np.flatnonzero(packets.start[own])
        extra: list[tuple] = []

        def stream(own=own, body=body, at=at, first=first, pid=pid, extra=extra) -> Iterator[tuple]:
            sets, heard = set(), False
            for k, (begin, end) in zip(first.tolist(), zip(at[first].tolist(), [*at[first[1:]].tolist(), len(body)], strict=True), strict=True):
                packet, index = body[begin:end], int(own[k])
                kind = pes_kind(packet[: at[k + 1] - at[k]])
                if not kind:
                    continue
                payload, slices = pes_payload(packet), None
                if kind == "video":
                    units = list(_units(payload))
                    slices = _slices([u for _, u in units])
                    for n, unit in units:
                        if unit[0] & 31 in (7, 8) and unit[0] & 31 not in sets:
                            sets.add(unit[0] & 31)
                            extra.append(("set", index, pid, n, unit))
                elif not heard and _starts_adts(payload):
                    heard = True
                    extra.append(("sound", index, pid, None, payload[:256]))
                yield index, pid, kind, packet[:HEAD], len(payload), slices, payload if with_data else None

        yield from _rows("pes", "index track kind body size slices data", stream())
        if extra:
            what, *columns = zip(*extra, strict=True)
            yield {"what": what, **dict(zip(("index", "track", "number", "body"), columns, strict=True))}


WALKS = {"wav": _wav, "mp3": _mp3, "flv": _flv, "mpegts": _ts, "mpegps": _ps, "mp4": _mp4, "flac": _head, "opus": _head}


def sniff(data: bytes) -> str | None:
    """The container by the first bytes, as :func:`tracklake.functions.bytesql.container_format` tells it."""
    starts = [data[i : i + 1] == b"\x47" for i in range(0, min(len(data), 188 * 5), 188)]
    tests = [
        ("flv", data[:3] == b"FLV"), ("mp4", len(data) >= 12 and data[4:8] == b"ftyp"), ("mpegts", len(data) >= 188 and all(starts)), ("mpegps", data[:4] == b"\0\0\1\xba"),
        ("wav", data[:4] == b"RIFF" and data[8:12] == b"WAVE"), ("flac", data[:4] == b"fLaC"), ("mp3", data[:3] == b"ID3" or (len(data) >= 2 and data[0] == 255 and data[1] & 0xE0 == 0xE0)),
        ("opus", len(data) >= 36 and data[:4] == b"OggS" and data[28:32] == b"Opus"),
    ]
    return next((name for name, fits in tests if fits), None)


def _run(batches: Iterator[pa.RecordBatch], formats: Sequence[str], with_data: bool = False, columns: Sequence[str] | None = None, kinds: Sequence[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of files; small files share a batch, as one for each would take longer than the walk."""
    held: dict[str, list] = {}
    n = size = 0
    fields = [(k, t) for k, t in _FIELDS if columns is None or k in columns]

    def batch_of(found: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[k], t) if k in found else pa.nulls(n, t) for k, t in fields], names=[k for k, _ in fields])

    def shared() -> Iterator[pa.RecordBatch]:
        nonlocal held, n, size
        if n:
            yield batch_of({k: c + [None] * (n - len(c)) for k, c in held.items()}, n)
        held, n, size = {}, 0, 0

    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = value.as_py() or b""
            form = sniff(data)
            if form not in formats:
                continue
            size += len(data)
            for found in WALKS[form](data, with_data):
                if kinds is not None:
                    wanted = [k in kinds for k in found.get("kind", ())]
                    found = {k: list(compress(some, wanted)) for k, some in found.items()}
                rows = len(found["what"])
                found = {"source_id": [name] * rows, "format": [form] * rows, **found}
                if rows > SHARED_ROWS or (rows and len(data) > SHARED_BYTES):
                    yield from shared()
                    yield batch_of(found, rows)
                    continue
                for k, _ in fields:
                    if k in found:
                        column = held.setdefault(k, [])
                        column.extend([None] * (n - len(column)))
                        column.extend(found[k])
                n += rows
            if n >= media.ROWS_AT_ONCE or size >= SHARED_BYTES:
                yield from shared()
    yield from shared()


def files(sources: DataFrame, formats: Sequence[str] | None = None, with_data: bool = False, columns: Sequence[str] | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """The tagged rows of sources (source_id, data), of all formats or of those named; null and unknown contents have none.

    A file is sniffed where it is walked: as columns, the tests would repeat whatever makes ``data``. Who asks for some columns, or for rows of some
    kinds, names them, so that the others are not handed on from Python.
    """
    known = [f for f in formats or WALKS if f in WALKS]
    schema = ", ".join(x for x in SCHEMA.split(", ") if columns is None or x.split()[0] in columns)
    return sources.select(F.col("source_id").cast("string").alias("source_id"), "data").mapInArrow(lambda batches: _run(batches, known, with_data, columns, kinds), schema)
