"""Packets and network abstraction units as native expressions; bytes are handled as Latin-1 text where patterns help."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesql as B
from . import writers as W

LATIN = "ISO-8859-1"


def has_start_code(data: Column) -> Column:
    return B.is_bytes(data, 0, b"\x00\x00\x01") | B.is_bytes(data, 0, b"\x00\x00\x00\x01")


def annexb_nals(data: Column, strip_zeros: bool = True) -> Column:
    """Units between start codes, as binaries; what stands before the first code is no unit. Zeros before a code or at the end belong to no
    unit, unless ``strip_zeros`` is off: then only the code itself is taken."""
    text = F.decode(data, LATIN)
    parts = F.split(text, "\\x00{2,}\\x01" if strip_zeros else "\\x00?\\x00\\x00\\x01")
    units = F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))
    if strip_zeros:
        units = F.transform(units, lambda u: F.regexp_replace(u, "\\x00+$", ""))
    return F.transform(F.filter(units, lambda u: F.length(u) > 0), lambda u: F.encode(u, LATIN))


def length_prefixed(nals: Column, size: int = 4) -> Column:
    """Units with big-endian lengths before them, as one binary; null if there are none."""
    return F.when(F.size(nals) > 0, W.joined(F.transform(nals, lambda u: F.concat(W.be(F.length(u), size), u))))


#: Bytes of packets whose units are Python objects at once.
UNITS_AT_ONCE = 1 << 20


def _in_pieces(column: pa.Array, take: Callable[[bytes], list[bytes] | None]) -> pa.Array:
    """The units of each packet as one list array, made in pieces of about so many bytes; a batch of long texts would be millions of objects."""
    kind, done, held, size = pa.list_(pa.binary()), [], [], 0
    for value in column:
        data = value.as_py() or b""
        held.append(take(data))
        size += len(data)
        if size >= UNITS_AT_ONCE:
            done.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*done, pa.array(held, kind)])


def _length_units(data: bytes, size: int, strict: bool) -> list[bytes] | None:
    at, units = 0, []
    while at + size <= len(data):
        length = int.from_bytes(data[at : at + size], "big")
        if not length or at + size + length > len(data):
            break
        units.append(data[at + size : at + size + length])
        at += size + length
    return None if strict and not (units and at == len(data)) else units


def units_of_lengths(data: Column, size: int = 4, strict: bool = False) -> Column:
    """Units that have their lengths before them, up to the first length that can't be; ``strict``: null unless all bytes belong to units.

    Each length tells where the next one stands, so the walk runs over Arrow batches.
    """
    return F.arrow_udf(lambda column: _in_pieces(column, lambda packet: _length_units(packet, size, strict)), "array<binary>", F.ArrowUDFType.SCALAR)(data)


def annexb_of_lengths(data: Column, size: int = 4) -> Column:
    """Units with start codes of four bytes in place of their lengths; data without a unit as it is."""
    units = units_of_lengths(data, size)
    return F.when(F.size(units) > 0, W.joined(F.transform(units, lambda u: F.concat(F.lit(b"\0\0\0\1"), u)))).otherwise(data)


def unit_rows(rows: DataFrame, data: str, codec: str = "h264", size: int = 4) -> DataFrame:
    """``rows`` with one row (n, unit, kind, payload) for each unit of a column with lengths; ``payload`` keeps the header and drops emulation prevention."""
    out = rows.select("*", F.posexplode(units_of_lengths(F.col(data), size)).alias("n", "unit"))
    head = 1 if codec == "h264" else 2
    kind = h264_nal_type(F.col("unit")) if codec == "h264" else h265_nal_type(F.col("unit"))
    return out.where(F.length("unit") >= head).withColumns({"kind": kind, "payload": with_header(F.col("unit"), head)})


def with_header(unit: Column, head: int) -> Column:
    """A unit's header as it is, and the rest without emulation prevention."""
    return F.concat(F.substring(unit, 1, head), without_emulation_prevention(F.substring(unit, head + 1, F.length(unit))))


def without_emulation_prevention(data: Column) -> Column:
    """Drops 03 of 00 00 03 where a byte of at most 03 follows."""
    return F.encode(F.regexp_replace(F.decode(data, LATIN), "\\x00\\x00\\x03(?=[\\x00-\\x03])", "\x00\x00"), LATIN)


def with_emulation_prevention(data: Column) -> Column:
    """Puts 03 after two zero bytes that a byte of at most 03 follows, so that no start code stands inside a unit."""
    return F.encode(F.regexp_replace(F.decode(data, LATIN), "\\x00\\x00(?=[\\x00-\\x03])", "\x00\x00\x03"), LATIN)


def adts_frames(data: Column) -> Column:
    """The raw frames of a run of ADTS frames; each header tells where the next one stands, so the walk runs over Arrow batches."""

    def frames(all_: bytes) -> list[bytes]:
        at, found = 0, []
        while at + 7 <= len(all_) and all_[at] == 255 and all_[at + 1] & 0xF6 == 0xF0:
            size, head = int.from_bytes(all_[at + 3 : at + 6], "big") >> 5 & 0x1FFF, 7 if all_[at + 1] & 1 else 9
            if size <= head or at + size > len(all_):
                break
            found.append(all_[at + head : at + size])
            at += size
        return found

    return F.arrow_udf(lambda column: _in_pieces(column, frames), "array<binary>", F.ArrowUDFType.SCALAR)(data)


def h264_nal_type(nal: Column) -> Column:
    return B.uint_be(nal, 0, 1).bitwiseAND(31)


def h265_nal_type(nal: Column) -> Column:
    return F.shiftright(B.uint_be(nal, 0, 1), 1).bitwiseAND(63)


def picture_of_nal(codec: str, kind: Column) -> Column:
    """I or P by unit type, null for units without a slice."""
    if codec == "h265":
        return F.when(kind.between(16, 21), "I").when(kind.between(0, 9), "P")
    return F.when(kind == 5, "I").when(kind == 1, "P")


def without_adts(data: Column) -> Column:
    """Raw AAC of an ADTS frame: 7 bytes of header less, 9 with a checksum; other data as it is."""
    head = F.when(B.uint_be(data, 1, 1).bitwiseAND(1) != 0, 7).otherwise(9)
    is_frame = (F.length(data) >= 7) & (F.length(data) > head) & (B.uint_be(data, 0, 2).bitwiseAND(0xFFF0) == 0xFFF0)
    return F.when(is_frame, F.substring(data, head + 1, F.length(data))).otherwise(data)


def codec_family(family: Column, codec: Column) -> Column:
    """The stated family, or one by the codec's name where that is unknown."""
    return F.when(family != "unknown", family).when(codec.rlike("(?i)pcm|float"), "pcm").when(codec.rlike("(?i)mp3|mpeg audio layer iii"), "mp3").otherwise("unknown")


def bitstream_format(kind: Column, container: Column, family: Column) -> Column:
    """How packets of a track are laid out, by its kind, container and codec family."""
    transport = container.isin("mpegts", "mpegps")
    video = F.when(transport, "annexb").when(container.isin("flv", "mp4"), "avcc")
    audio = F.when(family == "g711", "g711_ulaw").when((family == "aac") & transport, "adts").when(family == "aac", "aac_raw").when(family == "mp3", "mp3")
    return F.coalesce(F.when(kind == "video", video).otherwise(audio), F.lit("unknown"))
