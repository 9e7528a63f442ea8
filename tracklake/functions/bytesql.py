"""Byte and id functions as native column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(data: Column, at: int | Column, size: int | Column) -> Column:
    """``size`` bytes from the 0-based place ``at``."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.substring(data, at.cast("int") + 1, F.lit(size) if isinstance(size, int) else size.cast("int"))


def is_bytes(data: Column, at: int, text: bytes) -> Column:
    return part(data, at, len(text)) == F.lit(text)


def uint_be(data: Column, at: int | Column, size: int) -> Column:
    """Unsigned big-endian integer of up to 7 bytes; null past the end."""
    x = part(data, at, size)
    return F.when(F.length(x) == size, F.conv(F.hex(x), 16, 10).cast("long"))


def uint_le(data: Column, at: int | Column, size: int) -> Column:
    """Unsigned little-endian integer."""
    base = at if isinstance(at, Column) else F.lit(at)
    return sum((uint_be(data, base + i, 1) * (1 << (8 * i)) for i in range(1, size)), uint_be(data, base, 1))


def spaced_hex(data: Column) -> Column:
    """Lower-case hex, a blank between bytes."""
    return F.regexp_replace(F.lower(F.hex(data)), "(..)(?=.)", "$1 ")


def slice_bytes(data: Column, offset: Column, size: Column) -> Column:
    """Bytes [offset, offset + size), null where that is not wholly inside."""
    inside = (offset >= 0) & (size >= 0) & (offset + size <= F.length(data))
    return F.when(inside, F.substring(data, offset.cast("int") + 1, size.cast("int")))


def is_flv(data: Column) -> Column:
    return is_bytes(data, 0, b"FLV")


def is_wav(data: Column) -> Column:
    return is_bytes(data, 0, b"RIFF") & is_bytes(data, 8, b"WAVE")


def is_mp4(data: Column) -> Column:
    return (F.length(data) >= 12) & is_bytes(data, 4, b"ftyp")


def is_mpegts(data: Column) -> Column:
    """Sync bytes at the start of each of the first five whole packets of 188 bytes."""
    places = F.sequence(F.lit(0), F.least(F.lit(4), F.floor((F.length(data) - 1) / 188)).cast("int"))
    return (F.length(data) >= 188) & F.forall(places, lambda i: F.substring(data, i * 188 + 1, F.lit(1)) == F.lit(b"\x47"))


def is_flac(data: Column) -> Column:
    return is_bytes(data, 0, b"fLaC")


def is_mp3(data: Column) -> Column:
    sync = F.coalesce(uint_be(data, 0, 2).bitwiseAND(0xFFE0) == 0xFFE0, F.lit(False))
    return is_bytes(data, 0, b"ID3") | sync


def is_ogg_opus(data: Column) -> Column:
    return (F.length(data) >= 36) & is_bytes(data, 0, b"OggS") & is_bytes(data, 28, b"Opus")


def is_mpegps(data: Column) -> Column:
    return is_bytes(data, 0, b"\x00\x00\x01\xba")


def container_format(data: Column) -> Column:
    """Name of the container by its first bytes; the order of tests is fixed."""
    tests = [("flv", is_flv), ("mp4", is_mp4), ("mpegts", is_mpegts), ("mpegps", is_mpegps), ("wav", is_wav), ("flac", is_flac), ("mp3", is_mp3), ("opus", is_ogg_opus)]
    out = F.when(F.lit(False), F.lit(""))
    for name, test in tests:
        out = out.when(test(data), F.lit(name))
    return out.otherwise("unknown")


def probe_confidence(name: Column) -> Column:
    return F.when(name == "unknown", 0.0).when(name == "mp3", 0.7).otherwise(0.98)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII text, as a long."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(None)).otherwise(F.ascii(c)))
    step = lambda h, c: (h.bitwiseXOR(c.cast("long")) * 16777619).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(F.filter(codes, lambda c: c.isNotNull()), F.lit(2166136261).cast("long"), step)


def selection_id(text: Column) -> Column:
    return F.concat(F.lit("selection:"), F.lpad(F.lower(F.hex(fnv1a32(text))), 8, "0"))


def avc_codec_string(config: Column) -> Column:
    """``avc1.`` and bytes 1 to 3 of a decoder configuration in hex; null if it is shorter."""
    return F.when(F.length(config) >= 4, F.concat(F.lit("avc1."), F.lower(F.hex(part(config, 1, 3)))))


#: Sampling rates by index in AAC configurations, fixed by the format.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]


def audio_specific_config(object_type: Column, rate: Column, channels: Column) -> Column:
    """Two bytes as hex: 5 bits object type, 4 bits rate index, 4 bits channels; null for unknown rates or no channels."""
    index = F.array_position(F.array(*[F.lit(r) for r in AAC_RATES]), rate.cast("int")) - 1
    word = F.shiftleft(object_type.cast("int"), 11) + F.shiftleft(index.cast("int"), 7) + F.shiftleft(channels.cast("int"), 3)
    return F.when((index >= 0) & (channels > 0), F.lower(F.lpad(F.hex(word), 4, "0")))


def picture_of_slice(codec: str, slice_type: Column) -> Column:
    """Picture type of a slice type: modulo five for h264, 0 to 2 for h265."""
    if codec == "h265":
        return F.when(slice_type == 0, "B").when(slice_type == 1, "P").when(slice_type == 2, "I")
    kind = slice_type % 5
    return F.when(kind == 0, "P").when(kind == 1, "B").when(kind == 2, "I").when(kind == 3, "SP").when(kind == 4, "SI")


def ulaw_to_pcm16(code: Column) -> Column:
    """ITU G.711 mu-law byte (0 to 255) to a linear 16-bit value, by the standard's formula."""
    inverted = 255 - code
    mantissa, exponent = inverted.bitwiseAND(15), F.shiftright(inverted, 4).bitwiseAND(7)
    size = (mantissa * 8 + 132) * F.pow(F.lit(2), exponent).cast("int") - 132
    return F.when(code < 128, -size).otherwise(size)


def alaw_to_pcm16(code: Column) -> Column:
    """ITU G.711 A-law byte to a linear 16-bit value, by the standard's formula."""
    x = code.bitwiseXOR(F.lit(0x55))
    mantissa, exponent = x.bitwiseAND(15), F.shiftright(x, 4).bitwiseAND(7)
    size = F.when(exponent == 0, mantissa * 16 + 8).otherwise((mantissa * 16 + 264) * F.pow(F.lit(2), F.greatest(exponent - 1, F.lit(0))).cast("int"))
    return F.when(x.bitwiseAND(128) == 128, size).otherwise(-size)


def bytes_of(data: Column) -> Column:
    """Bytes as an array of integers."""
    return F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
