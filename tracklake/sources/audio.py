"""Sound files without a container of tracks: MP3 frames, and the headers of FLAC and Ogg Opus.

MP3 frames follow one another by lengths that their headers give, so a short walk finds them and keeps each header as a number; all that
the header tells is read from that number natively.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import bytesql as B

from .media import _walk

# Fixed values of MPEG audio, layer III: kilobits a second of MPEG-1 and of its low rates, and samples a second by version and index.
RATES_1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES_2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
SAMPLING = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def frame_length(header: int) -> int:
    """Bytes of the layer III frame that a 32-bit header starts, 0 if it starts none."""
    version, layer, rate, sampling = header >> 19 & 3, header >> 17 & 3, header >> 12 & 15, header >> 10 & 3
    if header >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or sampling == 3:
        return 0
    first = version == 3
    size = (144 if first else 72) * (RATES_1 if first else RATES_2)[rate] * 1000 // SAMPLING[version][sampling] + (header >> 9 & 1)
    return size if size > 4 else 0


def _first_frame(data: bytes) -> int:
    """Where frames can begin: after an ID3 tag and its footer."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = 0
    for byte in data[6:10]:
        size = size << 7 | byte & 127
    return 10 + size + (10 if data[5] & 16 else 0)


def frame_walk(data: bytes) -> Iterator[tuple]:
    """Index, offset, size and header of the frames of an MP3 file."""
    at, found = _first_frame(data), 0
    while at + 4 <= len(data):
        header = int.from_bytes(data[at : at + 4], "big")
        size = frame_length(header)
        if size and at + size <= len(data) + 1:
            yield found, at, size, header
            at, found = at + size, found + 1
        elif found:
            return
        else:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                return


def mp3_frames(sources: DataFrame) -> DataFrame:
    """(source_id, index, offset, size, rate, channels, bitrate, n_samples, pts_us, duration_us) of the frames of MP3 files.

    The first frame is looked for byte by byte; the walk ends where no further frame stands. A last frame may lack a byte.
    """
    return timed_frames(_walk(sources.where(B.is_mp3(F.col("data"))), frame_walk, "index long, offset long, size long, header long"))


def timed_frames(rows: DataFrame) -> DataFrame:
    """What the headers of rows (source_id, index, offset, size, header) say of their frames, with times by the samples before them."""
    rows = header_fields(rows)
    before = F.coalesce(F.sum("n_samples").over(Window.partitionBy("source_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    us = lambda n: F.floor(n * 1_000_000 / F.col("rate") + 0.5)
    return rows.withColumns({"pts_us": us(before), "duration_us": us(F.col("n_samples"))})


def header_fields(rows: DataFrame) -> DataFrame:
    """Rate, channels, bitrate and number of samples of frames, by their ``header``."""
    bits = lambda shift, n: F.shiftright("header", shift).bitwiseAND((1 << n) - 1)
    first = bits(19, 2) == 3
    pick = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), at.cast("int")).cast("long")
    rate = F.when(first, pick(SAMPLING[3], bits(10, 2))).when(bits(19, 2) == 2, pick(SAMPLING[2], bits(10, 2))).otherwise(pick(SAMPLING[0], bits(10, 2)))
    bitrate = F.when(first, pick(RATES_1, bits(12, 4))).otherwise(pick(RATES_2, bits(12, 4))) * 1000
    return rows.withColumns({"rate": rate, "channels": F.when(bits(6, 2) == 3, 1).otherwise(2).cast("long"), "bitrate": bitrate, "n_samples": F.when(first, 1152).otherwise(576).cast("long")}).drop("header")


def mp3_tracks(frames: DataFrame) -> DataFrame:
    """(source_id, rate, channels, bitrate, frames, duration_us) by the first frame's header and the number of frames."""
    first = F.min_by(F.struct("rate", "channels", "bitrate", "n_samples"), "index").alias("f")
    rows = frames.groupBy("source_id").agg(first, F.count("*").alias("frames"))
    length = F.floor(F.col("frames") * F.col("f.n_samples") * 1_000_000 / F.col("f.rate") + 0.5)
    return rows.select("source_id", "f.rate", "f.channels", "f.bitrate", "frames", length.alias("duration_us"))


def flac_tracks(sources: DataFrame) -> DataFrame:
    """(source_id, rate, channels, bits, frames, duration_us) by the stream information, which is a FLAC file's first block."""
    data = F.col("data")
    rows = sources.where(B.is_flac(data) & (F.length(data) >= 42))
    rate = F.shiftright(B.uint_be(data, 18, 4), 12)
    tail = B.uint_be(data, 20, 2)
    frames = B.uint_be(data, 21, 5).bitwiseAND((1 << 36) - 1)
    rows = rows.select("source_id", rate.alias("rate"), (F.shiftright(tail, 9).bitwiseAND(7) + 1).alias("channels"), (F.shiftright(tail, 4).bitwiseAND(31) + 1).alias("bits"), frames.alias("frames"))
    return rows.withColumn("duration_us", F.when((F.col("rate") > 0) & (F.col("frames") > 0), F.floor(F.col("frames") * 1_000_000 / F.col("rate") + 0.5)))


def opus_tracks(sources: DataFrame) -> DataFrame:
    """(source_id, rate, channels, pre_skip) by the header packet of Ogg Opus files; ``rate`` is that of the sound before encoding."""
    data = F.col("data")
    rows = sources.where(B.is_ogg_opus(data) & (F.length(data) >= 47))
    return rows.select("source_id", B.uint_le(data, 40, 4).alias("rate"), B.uint_be(data, 37, 1).alias("channels"), B.uint_le(data, 38, 2).alias("pre_skip"))


def _bytes(values: Iterable[int]) -> str:
    """One of these bytes, in a pattern over their Latin-1 characters."""
    return f"[{''.join(f'\\x{x:02X}' for x in values)}]"


_RATED = [x for x in range(256) if (x >> 2 & 15) < len(B.AAC_RATES)]
#: The seven bytes of an ADTS header: a sync word of layer 0, a rate that is known, and channels other than 0, whose first bit ends the third byte.
ADTS = rf"(?s)\xFF{_bytes([0xF0, 0xF1, 0xF8, 0xF9])}(?:{_bytes(x for x in _RATED if x & 1)}.|{_bytes(x for x in _RATED if not x & 1)}[\x40-\xFF]).{{3}}"


def adts_header(data: Column) -> Column:
    """struct<object_type, rate_index, rate, channels> of the first ADTS header that starts in the first 256 bytes; null if none does.

    It is an array of what one search finds, made into structs, as a condition over the search would repeat it for each field.
    """
    found = F.regexp_extract(F.decode(F.substring(data, 1, 256), "ISO-8859-1"), ADTS, 0)
    words = F.transform(F.filter(F.array(found), lambda x: x != ""), lambda x: F.ascii(F.substring(x, 3, 1)) * 256 + F.ascii(F.substring(x, 4, 1)))
    rates = F.array(*[F.lit(r) for r in B.AAC_RATES])

    def fields(word: Column) -> Column:
        index = F.shiftright(word, 10).bitwiseAND(15)
        return F.struct((F.shiftright(word, 14) + 1).alias("object_type"), index.alias("rate_index"), F.get(rates, index).alias("rate"), F.shiftright(word, 6).bitwiseAND(7).alias("channels"))

    return F.get(F.transform(words, fields), F.lit(0))


def asc_of_header(h: Column) -> Column:
    """The two bytes of configuration that say what an ADTS header, as :func:`adts_header` gives it, says."""
    word = F.shiftleft(h["object_type"], 11) + F.shiftleft(h["rate_index"], 7) + F.shiftleft(h["channels"], 3)
    return F.unhex(F.lpad(F.hex(word.cast("long")), 4, "0"))


def asc_of_adts(data: Column) -> Column:
    """The two bytes of configuration that say what the first ADTS header in some bytes says."""
    return asc_of_header(adts_header(data))


def _sound_config(config: bytes) -> dict | None:
    """The fields of one AAC configuration; those that its bytes don't reach are None."""
    if len(config) < 2:
        return None
    bits = "".join(f"{b:08b}" for b in config[:16])
    take = lambda at, n: int(bits[at : at + n] or "0", 2)
    known = lambda index, at: take(at, 24) if index == 15 else dict(enumerate(B.AAC_RATES)).get(index, 0)
    kind, index = take(0, 5), take(5, 4)
    at = 33 if index == 15 else 9
    early, after, told = at + 4, at + 7, kind in (5, 29)  # an extension that is told first stands before the three flags of the sound's own configuration
    out = {"object_type": kind, "rate": known(index, 9), "channels": take(at, 4), "extension_type": None, "extension_rate": None, "sbr": False, "ps": None}
    if told and len(config) >= 3:
        rate = take(early, 4)
        return out | {"extension_type": take(early + (28 if rate == 15 else 4), 5), "extension_rate": known(rate, early + 4)}
    if not told and len(config) >= 4 and take(after, 11) == 0x2B7:
        out["extension_type"] = take(after + 11, 5)
        if out["extension_type"] == 5 and take(after + 16, 1):
            rate = take(after + 17, 4)
            more = after + (45 if rate == 15 else 21)
            ps = bool(take(more + 11, 1)) if len(bits) >= more + 12 and take(more, 11) == 0x548 else None
            out |= {"sbr": True, "extension_rate": known(rate, after + 21), "ps": ps}
    return out


_CONFIG = pa.struct([("object_type", pa.int32()), ("rate", pa.int32()), ("channels", pa.int32()), ("extension_type", pa.int32()), ("extension_rate", pa.int32()), ("sbr", pa.bool_()), ("ps", pa.bool_())])


def _sound_configs(configs: pa.Array) -> pa.Array:
    return pa.array([_sound_config(c.as_py() or b"") for c in configs], _CONFIG)


def audio_config(config: Column) -> Column:
    """struct of an AAC configuration: object type, rate and channels, and the extension for spectral band replication.

    A null or shorter one than two bytes gives null. There is one for each track, and each says by its bits where the next ones are.
    """
    read = F.arrow_udf(_sound_configs, "object_type int, rate int, channels int, extension_type int, extension_rate int, sbr boolean, ps boolean", F.ArrowUDFType.SCALAR)
    return read(config)
