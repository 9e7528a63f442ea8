"""What FLV files say of themselves: the header, script values, and the sound of the audio stream."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import bytesql as B

from . import walk
from .audio import RATES_1, SAMPLING, audio_config


def headers(sources: DataFrame) -> DataFrame:
    """(source_id, version, has_audio, has_video, data_offset) of FLV files."""
    data = F.col("data")
    flags = B.uint_be(data, 4, 1)
    rows = sources.where(B.is_flv(data) & (F.length(data) >= 9))
    return rows.select("source_id", B.uint_be(data, 3, 1).alias("version"), (flags.bitwiseAND(4) != 0).alias("has_audio"), (flags.bitwiseAND(1) != 0).alias("has_video"), B.uint_be(data, 5, 4).alias("data_offset"))


#: Columns of a walk that script values are read from.
TOLD = ("source_id", "format", "what", "kind", "offset", "body")


class _Cut(Exception):
    """A value goes on past the end of its tag."""


def amf_values(data: bytes, at: int, path: str = "") -> tuple[list[tuple[str, float | None, str | None]], int]:
    """((path, number, text) of the plain values in one AMF0 value, where it ends); truth values are 0 and 1, kinds that have no value here give none."""
    if at >= len(data):
        raise _Cut
    kind, at = data[at], at + 1
    if kind == 0 and at + 8 <= len(data):
        return [(path, struct.unpack_from(">d", data, at)[0], None)], at + 8
    if kind == 1 and at < len(data):
        return [(path, float(data[at] != 0), None)], at + 1
    if kind == 2 and at + 2 <= len(data):
        size = int.from_bytes(data[at : at + 2], "big")
        return [(path, None, data[at + 2 : at + 2 + size].decode("utf-8", "replace"))], at + 2 + size
    if kind in (3, 8):
        out, at = [], at + (4 if kind == 8 else 0)
        while at + 2 <= len(data) and data[at : at + 3] != b"\0\0\x09":
            size = int.from_bytes(data[at : at + 2], "big")
            key = data[at + 2 : at + 2 + size].decode("utf-8", "replace")
            values, at = amf_values(data, at + 2 + size, f"{path}.{key}" if path else key)
            out += values
        return out, at + 3
    if kind in (5, 6):
        return [], at
    raise _Cut


def script_values(sources: DataFrame) -> DataFrame:
    """(source_id, key, number, text): the values of script tags; of a key that comes again the last counts."""
    files = sources.select(F.col("source_id").cast("string").alias("source_id"), "data")
    return _last(files.mapInArrow(lambda batches: _told_rows(walk._run(batches, ("flv",), columns=TOLD, kinds=("script",))), "source_id string, offset long, n int, key string, number double, text string"))


def _values(bodies: pa.Array) -> pa.Array:
    """The values of each script tag; of one that is cut, and of null, none."""
    counts, found = [0], []
    for body in bodies.to_pylist():
        try:
            if body is not None:
                _, place = amf_values(body, 0)  # the event's name
                found += amf_values(body, place)[0]
        except _Cut:
            pass
        counts.append(len(found))
    kinds = (pa.string(), pa.float64(), pa.string())
    items = pa.StructArray.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["key", "number", "text"])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items)


def _told_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of script tags as rows, each with its tag's place and its own place in the tag."""
    for batch in batches:
        values = _values(batch.column("body"))
        ends = np.asarray(values.offsets)
        tags = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        places = [batch.column(k).take(pa.array(tags)) for k in ("source_id", "offset")]
        yield pa.RecordBatch.from_arrays([*places, pa.array((np.arange(len(tags)) - ends[tags]).astype(np.int32)), *values.values.flatten()], names=["source_id", "offset", "n", "key", "number", "text"])


def told(body: Column) -> Column:
    """array<struct<key, number, text>> of the values of script tags, in their order, to be exploded."""
    return F.arrow_udf(_values, "array<struct<key:string,number:double,text:string>>", F.ArrowUDFType.SCALAR)(body)


def values_of(rows: DataFrame) -> DataFrame:
    """The values of the script tags in rows of :func:`tracklake.sources.walk.files`."""
    tags = rows.where("format = 'flv' and what = 'tag' and kind = 'script'").select("source_id", "offset", "body")
    return _last(tags.select("source_id", "offset", F.posexplode(told(F.col("body"))).alias("n", "v")).select("source_id", "offset", "n", "v.*"))


def _last(found: DataFrame) -> DataFrame:
    """Of the values of a key the last, by tag and place in it."""
    last = found.groupBy("source_id", "key").agg(F.max_by(F.struct("number", "text"), F.struct("offset", "n")).alias("v"))
    return last.select("source_id", "key", F.col("v.number").alias("number"), F.col("v.text").alias("text"))


def _mp3(payload: Column) -> Column:
    """struct<rate, channels> of an MP3 frame header at the start of a packet, or one byte later."""

    def at(place: int) -> Column:
        h = B.uint_be(payload, place, 4)
        index, version = F.shiftright(h, 10).bitwiseAND(3), F.shiftright(h, 19).bitwiseAND(3)
        rates = {v: F.array(*[F.lit(x) for x in r]) for v, r in SAMPLING.items()}
        rate = F.when(version == 3, F.get(rates[3], index.cast("int"))).when(version == 2, F.get(rates[2], index.cast("int"))).when(version == 0, F.get(rates[0], index.cast("int")))
        good = (F.shiftright(h, 21) == 0x7FF) & (F.shiftright(h, 17).bitwiseAND(3) == 1) & F.shiftright(h, 12).bitwiseAND(15).between(1, len(RATES_1) - 1)
        return F.when(good & rate.isNotNull(), F.struct(rate.cast("long").alias("rate"), F.when(F.shiftright(h, 6).bitwiseAND(3) == 3, 1).otherwise(2).cast("long").alias("channels")))

    return F.coalesce(at(0), at(1))


def audio_streams(sources: DataFrame) -> DataFrame:
    """(source_id, sound_format, codec, rate, channels, scale) of the sound of FLV files.

    Formats 2 and 14 are MP3, by its first frame; 7 and 8 are G.711, always 8,000 a second and mono; all others AAC, by its configuration. Where neither tells,
    script values do (``audiosamplerate``, ``stereo``, ``audiochannels``); ``scale`` is the time base.
    """
    return sound_of(walk.files(sources, ("flv",), columns=(*TOLD, "number", "config"), kinds=("audio", "script")))


def sound_of(rows: DataFrame) -> DataFrame:
    """:func:`audio_streams` by rows of :func:`tracklake.sources.walk.files`, which are gone through once: tags of sound and values of scripts meet in one exchange."""
    heard, at = F.col("kind") == "audio", F.when(F.col("kind") == "audio", F.col("offset"))
    tags = rows.where("format = 'flv' and what = 'tag' and kind in ('audio', 'script')")
    each = tags.select("source_id", "kind", "offset", "number", "config", F.when(heard, F.col("body")).alias("body"), F.posexplode_outer(told(F.when(~heard, F.col("body")))).alias("n", "v"))
    last = each.groupBy("source_id", F.col("v.key").alias("key")).agg(
        F.max(heard).alias("heard"), F.min_by(F.col("number").cast("int"), at).alias("sound_format"), F.min_by("body", F.when(F.col("config"), at)).alias("asc"), F.min_by("body", F.when(~F.col("config"), at)).alias("mp3"),
        F.max_by(F.struct("v.number", "v.text"), F.when(~heard, F.struct("offset", "n"))).alias("v"),
    )
    value = lambda k: F.max(F.when(F.lower(F.regexp_replace(F.col("key"), "_", "")) == k, F.coalesce("v.number", F.col("v.text").try_cast("double"))))
    one = lambda c: F.first(c, ignorenulls=True).alias(c)  # noqa: E731  only rows without a key have sound
    known = last.groupBy("source_id").agg(F.max("heard").alias("heard"), one("sound_format"), one("asc"), one("mp3"), value("audiosamplerate").alias("r"), value("stereo").alias("s"), value("audiochannels").alias("c"))
    known = known.where("heard").withColumns({"asc": audio_config(F.col("asc")), "mp3": _mp3(F.col("mp3"))})
    fmt = F.col("sound_format")
    told_rate = F.when(F.col("r") > 0, F.col("r").cast("long"))
    told_channels = F.when(F.col("r") > 0, F.when(F.col("s").isNotNull(), F.when(F.col("s") != 0, 2).otherwise(1)).otherwise(F.coalesce("c", F.lit(1)))).cast("long")
    asc = F.when((F.col("asc.rate") > 0) & (F.col("asc.channels") > 0), F.col("asc"))
    pick = lambda mp3, aac, told, law: F.when(fmt.isin(7, 8), law).when(fmt.isin(2, 14), F.coalesce(mp3, told)).otherwise(F.coalesce(aac.cast("long"), told))
    codec = F.when(fmt.isin(2, 14), "mp3").when(fmt.isin(7, 8), "g711").otherwise("aac")
    return known.select(
        "source_id", "sound_format", codec.alias("codec"), pick(F.col("mp3.rate"), asc["rate"], told_rate, F.lit(8000)).alias("rate"),
        pick(F.col("mp3.channels"), asc["channels"], told_channels, F.lit(1)).alias("channels"), F.when(fmt.isin(7, 8), 8000).otherwise(1000).alias("scale"),
    )
