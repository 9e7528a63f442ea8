"""MP4 in and out: what sample entries and headers say of tracks, and files made of tracks and their samples.

Files are put together natively. Sample tables are run lengths and ordered lists per track; a track's box has the same length wherever its payload will
lie, so lengths are known before offsets, and one window per file turns them into places.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import bits
from tracklake.functions import bytesql as B
from tracklake.functions import writers as W
from tracklake.operators import timeline as T

from .audio import audio_config

VIDEO_SCALE, AUDIO_RATE = 90_000, 48_000


def _hevc_sets(configs: pa.Array) -> pa.Array:
    """The first sequence parameter set of HEVC configurations."""
    out = []
    for config in configs:
        data, found, at = config.as_py() or b"", None, 23
        for _ in range(data[22] if len(data) > 23 else 0):
            kind, count = data[at] & 63 if at < len(data) else 0, int.from_bytes(data[at + 1 : at + 3], "big")
            at += 3
            for _ in range(count):
                size = int.from_bytes(data[at : at + 2], "big")
                if kind == 33 and found is None and at + 2 + size <= len(data):
                    found = data[at + 2 : at + 2 + size]
                at += 2 + size
        out.append(found)
    return pa.array(out, pa.binary())


def _child(body: Column, at: int) -> tuple[Column, Column]:
    """(name, content) of the box at a place."""
    size = B.uint_be(body, at, 4)
    return F.when(size >= 8, B.part(body, at + 4, 4)), F.substring(body, at + 9, F.greatest(F.lit(0), size - 8).cast("int"))


def with_video(rows: DataFrame) -> DataFrame:
    """Adds what the first sample entry in ``stsd`` says of pictures: (v, width, height, profile, level, frame_rate, config), null for other entries.

    The sizes are those of the sequence parameter set where there is one, else those of the entry.
    """
    name, content = _child(F.col("stsd"), 94)
    entry = W.text_at(F.col("stsd"), 12, 4)
    rows = rows.withColumn("v", F.when((B.uint_be(F.col("stsd"), 4, 4) > 0) & entry.isin("avc1", "avc3", "hvc1", "hev1", "mp4v", "vp09", "av01"), entry))
    body = F.when(F.col("v").isNotNull(), F.col("stsd"))
    rows = rows.withColumns({"_w": B.uint_be(body, 40, 2), "_h": B.uint_be(body, 42, 2), "_box": F.when(F.col("v").isNotNull(), name), "_config": content})
    config, avc, hevc = F.col("_config"), F.col("_box") == F.lit(b"avcC"), F.col("_box") == F.lit(b"hvcC")
    first = F.when((F.length(config) > 8) & (B.uint_be(config, 5, 1).bitwiseAND(31) > 0), F.substring(config, 9, B.uint_be(config, 6, 2).cast("int")))
    rows = rows.withColumns({"_avc": bits.header(F.when(avc, first), "h264_sps"), "_set": F.arrow_udf(_hevc_sets, "binary", F.ArrowUDFType.SCALAR)(F.when(hevc, config))})
    rows = rows.withColumn("_hevc", bits.header(F.col("_set"), "h265_sps"))
    told = lambda a, h: F.coalesce(F.col("_avc")[a], F.col("_hevc")[h])
    rate = F.coalesce(bits.frame_rate(F.col("_avc")), bits.frame_rate(F.col("_hevc"), "h265"))
    rows = rows.withColumns({
        "width": F.coalesce(told("width", "width"), F.col("_w")), "height": F.coalesce(told("height", "height"), F.col("_h")), "profile": told("profile_idc", "general_profile_idc"),
        "level": told("level_idc", "general_level_idc"), "frame_rate": rate, "config": F.when(avc | hevc, config),
    })
    return rows.drop("_w", "_h", "_box", "_config", "_avc", "_set", "_hevc")


def video_entries(boxes: DataFrame) -> DataFrame:
    """(source_id, track, entry, width, height, profile, level, frame_rate, config) of the first sample entry of picture tracks."""
    rows = with_video(boxes.where("name = 'stsd'").select("source_id", "track", F.col("body").alias("stsd"))).where("v is not null")
    return rows.select("source_id", "track", F.col("v").alias("entry"), "width", "height", "profile", "level", "frame_rate", "config")


def decoder_config(esds: Column) -> Column:
    """The decoder's own bytes in an elementary stream descriptor: the content of the first well-formed descriptor with tag 5."""
    byte = lambda at: F.conv(F.hex(F.substring(esds, at + 1, F.lit(1))), 16, 10).cast("int")
    low = lambda at: byte(at).bitwiseAND(127)
    more = lambda at: byte(at) >= 128

    def head(at: Column) -> Column:
        """struct<n: bytes of the length, size> at the byte after a tag."""
        one, two = low(at), F.shiftleft(low(at), 7) + low(at + 1)
        three = F.shiftleft(two, 7) + low(at + 2)
        four = F.shiftleft(three, 7) + low(at + 3)
        n = F.when(~more(at), 1).when(~more(at + 1), 2).when(~more(at + 2), 3).when(~more(at + 3), 4)
        return F.struct(n.alias("n"), F.when(n == 1, one).when(n == 2, two).when(n == 3, three).otherwise(four).alias("size"))

    places = F.when(F.length(esds) > 2, F.sequence(F.lit(0), F.length(esds) - 3)).otherwise(F.array().cast("array<int>"))
    heads = F.transform(F.filter(places, lambda at: byte(at) == 5), lambda at: F.struct(at.alias("at"), head(at + 1).alias("h")))
    good = F.filter(heads, lambda x: (x["h"]["size"] >= 2) & (x["at"] + 1 + x["h"]["n"] + x["h"]["size"] <= F.length(esds)))
    first = F.get(good, F.lit(0))
    return F.when(first.isNotNull(), F.substring(esds, first["at"] + 2 + first["h"]["n"], first["h"]["size"]))


def with_audio(rows: DataFrame) -> DataFrame:
    """Adds what the first sample entry in ``stsd`` says of sound: (a, rate, channels, bits, object_type, asc), null for other entries; the decoder's configuration goes
    before the entry's own numbers."""
    name, content = _child(F.col("stsd"), 44)
    entry = W.text_at(F.col("stsd"), 12, 4)
    rows = rows.withColumn("a", F.when((B.uint_be(F.col("stsd"), 4, 4) > 0) & entry.isin("mp4a", "alac", "fLaC", "Opus", "ac-3", "ec-3", "sowt", "twos", "ulaw", "alaw", ".mp3"), entry))
    body = F.when(F.col("a").isNotNull(), F.col("stsd"))
    rows = rows.withColumn("asc", F.when(F.col("a").isNotNull() & (name == F.lit(b"esds")), decoder_config(content)))
    rows = rows.withColumn("_asc", audio_config(F.col("asc")))
    rate = F.coalesce(F.col("_asc.rate").cast("long"), F.shiftright(B.uint_be(body, 40, 4), 16))
    channels = F.coalesce(F.col("_asc.channels").cast("long"), B.uint_be(body, 32, 2))
    return rows.withColumns({"rate": rate, "channels": channels, "bits": B.uint_be(body, 34, 2), "object_type": F.col("_asc.object_type")}).drop("_asc")


def audio_entries(boxes: DataFrame) -> DataFrame:
    """(source_id, track, entry, rate, channels, bits, object_type, config) of the first sample entry of sound tracks."""
    rows = with_audio(boxes.where("name = 'stsd'").select("source_id", "track", F.col("body").alias("stsd"))).where("a is not null")
    return rows.select("source_id", "track", F.col("a").alias("entry"), "rate", "channels", "bits", "object_type", F.col("asc").alias("config"))


def track_headers(boxes: DataFrame) -> DataFrame:
    """One row for each track of pictures or sound, with all that its header boxes say: (source_id, track, kind, track_id, timescale, duration), and what
    :func:`with_video` and :func:`with_audio` add. One exchange brings the boxes of a track together."""
    names = ["hdlr", "mdhd", "tkhd", "stsd"]
    pick = [F.min_by("body", F.when(F.col("name") == n, F.col("offset"))).alias(n) for n in names]
    rows = boxes.where(F.col("name").isin(*names)).groupBy("source_id", "track").agg(*pick)
    kind = F.when(B.is_bytes(F.col("hdlr"), 8, b"vide"), "video").when(B.is_bytes(F.col("hdlr"), 8, b"soun"), "audio")
    rows = rows.withColumn("kind", kind).where("kind is not null and mdhd is not null")
    wide = lambda name: B.uint_be(F.col(name), 0, 1) == 1
    either = lambda name, wide_at, at, size=4: F.when(wide(name), B.uint_be(F.col(name), wide_at, size)).otherwise(B.uint_be(F.col(name), at, 4))
    rows = rows.withColumns({"timescale": either("mdhd", 20, 12), "duration": either("mdhd", 25, 16, 7), "track_id": either("tkhd", 20, 12)})
    return with_audio(with_video(rows)).drop(*names)


def track_ids(boxes: DataFrame) -> DataFrame:
    """(source_id, track, track_id): the number that each track's header gives it."""
    body = F.col("body")
    number = F.when(B.uint_be(body, 0, 1) == 1, B.uint_be(body, 20, 4)).otherwise(B.uint_be(body, 12, 4))
    return boxes.where("name = 'tkhd'").select("source_id", "track", number.alias("track_id"))


def movie_summary(boxes: DataFrame) -> DataFrame:
    """(source_id, duration_ms, n_tracks, n_video, n_audio) of movies; files without a track or a duration have no row."""
    body = F.col("body")
    wide = B.uint_be(body, 0, 1) == 1
    scale = F.when(wide, B.uint_be(body, 20, 4)).otherwise(B.uint_be(body, 12, 4))
    length = F.when(wide, B.uint_be(body, 25, 7)).otherwise(B.uint_be(body, 16, 4))
    ms = F.when((F.col("name") == "mvhd") & (scale > 0), length * 1000 / scale)
    handler = lambda n: F.count(F.when((F.col("name") == "hdlr") & B.is_bytes(body, 8, n), 1))
    out = boxes.groupBy("source_id").agg(F.coalesce(F.max(ms), F.lit(0.0)).alias("duration_ms"), F.count(F.when(F.col("name") == "trak", 1)).alias("n_tracks"), handler(b"vide").alias("n_video"), handler(b"soun").alias("n_audio"))
    return out.where("n_tracks > 0 or duration_ms > 0")


# --- configurations

def avc_config(sps: Column, pps: Column) -> Column:
    """The decoder configuration of one sequence and one picture parameter set, with lengths of four bytes."""
    head = F.concat(F.lit(b"\x01"), F.substring(sps, 2, 3), F.lit(b"\xff\xe1"))
    return F.when(sps.isNotNull() & pps.isNotNull() & (F.length(sps) >= 4), F.concat(head, W.be(F.length(sps), 2), sps, F.lit(b"\x01"), W.be(F.length(pps), 2), pps))


def inferred_config(codec: Column, stated: Column, sps: Column, pps: Column, packet: Column, script: Column, rate: Column, channels: Column) -> Column:
    """The configuration of a track: what is stated, else for H.264 its first parameter sets, else for AAC an ADTS header, a script's, or one of rate and channels."""
    from .audio import asc_of_adts

    built = F.unhex(B.audio_specific_config(F.lit(2), rate, channels))
    own = F.when(F.length(stated) > 0, stated)
    return F.coalesce(own, F.when(codec == "h264", avc_config(sps, pps)).when(codec == "aac", F.coalesce(asc_of_adts(packet), script, built)))


def mux_problem() -> Column:
    """Why a track (kind, codec, config, rate, channels) can't go into a file as it is; null if it can."""
    has, codec = F.coalesce(F.length("config") > 0, F.lit(False)), F.col("codec")
    mp3 = (codec == "mp3") & (F.coalesce("rate", F.lit(0)) > 0) & (F.coalesce("channels", F.lit(0)) > 0)
    return (
        F.when((F.col("kind") == "video") & ((codec != "h264") | ~has), F.concat_ws("", F.lit("video of "), codec, F.lit(" has no configuration that a file can hold")))
        .when((F.col("kind") == "audio") & (codec == "g711"), F.lit("G.711 sound must be encoded as AAC first"))
        .when((F.col("kind") == "audio") & ~has & ~mp3, F.concat_ws("", F.lit("audio of "), codec, F.lit(" has no configuration")))
        .when(~F.col("kind").isin("video", "audio"), F.lit("neither pictures nor sound"))
    )


def mux_errors(tracks: DataFrame) -> DataFrame:
    """(source_id, severity, code, message) of the tracks that :func:`mux_problem` finds."""
    return T.diagnostics(tracks.withColumn("_m", mux_problem()).where("_m is not null"), "mux.unsupported", "error", F.col("_m"), F.col("track_id"))


# --- boxes

def box(name: bytes, *parts: Column) -> Column:
    """A box around its parts, each written once."""
    whole = F.transform(F.array(F.concat(F.lit(b""), *parts)), lambda body: F.concat(W.be(F.length(body) + 8, 4), F.lit(name), body))
    return F.get(whole, F.lit(0))


def full_box(name: bytes, version: int, flags: int | Column, *parts: Column) -> Column:
    flags = F.lit(flags) if isinstance(flags, int) else flags
    return box(name, F.lit(bytes([version])), W.be(flags, 3), *parts)


def descriptor(tag: int, body: Column) -> Column:
    """A descriptor of at most 16,383 bytes: tag, length in groups of seven bits, content."""
    n = F.length(body)
    size = F.when(n < 128, W.be(n, 1)).otherwise(F.concat(W.be(F.shiftright(n, 7) + 128, 1), W.be(n.bitwiseAND(127), 1)))
    return F.concat(F.lit(bytes([tag])), size, body)


_MATRIX = b"".join(x.to_bytes(4, "big") for x in (0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000))
FTYP = b"\0\0\0\x20ftypisom\0\0\0\0isomiso2avc1mp41"
DINF = b"\0\0\0\x24dinf\0\0\0\x1cdref\0\0\0\0\0\0\0\1\0\0\0\x0curl \0\0\0\1"


def _entry(kind: Column) -> Column:
    """The sample description of a track of columns width, height, rate, channels, codec and config."""
    col = F.col
    picture = box(b"avc1", F.lit(bytes(6) + b"\0\1" + bytes(16)), W.be(F.greatest(F.lit(1), F.coalesce("width", F.lit(1))), 2), W.be(F.greatest(F.lit(1), F.coalesce("height", F.lit(1))), 2), F.lit(b"\0\x48\0\0\0\x48\0\0" + bytes(4) + b"\0\1" + bytes(32) + b"\0\x18\xff\xff"), box(b"avcC", F.coalesce("config", F.lit(b""))))
    mp3 = col("codec") == "mp3"
    specific = descriptor(5, F.when(mp3, F.lit(b"")).otherwise(F.coalesce("config", F.lit(b""))))
    decoder = descriptor(4, F.concat(F.when(mp3, F.lit(b"\x6b")).otherwise(F.lit(b"\x40")), F.lit(b"\x15" + bytes(11)), specific))
    esds = full_box(b"esds", 0, 0, descriptor(3, F.concat(F.lit(bytes(3)), decoder, F.lit(b"\6\1\2"))))
    sound = box(b"mp4a", F.lit(bytes(6) + b"\0\1" + bytes(8)), W.be(F.greatest(F.lit(1), F.coalesce("channels", F.lit(2))), 2), F.lit(b"\0\x10" + bytes(4)), W.be(F.shiftleft(F.coalesce("rate", F.lit(AUDIO_RATE)).cast("long"), 16), 4), esds)
    return full_box(b"stsd", 0, 0, F.lit(b"\0\0\0\1"), F.when(kind == "video", picture).otherwise(sound))


def _track_box(places: Column, movie_ticks: Column) -> Column:
    """A track's box; ``places`` are the offsets of its chunks, in four bytes each or, where ``wide``, eight."""
    video, col = F.col("kind") == "video", F.col
    side = lambda name: F.when(video, W.be(F.shiftleft(F.coalesce(name, F.lit(0)).cast("long"), 16), 4)).otherwise(F.lit(bytes(4)))
    head = full_box(b"tkhd", 0, F.when(video, 3).otherwise(1), F.lit(bytes(8)), W.be(col("number"), 4), F.lit(bytes(4)), W.be(movie_ticks, 4), F.lit(bytes(12)), F.when(video, F.lit(bytes(4))).otherwise(F.lit(b"\1\0\0\0")), F.lit(_MATRIX), side("width"), side("height"))
    media = full_box(b"mdhd", 0, 0, F.lit(bytes(8)), W.be(col("scale"), 4), W.be(col("ticks"), 4), F.lit(b"\x55\xc4\0\0"))
    handler = full_box(b"hdlr", 0, 0, F.lit(bytes(4)), F.when(video, F.lit(b"vide")).otherwise(F.lit(b"soun")), F.lit(bytes(12)), F.when(video, F.lit(b"VideoHandler\0")).otherwise(F.lit(b"SoundHandler\0")))
    counted = lambda name, n, table: full_box(name, 0, 0, W.be(col(n), 4), F.coalesce(table, F.lit(b"")))
    tables = [
        _entry(col("kind")), counted(b"stts", "n_deltas", "deltas"), F.when(col("shifted"), full_box(b"ctts", 1, 0, W.be(col("n_shifts"), 4), col("shifts"))).otherwise(F.lit(b"")),
        counted(b"stsc", "n_spread", F.col("spread")), full_box(b"stsz", 0, 0, F.lit(bytes(4)), W.be(col("n_samples"), 4), col("sizes")),
        F.when(col("wide"), counted(b"co64", "n_chunks", places)).otherwise(counted(b"stco", "n_chunks", places)), F.when(video & (col("n_keys") > 0) & (col("n_keys") < col("n_samples")), counted(b"stss", "n_keys", "keys")).otherwise(F.lit(b"")),
    ]
    info = box(b"minf", F.when(video, full_box(b"vmhd", 0, 1, F.lit(bytes(8)))).otherwise(full_box(b"smhd", 0, 0, F.lit(bytes(4)))), F.lit(DINF), box(b"stbl", *tables))
    return box(b"trak", head, box(b"mdia", media, handler, info))


#: What files of 32-bit places can hold.
MOST_PLACE = (1 << 32) - 1


def _timed(samples: DataFrame, tracks: DataFrame, chunk_us: int | None) -> DataFrame:
    """Samples in decode order with their number, delta and shift in ticks, chunk, and where that starts; one exchange by track serves all windows."""
    at = ["file_id", "track_id"]
    w = Window.partitionBy(*at).orderBy("dts_us", "index")
    rows = samples.where(F.length("data") > 0).join(tracks.select(*at, F.struct(*tracks.columns).alias("_track"), "scale"), at)
    tick = lambda us: F.floor(W.ticks(us, F.col("scale")) + 0.5).cast("long")
    rows = rows.withColumns({"t": tick(F.col("dts_us")), "p": tick(F.col("pts_us")), "n": F.row_number().over(w), "first_us": F.min("dts_us").over(w)})
    rows = rows.withColumns({"gap": F.lead("t").over(w) - F.col("t"), "back": F.col("t") - F.lag("t").over(w)})
    own = F.when(F.col("duration_us") > 0, tick(F.col("duration_us")))
    rows = rows.withColumns({"delta": F.greatest(F.lit(1).cast("long"), F.coalesce("gap", own, "back", F.lit(1))), "shift": F.col("p") - F.col("t")})
    chunk = F.floor((F.col("dts_us") - F.col("first_us")) / chunk_us) if chunk_us else F.lit(0)
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("chunk", chunk.cast("long")).withColumns({"new_delta": changed("delta"), "new_shift": changed("shift"), "new_chunk": changed("chunk")})


def _runs(starts: str, value: str, count: Column) -> Column:
    """Run lengths as a table, by the sorted starts of runs (n, value)."""
    after = lambda i: F.coalesce(F.get(F.col(starts), i + 1)["n"], count + 1)
    return W.joined(F.transform(starts, lambda x, i: F.concat(W.be(after(i) - x["n"], 4), W.be(x[value], 4))))


def _tables(rows: DataFrame, payload: bool) -> DataFrame:
    """Tracks with the counts, sizes, key numbers, run lengths and chunks of their samples, by one aggregate; with their payload if that is asked for."""
    at = ["file_id", "track_id"]
    rows = rows.withColumns({"size4": W.be(F.length("data"), 4), "key4": F.when(F.col("is_key"), W.be(F.col("n"), 4))})
    starts = lambda new, *of: F.array_sort(F.collect_list(F.when(F.col(new), F.struct("n", *of))))
    end = F.max(F.col("pts_us") + F.coalesce("duration_us", F.lit(0))) - F.min("pts_us")
    out = rows.groupBy(*at).agg(
        F.count("*").alias("n_samples"), F.sum("delta").alias("ticks"), F.max(F.col("shift") != 0).alias("shifted"), F.count("key4").alias("n_keys"),
        W.joined_in_order("size4", "n").alias("sizes"), W.joined_in_order("key4", "n").alias("keys"), *[W.joined_in_order("data", "n").alias("payload")] * payload,
        F.greatest(F.lit(1).cast("long"), end).alias("duration_us"), F.sum(F.length("data").cast("long")).alias("n_bytes"),
        F.first("_track").alias("_track"), starts("new_delta", "delta").alias("_d"), starts("new_shift", "shift").alias("_s"), starts("new_chunk", "dts_us").alias("_c"),
    )
    count = F.col("n_samples")
    out = out.withColumns({"n_deltas": F.size("_d"), "deltas": _runs("_d", "delta", count), "n_shifts": F.size("_s"), "shifts": _runs("_s", "shift", count), "n_chunks": F.size("_c")})
    # samples of each chunk, and of those the changes
    held = F.transform("_c", lambda x, i: (F.coalesce(F.get(F.col("_c"), i + 1)["n"], count + 1) - x["n"]).cast("long"))
    out = out.withColumn("_h", held)
    changes = F.filter(F.transform("_h", lambda x, i: F.when((i == 0) | (x != F.get(F.col("_h"), i - 1)), F.struct((i + 1).alias("at"), x.alias("n")))), lambda x: x.isNotNull())
    out = out.withColumn("_h", changes).withColumns({"n_spread": F.size("_h"), "spread": W.joined(F.transform("_h", lambda x: F.concat(W.be(x["at"], 4), W.be(x["n"], 4), F.lit(b"\0\0\0\1"))))})
    return out.select("_track.*", *[c for c in out.columns if c not in ("_d", "_s", "_h", "_track", *at)])


def _scaled(tracks: DataFrame) -> DataFrame:
    scale = F.when(F.col("kind") == "video", VIDEO_SCALE).otherwise(F.greatest(F.lit(1), F.coalesce("rate", F.lit(AUDIO_RATE)))).cast("long")
    return tracks.withColumn("scale", scale)


def _numbered(full: DataFrame) -> DataFrame:
    """Tracks numbered in their file, with the length of their box, where the media data starts and whether places need 64 bits; lengths don't depend on places."""
    files = Window.partitionBy("file_id").orderBy(F.desc("kind"), "track_id")
    whole = files.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = full.withColumns({"number": F.row_number().over(files), "movie": F.max("scale").over(whole), "_all": F.sum("n_bytes").over(whole)})
    full = full.withColumns({"movie_ticks": F.greatest(F.lit(1).cast("long"), F.floor(F.col("ticks") * F.col("movie") / F.col("scale") + 0.5)), "wide": F.col("_all") > MOST_PLACE - (1 << 28)})
    room = F.unhex(F.repeat(F.lit("00"), F.col("n_chunks") * F.when(F.col("wide"), 8).otherwise(4)))
    full = full.withColumn("box_size", F.length(_track_box(room, F.col("movie_ticks"))))
    return full.withColumn("start", len(FTYP) + 8 + 108 + F.sum("box_size").over(whole) + F.when(F.col("wide"), 16).otherwise(8))


def _heads(placed: DataFrame, *more: Column) -> DataFrame:
    """(file_id, head, duration_us, n_video, n_audio): all that stands before the media data, by tracks with the ``places`` of their chunks."""
    kinds = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n_samples")).otherwise(0)).alias(f"n_{k}")
    out = placed.withColumn("trak", _track_box(F.col("places"), F.col("movie_ticks"))).groupBy("file_id").agg(
        F.max("movie").alias("movie"), F.max("movie_ticks").alias("movie_ticks"), F.count("*").alias("n"), F.max("wide").alias("wide"), F.max("_all").alias("bytes"),
        W.joined_in_order("trak", "number").alias("traks"), F.max("duration_us").alias("duration_us"), kinds("video"), kinds("audio"), *more,
    )
    head = full_box(b"mvhd", 0, 0, F.lit(bytes(8)), W.be(F.col("movie"), 4), W.be(F.col("movie_ticks"), 4), F.lit(b"\0\1\0\0\1\0" + bytes(10) + _MATRIX + bytes(24)), W.be(F.col("n") + 1, 4))
    media = F.when(F.col("wide"), F.concat(F.lit(b"\0\0\0\1mdat"), W.be(F.col("bytes") + 16, 8))).otherwise(F.concat(W.be(F.col("bytes") + 8, 4), F.lit(b"mdat")))
    return out.withColumn("head", F.concat(F.lit(FTYP), box(b"moov", head, F.col("traks")), media)).drop("movie", "movie_ticks", "n", "wide", "bytes", "traks")


def mux(samples: DataFrame, tracks: DataFrame) -> DataFrame:
    """(file_id, data, duration_us, n_video, n_audio): an MP4 file for each ``file_id``.

    ``samples`` are (file_id, track_id, index, pts_us, dts_us, duration_us, is_key, data), ``tracks`` (file_id, track_id, kind, codec, config, width, height,
    rate, channels). Samples go in decode order; each lasts until the next one, the last its own duration or as long as the one before it, at least one
    tick. Presentation times that differ from decode times are written as offsets. Pictures count 90,000 ticks a second, sound its rate. All tracks
    start together, each in one chunk. A file is one binary, so what one task holds is bounded by the file; :func:`segments` makes files that no cell holds.
    """
    tracks = _scaled(tracks)
    full = _numbered(_tables(_timed(samples, tracks, None), payload=True))
    before = F.coalesce(F.sum("n_bytes").over(Window.partitionBy("file_id").orderBy(F.desc("kind"), "track_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("start") + before
    out = _heads(full.withColumn("places", F.when(F.col("wide"), W.be(at, 8)).otherwise(W.be(at, 4))), W.joined_in_order("payload", "number").alias("payload"))
    return out.select("file_id", F.concat("head", "payload").alias("data"), "duration_us", "n_video", "n_audio")


def segments(samples: DataFrame, tracks: DataFrame, chunk_us: int = 500_000) -> DataFrame:
    """(file_id, start_us, number, n, data): movies as the pieces that follow one another in their files, in the order of those columns.

    As :func:`mux`, but the tracks are interleaved in chunks of ``chunk_us``, and a piece is a sample, or (first, with null time) all that stands before them: what a task holds
    of a movie is its sample tables. Files whose places need more than 32 bits get ``co64``.
    """
    tracks, at = _scaled(tracks), ["file_id", "track_id"]
    rows = _timed(samples, tracks, chunk_us)
    full = _numbered(_tables(rows, payload=False))
    # chunks of all tracks of a file in the order of their first times, then of the tracks
    chunks = full.select("file_id", "number", F.posexplode("_c").alias("k", "c"), "n_samples").select("file_id", "number", "k", F.col("c.n").alias("n"), F.col("c.dts_us").alias("start_us"))
    sized = rows.withColumn("first_n", F.max(F.when(F.col("new_chunk"), F.col("n"))).over(Window.partitionBy(*at).orderBy("n"))).groupBy(*at, "first_n").agg(F.sum(F.length("data").cast("long")).alias("bytes"))
    sized = sized.join(full.select(*at, "number"), at)
    chunks = chunks.join(sized.select("file_id", "number", F.col("first_n").alias("n"), "bytes"), ["file_id", "number", "n"])
    before = Window.partitionBy("file_id").orderBy("start_us", "number", "k").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("place", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    listed = chunks.groupBy("file_id", "number").agg(F.array_sort(F.collect_list(F.struct("k", "place"))).alias("_p"))
    placed = full.join(listed, ["file_id", "number"])
    place = lambda size: W.joined(F.transform("_p", lambda x: W.be(x["place"] + F.col("start"), size)))
    heads = _heads(placed.withColumn("places", F.when(F.col("wide"), place(8)).otherwise(place(4))))
    heads = heads.select("file_id", F.lit(None).cast("long").alias("start_us"), F.lit(0).alias("number"), F.lit(0).alias("n"), F.col("head").alias("data"))
    start = F.last(F.when(F.col("new_chunk"), F.col("dts_us")), ignorenulls=True).over(Window.partitionBy(*at).orderBy("n"))
    pieces = rows.withColumn("start_us", start).join(full.select(*at, "number"), at)
    return heads.unionByName(pieces.select("file_id", "start_us", "number", "n", "data"))
