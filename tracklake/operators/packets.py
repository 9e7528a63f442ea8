"""Tracks in one form for all containers, and encoded packets made of their samples.

Samples are rows (source_id, track_id, sample_id, index, pts_us, dts_us, duration_us, is_key, data, ...); tracks have a kind, a codec family and the
container they came in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import bitstream as N
from tracklake.functions import bytesql as B
from tracklake.functions import pcm as P
from tracklake.functions import writers as W
from tracklake.operators import selection as S
from tracklake.operators import timeline as T


def normalised(streams: DataFrame, *keep: str) -> DataFrame:
    """Tracks of streams (source_id, format, kind, source_track, index, codec, family, config, duration_ms, rate, channels, width, height, fps, ...).

    The id joins format, kind and the container's own number; times are microseconds; sizes and rates that are not above 0 are null. ``keep`` names columns
    that stay as they are.
    """
    above = lambda c: W.positive(F.col(c)).alias(c)
    codec = F.coalesce("codec", F.lit("Unknown"))
    return streams.select(
        "source_id", F.concat_ws(":", "format", "kind", F.coalesce(F.col("source_track").cast("string"), F.col("index").cast("string"))).alias("track_id"), "index", "kind", "format",
        codec.alias("codec"), N.codec_family(F.coalesce("family", F.lit("unknown")), codec).alias("family"), "config",
        F.when(F.col("duration_ms").isNotNull(), W.micros(F.col("duration_ms"))).alias("duration_us"), above("rate"), above("channels"), above("width"), above("height"), above("fps"), *keep,
    )


def container_duration(stated: Column, scale: Column, last_ms: Column) -> Column:
    """How long a container says it is, else until its last time stamp; microseconds."""
    told = F.when(W.is_finite(stated) & (stated >= 0) & W.is_finite(scale) & (scale > 0), F.floor(stated / F.when(scale > 0, scale) * 1_000_000 + 0.5))
    return F.coalesce(told, F.when(W.is_finite(last_ms) & (last_ms >= 0), F.floor(last_ms * 1000 + 0.5))).cast("long")


def decoder_config(kind: Column, family: Column, config: Column, law: Column) -> Column:
    """The codec string that a decoder is asked for; null where there is none or its configuration is too short."""
    aac = F.when(F.length(config) >= 2, F.concat(F.lit("mp4a.40."), F.shiftright(B.uint_be(config, 0, 1), 3).cast("string")))
    avc = F.when(F.length(config) >= 5, B.avc_codec_string(config))
    g711 = F.when(law == "alaw", "alaw").otherwise("ulaw")
    return F.when((kind == "video") & (family == "h264"), avc).when((kind == "audio") & (family == "aac"), aac).when((kind == "audio") & (family == "g711"), g711)


def adapted(data: Column, have: Column, want: Column) -> Column:
    """A packet in the layout that a decoder wants: AVC lengths to start codes and back, all else as it is."""
    to_codes, to_lengths = N.annexb_of_lengths(data), F.coalesce(N.length_prefixed(N.annexb_nals(data, strip_zeros=False)), data)
    return F.when((have == "avcc") & (want == "annexb"), to_codes).when((have == "annexb") & (want == "avcc"), to_lengths).otherwise(data)


def encoded_packets(samples: DataFrame, tracks: DataFrame) -> DataFrame:
    """Packets (packet_id, sample_id, track_id, family, layout, data, pts_us, dts_us, duration_us, is_key) of the samples that have bytes.

    ``tracks`` (track_id, kind, family, format) has one row for each track and is joined by its size. Sound in raw AAC loses its ADTS headers.
    """
    rows = samples.where(F.length("data") > 0).drop("kind", "family", "format").join(tracks.select("track_id", "kind", "family", "format"), "track_id")
    layout = N.bitstream_format(F.col("kind"), F.col("format"), F.col("family"))
    data = F.when(layout == "aac_raw", N.without_adts(F.col("data"))).otherwise(F.col("data"))
    return rows.select(F.concat("sample_id", F.lit(":packet")).alias("packet_id"), "sample_id", "track_id", "family", layout.alias("layout"), data.alias("data"), "pts_us", "dts_us", "duration_us", "is_key")


def feed_order() -> list[Column]:
    """The order in which packets go to a decoder: decode time, presentation time, id by its bytes."""
    return [F.col("dts_us"), F.col("pts_us"), F.col("packet_id")]


def presentation_order() -> list[Column]:
    """The order of packets of sound: presentation time, then the sample's id by its bytes."""
    return [F.col("pts_us"), F.col("sample_id")]


def encoded_tracks(selected: DataFrame, samples: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets with their place ``n``, counts per track) of a selection; a track of which nothing is selected gives all its samples.

    The counts (track_id, n_samples, n_packets, n_missing) tell how many samples had no bytes.
    """
    some = selected.select("track_id").distinct()
    asked = selected.select("track_id", "sample_id").join(tracks.select("track_id"), "track_id", "left_semi")
    rest = samples.join(tracks.select("track_id"), "track_id", "left_semi").join(some, "track_id", "left_anti")
    rows = samples.join(asked, ["track_id", "sample_id"], "left_semi").unionByName(rest)
    packets = encoded_packets(rows, tracks).withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy(*feed_order())))
    has = (F.coalesce(F.length("data"), F.lit(0)) > 0).cast("long")
    counts = rows.groupBy("track_id").agg(F.count("*").alias("n_samples"), F.sum(has).alias("n_packets")).withColumn("n_missing", F.col("n_samples") - F.col("n_packets"))
    return packets, counts


@dataclass(frozen=True)
class Targets:
    """What a request for pictures asks for: the first that is given counts; times in microseconds after the track's first sample in decode order, ends inclusive."""

    sample_ids: tuple[str, ...] = ()
    positions: tuple[int, ...] = ()
    pts_us: tuple[int, ...] = ()
    start_index: int = 0
    end_index: int = -1
    start_us: int = 0
    end_us: int = -1
    frame_type: str = "all"
    limit: int = -1


def target_samples(samples: DataFrame, t: Targets) -> DataFrame:
    """``samples`` with ``is_target``; places are those in decode order."""
    w = Window.partitionBy("track_id").orderBy("dts_us", "index")
    rows = samples.withColumns({"position": F.row_number().over(w) - 1, "_first": F.first("pts_us").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    if t.sample_ids:
        hit = F.col("sample_id").isin(*t.sample_ids)
    elif t.positions:
        hit = F.col("position").isin(*t.positions)
    elif t.pts_us:
        hit = F.col("pts_us").isin(*t.pts_us)
    else:
        past = F.col("pts_us") - F.col("_first")
        hit = (F.col("position") >= max(0, t.start_index)) & (past >= t.start_us)
        if t.end_index >= 0:
            hit &= F.col("position") <= t.end_index
        if t.end_us >= 0:
            hit &= past <= t.end_us
        if t.frame_type == "key":
            hit &= F.col("is_key")
        if t.limit >= 0:
            count = F.sum(hit.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
            return rows.withColumn("is_target", hit & (count <= t.limit)).drop("_first")
    return rows.withColumn("is_target", hit).drop("_first")


def decode_request(samples: DataFrame, tracks: DataFrame, targets: Targets, most_packets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(packets to decode, diagnostics) for the targets of each track: all from the last key sample before a target to it.

    With ``most_packets`` only so many of a track are kept, the first in decode order, and a warning tells how many are not; a player that decodes at once takes 7,200.
    """
    return decode_marked(target_samples(samples, targets), tracks, most_packets)


def decode_marked(marked: DataFrame, tracks: DataFrame, most_packets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """As :func:`decode_request`, of samples whose ``is_target`` is known."""
    needed = T.gop_closure(marked)
    n = F.row_number().over(Window.partitionBy("track_id").orderBy(*feed_order()))
    packets = encoded_packets(needed, tracks).withColumn("n", n)
    counts = marked.groupBy("track_id").agg(F.sum(F.col("is_target").cast("long")).alias("targets"))
    made = packets.groupBy("track_id").agg(F.count("*").alias("packets"))
    orphans = needed.where("gop = 0 and is_target").groupBy("track_id").agg(F.count("*").alias("orphans"))
    facts = counts.join(made, "track_id", "left").join(orphans, "track_id", "left").fillna(0, ["packets", "orphans"])
    told = lambda where, code, severity, message: T.diagnostics(facts.where(where), code, severity, message, F.col("track_id"))
    notes = told("targets = 0", "video_request.empty_targets", "warning", F.lit("no sample matches"))
    notes = notes.unionByName(told("orphans > 0", "video_request.no_preceding_keyframe", "warning", F.concat(F.col("orphans").cast("string"), F.lit(" targets before any key sample"))))
    notes = notes.unionByName(told("targets > 0 and packets = 0", "video_request.missing_packet_data", "error", F.lit("the samples have no bytes")))
    if most_packets is None:
        return packets, notes
    left_out = F.concat(F.lit(f"only the first {most_packets} packets are taken, "), (F.col("packets") - most_packets).cast("string"), F.lit(" are not"))
    return packets.where(F.col("n") <= most_packets), notes.unionByName(told(f"packets > {most_packets}", "video_request.truncated", "warning", left_out))


def audio_range(selected: DataFrame, end_us: int | None = None, most_us: int | None = None) -> DataFrame:
    """(track_id, start_us, end_us, too_long) that decoding a selection of sound covers; without an end, up to the last selected time.

    ``too_long`` marks ranges of more than ``most_us``, which :func:`range_errors` tells; a player takes 300 seconds.
    """
    last = F.max("pts_us") if end_us is None else F.lit(end_us).cast("long")
    rows = selected.groupBy("track_id").agg(F.min("pts_us").alias("start_us"), last.alias("end_us"))
    return rows.withColumn("too_long", F.lit(False) if most_us is None else F.col("end_us") - F.col("start_us") > most_us)


def range_errors(ranges: DataFrame) -> DataFrame:
    """(source_id, severity, code, message) of the ranges of sound that are too long to be decoded at once."""
    seconds = F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3).cast("string")
    return T.diagnostics(ranges.where("too_long"), "audio_request.range_too_long", "error", F.concat(seconds, F.lit(" seconds")), F.col("track_id"))


#: What a decoder of pictures is asked for where nothing is said: each track's first key sample.
FIRST_KEY = S.Criteria(frame_type="key", limit=1)


def _decodable(tracks: DataFrame, kind: str, node: str, bare: Column) -> tuple[DataFrame, DataFrame]:
    """(tracks of a kind that have a decoder's configuration or need none (``bare``), errors of the others)."""
    law = F.col("law") if "law" in tracks.columns else F.lit(None).cast("string")
    codec = decoder_config(F.col("kind"), F.col("family"), F.col("config"), law)
    problem = F.when(~F.col("kind").eqNullSafe(kind), F.lit(f"is not {kind}")).when(codec.isNull() & ~F.coalesce(bare, F.lit(False)), "has no decoder configuration")
    rows = tracks.withColumns({"decoder": codec, "_problem": problem})
    errors = T.diagnostics(rows.where("_problem is not null"), f"{node}.track", "error", F.col("_problem"), F.col("track_id"))
    return rows.where("_problem is null").drop("_problem"), errors


def video_decode(samples: DataFrame, tracks: DataFrame, criteria: S.Criteria = FIRST_KEY, track_id: str | None = None, nth: object = 0, eager: bool = False, most_packets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(packets for a decoder in their order ``n``, notes) of one video track of each source (source_id, track_id, index, kind, family, format, config).

    Without ``eager`` the packets are those of the selected samples, as a player streams them (all of a track's, if nothing is selected), and a note
    says that no picture is asked for; with it, also those that decoding the selected pictures needs.
    """
    picked, _, errors = S.select_tracks(tracks, samples, track_id, "video", nth)
    good, unfit = _decodable(picked, "video", "video_decode", F.lit(False))
    marked = S.mark_samples(samples.join(good.select("track_id"), "track_id", "left_semi"), criteria)
    empty = marked.groupBy("track_id").agg(F.max("is_target").alias("some")).where("not some")
    notes = errors.unionByName(unfit).unionByName(T.diagnostics(empty, "selection.empty", "warning", F.lit("no sample matches"), F.col("track_id")))
    if eager:
        packets, told = decode_marked(marked, good, most_packets)
        return packets, notes.unionByName(told)
    some = F.max("is_target").over(Window.partitionBy("track_id"))
    packets = encoded_packets(marked.withColumn("_some", some).where("is_target or not _some"), good)
    skipped = T.diagnostics(good, "video_decode.eager_decode_skipped", "info", F.lit("packets only, no pictures"), F.col("track_id"))
    return packets.withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy(*feed_order()))), notes.unionByName(skipped)


def audio_decode(samples: DataFrame, tracks: DataFrame, start_seconds: object = 0, end_seconds: object = -1, track_id: str | None = None, nth: object = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packets in their order ``n``, ranges (track_id, start_us, end_us), notes) of one audio track of each source, as in :func:`video_decode`.

    The range lies after the track's first sample; without an end it reaches to where the last sample ends. MP3 needs no configuration, and its samples
    without a duration last until the next one; other samples without one have no part in a range that starts at or after them.
    """
    start, end = S.finite(start_seconds) or 0, S.finite(end_seconds)
    criteria = S.Criteria(start_us=start * 1_000_000, end_us=-1 if end is None else end * 1_000_000, kind="audio")
    picked, _, errors = S.select_tracks(tracks, samples, track_id, "audio", nth)
    good, unfit = _decodable(picked, "audio", "audio_decode", F.col("family") == "mp3")
    own = samples.join(good.select("track_id", F.col("family").eqNullSafe("mp3").alias("_mp3")), "track_id")
    spans = S.selection_ranges(own, criteria)
    begin = F.greatest(F.lit(0), F.floor("range_start")).cast("long")
    ranges = spans.select("track_id", begin.alias("start_us"), F.greatest(begin, F.floor("range_end").cast("long")).alias("end_us"))
    reach = F.col("pts_us") + F.coalesce("duration_us", F.lit(0))
    plain = own.where("not _mp3").join(ranges, "track_id").where((reach > F.col("start_us")) & (F.col("pts_us") < F.col("end_us"))).drop("start_us", "end_us")
    heard = plain.unionByName(S.select_samples(own.where("_mp3"), criteria).drop("position", "n")).drop("_mp3")
    w = Window.partitionBy("track_id").orderBy(*presentation_order())
    rate = W.positive(F.col("rate")) if "rate" in good.columns else F.lit(None).cast("long")
    frame = good.select("track_id", F.floor(1024 * 1_000_000 / F.coalesce(rate, F.lit(48_000)) + 0.5).cast("long").alias("_frame"))
    packets = encoded_packets(heard, good).withColumns({"n": F.row_number().over(w), "_step": F.lead("pts_us").over(w) - F.col("pts_us")}).join(frame, "track_id")
    lasts = F.coalesce(W.positive(F.col("duration_us")), W.positive(F.col("_step")), F.col("_frame"))
    packets = packets.withColumns({"duration_us": lasts, "is_key": (F.col("family") == "aac") | F.col("is_key")}).drop("_step", "_frame")
    silent = heard.groupBy("track_id").agg(F.max(F.coalesce(F.length("data"), F.lit(0))).alias("longest")).where("longest = 0")
    notes = errors.unionByName(unfit)
    notes = notes.unionByName(T.diagnostics(ranges.where("end_us <= start_us"), "audio_request.empty_range", "warning", F.lit("the range is empty"), F.col("track_id")))
    notes = notes.unionByName(T.diagnostics(silent, "audio_request.missing_packet_data", "error", F.lit("the samples have no bytes"), F.col("track_id")))
    return packets, ranges, notes


def g711_clips(packets: DataFrame, ranges: DataFrame, rate: int = 8000, channels: int = 1, law: str = "ulaw") -> DataFrame:
    """(track_id, planes array<array<double>>, pts_us) of G.711 packets (track_id, pts_us, data): side by side, as floats, cut to each track's range.

    Ranges that are ``too_long`` have no row here but one in :func:`range_errors`.
    """
    decode = B.ulaw_to_pcm16 if law == "ulaw" else B.alaw_to_pcm16
    near = packets.join(ranges.where("not too_long"), "track_id").where("pts_us < end_us")
    whole = near.groupBy("track_id", "start_us", "end_us").agg(W.joined_in_order("data", "pts_us").alias("data"), F.min("pts_us").alias("first"))
    codes = F.when(F.length("data") > 0, F.transform(B.bytes_of(F.col("data")), decode)).otherwise(F.array().cast("array<int>"))
    planes = F.transform(P.float_planes(codes, channels), lambda p: P.trim(p, rate, F.least("first", "start_us"), F.col("start_us"), F.col("end_us")))
    return whole.select("track_id", planes.alias("planes"), F.col("start_us").alias("pts_us"))


def encoded_selection(packets: DataFrame, suffix: str) -> DataFrame:
    """Samples of a new track ``<id>:<suffix>`` of what an encoder made (track_id, pts_us, duration_us, is_key, data)."""
    track = F.concat_ws(":", "track_id", F.lit(suffix))
    index = F.row_number().over(Window.partitionBy("track_id").orderBy("pts_us")) - 1
    return packets.select(
        track.alias("track_id"), F.concat_ws(":", track, index.cast("string")).alias("sample_id"), index.cast("long").alias("index"), "pts_us", F.col("pts_us").alias("dts_us"),
        "duration_us", "is_key", F.lit(0).cast("long").alias("offset"), F.length("data").cast("long").alias("size"), "data",
    )


def clock_packets(frames: DataFrame) -> DataFrame:
    """Packets without bytes that pace decoded frames (track_id, frame_id, sample_id, pts_us, index) by their times."""
    rows = T.frame_durations(frames)
    return rows.select(F.concat(F.lit("clock:"), F.col("frame_id")).alias("packet_id"), "sample_id", "track_id", "pts_us", F.col("pts_us").alias("dts_us"), F.col("frame_us").alias("duration_us"), F.lit(True).alias("is_key"))


def resolved_frames(packets: DataFrame, frames: DataFrame, keep: bool = False) -> DataFrame:
    """(packet_id, frame_id): the frame of each packet by the packet's id, else by its sample's, else by its time; the last of several. Frames have
    packet_id, sample_id, pts_us and an order ``index``; ``keep`` keeps the packets' keys."""
    rows = packets.select("packet_id", "sample_id", "pts_us")
    for key, name in (("packet_id", "a"), ("sample_id", "b"), ("pts_us", "c")):
        latest = frames.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("frame_id", "index").alias(name))
        rows = rows.join(latest, key, "left")
    return rows.select("packet_id", *["sample_id", "pts_us"] * keep, F.coalesce("a", "b", "c").alias("frame_id"))


def byte_views(rows: DataFrame, kind: str, group: str, order: list[str], data: str = "data") -> DataFrame:
    """(group, source_type, base_offset, data): the bytes behind a group of rows side by side, for a hex view.

    ``kind`` names what the rows are; samples keep the first one's offset as the place that the view starts at.
    """
    base = F.coalesce(F.min_by("offset", F.struct(*order)), F.lit(0)).cast("long") if "offset" in rows.columns else F.lit(0).cast("long")
    n = F.count("*").cast("string")
    return rows.groupBy(group).agg(F.concat(F.lit(f"{kind}["), n, F.lit("]")).alias("source_type"), base.alias("base_offset"), W.joined_in_order(data, *order).alias("data"))


def printable(data: Column) -> Column:
    """Bytes as text, a point for each that is not printable ASCII."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
