"""The named workflows, each a function from files to lazy DataFrames; nothing runs before a sink."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import bits
from tracklake.functions import bitstream as N
from tracklake.functions import bytesql as B
from tracklake.operators import packets as K
from tracklake.operators import selection as S
from tracklake.operators import timeline as T
from tracklake.sources import audio as A
from tracklake.sources import flv, mp4, transport, walk
from tracklake.sources import media as M


class Walk:
    """The rows of one walk over files, kept while several questions are put to them; ``with`` or :meth:`close` frees them."""

    def __init__(self, sources: DataFrame, formats: Sequence[str] | None = None, with_data: bool = False) -> None:
        self.rows = walk.files(sources, formats, with_data).persist(StorageLevel.DISK_ONLY)

    def close(self) -> None:
        self.rows.unpersist()

    def __enter__(self) -> Walk:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


#: Containers whose samples or headers can be read.
FORMATS = tuple(walk.WALKS)

_SAMPLE = ["track_id", "source_id", "kind", "index", "pts_us", "dts_us", "duration_us", "offset", "size", "is_key", "picture_type", "is_idr"]


def _rows_of(sources: DataFrame | Walk, formats: Sequence[str]) -> DataFrame:
    """The rows of a walk, or of a new one over sources."""
    return sources.rows.where(F.col("format").isin(*formats)) if isinstance(sources, Walk) else Walk(sources, formats).rows


def samples_of(rows: DataFrame, with_data: bool = False, formats: Sequence[str] = FORMATS) -> DataFrame:
    """Samples of all containers: the timed pieces of :func:`tracklake.sources.walk.files`. A track's id joins the container, the kind, the container's own number of
    it and the source.

    MP3 frames get times by the samples before them, sound in WAVE files is cut into packets, and transport streams take kind and codec from the
    program map: streams that it says are something else are left out, and where a file has no map the packets' own kinds count. Only the ``formats`` that are
    named have branches in the plan.
    """
    none = F.lit(None)
    given = {"duration_us": none.cast("long"), "picture_type": none.cast("string"), "is_idr": none.cast("boolean")}
    parts = []

    def add(some: DataFrame, number: str | None = "track", **columns: Column) -> None:
        some = some.withColumns({**given, **columns})
        track = F.concat_ws(":", "format", "kind", *([F.col(number).cast("string")] if number else []), "source_id")
        parts.append(some.withColumn("track_id", track).select(*_SAMPLE, *["data"] * with_data))

    form = F.col("format")
    if {"flv", "mp4"} & {*formats}:
        add(rows.where(form.isin("flv", "mp4") & F.col("what").isin("tag", "sample") & ~F.coalesce("config", F.lit(False)) & (F.col("kind") != "script")))
    if "mpegps" in formats:
        of = rows.where((form == "mpegps") & (F.col("what") == "packet")).drop("kind", "pts_us", "dts_us").withColumnsRenamed({"track": "stream_id", "body": "head"})
        add(transport.timed_packets(of, "format", "data"), "stream_id", is_key=F.col("kind") == "audio")
    if "mp3" in formats:
        of = rows.where((form == "mp3") & (F.col("what") == "frame")).withColumnRenamed("number", "header").drop("pts_us", "duration_us")
        add(A.timed_frames(of), None, dts_us=F.col("pts_us"), is_key=F.lit(True), duration_us=F.col("duration_us"))
    if "wav" in formats:
        add(M.wav_packets(wav_of(rows)).withColumns({"format": F.lit("wav"), "kind": F.lit("audio"), "data": none.cast("binary")}), None, dts_us=F.col("pts_us"), duration_us=F.col("duration_us"))
    if "mpegts" in formats:
        pes = M.pes_times(rows.where((form == "mpegts") & (F.col("what") == "pes")))
        told = transport.streams(sections_of(rows)).select("source_id", F.col("pid").alias("track"), F.col("kind").alias("told"), "codec")
        mapped = told.select("source_id").distinct().withColumn("mapped", F.lit(True))
        pes = pes.join(told, ["source_id", "track"], "left").join(mapped, "source_id", "left").where("told is not null or mapped is null").withColumn("kind", F.coalesce("told", "kind"))
        first = F.when(F.coalesce("codec", F.lit("h264")) == "h264", B.uint_be(F.col("slices"), 0, 1).bitwiseAND(31)).when(F.col("codec") == "h265", F.shiftright(B.uint_be(F.col("slices"), 1, 1), 1).bitwiseAND(63) + 100)
        first = F.when(F.col("kind") == "video", first)
        idr = F.when((first == 5) | first.between(116, 121), True).when((first == 1) | first.between(100, 109), False)
        add(pes, offset=F.lit(0).cast("long"), is_idr=idr, picture_type=F.when(idr, "I").when(~idr, "P"), is_key=F.when(F.col("kind") == "audio", True).otherwise(F.coalesce(idr, F.lit(False))))
    if not parts:
        raise ValueError(f"none of {', '.join(formats)} has samples")
    return reduce(lambda a, b: a.unionByName(b), parts)


def wav_of(rows: DataFrame) -> DataFrame:
    """The tracks of WAVE files in a walk, as :func:`tracklake.sources.media.wav_tracks` has them."""
    body = F.col("body")
    found = rows.where("format = 'wav' and what = 'pcm'").select("source_id", B.uint_le(body, 4, 4).alias("rate"), B.uint_le(body, 2, 2).alias("channels"), B.uint_le(body, 14, 2).alias("bits"), F.col("offset").alias("data_offset"), F.col("size").alias("bytes"))
    return M.pcm_length(found)


def sections_of(rows: DataFrame) -> DataFrame:
    """The table packets of transport streams in a walk, as program tables are read from."""
    return rows.where("format = 'mpegts' and what = 'section'").select("source_id", "index", F.col("track").alias("pid"), F.lit(True).alias("start"), F.col("body").alias("payload"))


def boxes_of(rows: DataFrame) -> DataFrame:
    """The header boxes of MP4 files in a walk."""
    return rows.where("format = 'mp4' and what = 'box'").select("source_id", "name", "track", "offset", "size", "body")


def transport_samples(sources: DataFrame, with_data: bool = False) -> DataFrame:
    """Samples of transport streams, one for each elementary packet, with picture types."""
    return samples_of(Walk(sources, ("mpegts",), with_data).rows, with_data, ("mpegts",))


def analyse(sources: DataFrame | Walk, formats: Sequence[str] = FORMATS) -> tuple[DataFrame, DataFrame]:
    """(tracks, samples) of WAVE, MP3, FLV, MP4, transport and program stream sources; FLAC and Opus have a track (see :func:`streams`) but no samples, unknown
    sources neither. Files are opened once, by one walk; give a :class:`Walk` to put further questions to it and to free it."""
    samples = samples_of(_rows_of(sources, formats), formats=formats)
    kinds = samples.groupBy("track_id").agg(F.first("source_id").alias("source_id"), F.first("kind").alias("kind"))
    return kinds.join(T.track_summary(samples), "track_id"), samples


_STREAM = ["source_id", "format", "kind", "source_track", "codec", "family", "config", "duration_ms", "rate", "channels", "width", "height", "fps"]


def _stream(rows: DataFrame, form: str, kind: Column, **columns: Column) -> DataFrame:
    types = {"config": "binary", "width": "long", "height": "long", "rate": "long", "channels": "long", "fps": "double", "duration_ms": "double"}
    given = {"format": F.lit(form), "kind": kind, "source_id": F.col("source_id"), **columns}
    return rows.select(*[given.get(k, F.lit(None)).cast(types.get(k, "string")).alias(k) for k in _STREAM])


def streams(sources: DataFrame | Walk, formats: Sequence[str] = FORMATS) -> DataFrame:
    """What the headers of sources say of their streams (source_id, format, kind, source_track, codec, family, config, duration_ms, rate, channels, width,
    height, fps), for :func:`tracklake.operators.packets.normalised`; what no header says is null."""
    rows = _rows_of(sources, formats)
    col, audio, video = F.col, F.lit("audio"), F.lit("video")
    ms = col("duration_us") / 1000
    sound = {"rate": col("rate"), "channels": col("channels")}
    of = lambda form, what: rows.where((col("format") == form) & (col("what") == what))

    def flv_streams() -> DataFrame:
        tags = of("flv", "tag")
        pictures = tags.where("kind = 'video'").groupBy("source_id").agg(F.min_by("body", F.when(col("config"), col("offset"))).alias("config"), F.min_by("number", "offset").alias("number"), F.max("dts_us").alias("duration_us"))
        first = F.when(B.uint_be(col("config"), 5, 1).bitwiseAND(31) > 0, F.substring("config", 9, B.uint_be(col("config"), 6, 2).cast("int")))
        pictures = pictures.withColumn("f", bits.header(F.when(col("number") == 7, first), "h264_sps"))
        family = F.when(col("number") == 7, "h264").when(col("number") == 12, "h265").otherwise("unknown")
        shown = _stream(pictures, "flv", video, codec=F.upper(family), family=family, config=col("config"), width=col("f")["width"], height=col("f")["height"], fps=bits.frame_rate(col("f")), duration_ms=ms)
        # a file that says nothing else is taken to be as long as its latest tag
        heard = flv.sound_of(rows).join(tags.groupBy("source_id").agg(F.max("dts_us").alias("duration_us")), "source_id")
        return shown.unionByName(_stream(heard, "flv", audio, codec=F.upper("codec"), family=col("codec"), duration_ms=ms, **sound))

    def transported() -> DataFrame:
        key = ["source_id", "pid"]
        pes = M.pes_times(of("mpegts", "pes")).withColumnRenamed("track", "pid")
        sets = of("mpegts", "set").withColumnsRenamed({"track": "pid", "number": "n", "body": "unit"})
        told = of("mpegts", "sound").groupBy("source_id", col("track").alias("pid")).agg(F.min_by("body", "index").alias("s"))
        told = told.select(*key, A.adts_header(col("s")).alias("h"), A.asc_of_adts(col("s")).alias("asc"))
        found = transport.streams(sections_of(rows)).where("kind is not null").join(transport.track_spans(pes), key, "left").join(transport.first_configs(sets), key, "left").join(told, key, "left")
        found = found.withColumn("f", bits.header(F.when(col("codec") == "h264", col("sps")), "h264_sps"))
        config = F.when(col("codec") == "h264", mp4.avc_config(col("sps"), col("pps"))).otherwise(col("asc"))
        return _stream(found, "mpegts", col("kind"), source_track=col("pid"), codec=col("stream_name"), family=col("codec"), config=config, rate=col("h.rate"), channels=col("h.channels"), width=col("f")["width"], height=col("f")["height"], fps=bits.frame_rate(col("f")), duration_ms=ms)

    def program() -> DataFrame:
        packets = transport.timed_packets(of("mpegps", "packet").select("source_id", "index", col("track").alias("stream_id"), col("body").alias("head"), "offset", "size"))
        found = packets.groupBy("source_id", "stream_id", "kind").agg((F.max("pts_us") - F.min("pts_us")).alias("duration_us"))
        return _stream(found, "mpegps", col("kind"), source_track=col("stream_id"), duration_ms=ms)

    def movies() -> DataFrame:
        found = mp4.track_headers(boxes_of(rows))
        family = F.when(col("v").isin("avc1", "avc3"), "h264").when(col("v").isin("hvc1", "hev1"), "h265").when((col("a") == "mp4a") & (col("object_type").isNotNull()), "aac").when(col("a").isin("mp4a", ".mp3"), "mp3").when(col("a").isin("ulaw", "alaw"), "g711").otherwise("unknown")
        length = F.when(col("timescale") > 0, col("duration") * 1000 / col("timescale"))
        return _stream(found, "mp4", col("kind"), source_track=col("track"), codec=F.coalesce("v", "a"), family=family, config=F.coalesce("config", "asc"), width=col("width"), height=col("height"), fps=col("frame_rate"), duration_ms=length, **sound)

    head = lambda form: of(form, "head").select("source_id", col("body").alias("data"))
    frames = lambda: A.timed_frames(of("mp3", "frame").select("source_id", "index", "offset", "size", col("number").alias("header")))
    parts = {
        "wav": lambda: _stream(wav_of(rows), "wav", audio, codec=F.lit("PCM"), family=F.lit("pcm"), duration_ms=ms, **sound),
        "mp3": lambda: _stream(A.mp3_tracks(frames()), "mp3", audio, codec=F.lit("MP3"), family=F.lit("mp3"), duration_ms=ms, **sound),
        "flac": lambda: _stream(A.flac_tracks(head("flac")), "flac", audio, codec=F.lit("FLAC"), family=F.lit("unknown"), duration_ms=ms, **sound),
        "opus": lambda: _stream(A.opus_tracks(head("opus")), "opus", audio, codec=F.lit("Opus"), family=F.lit("unknown"), **sound),
        "flv": flv_streams, "mpegts": transported, "mpegps": program, "mp4": movies,
    }
    wanted = [make() for name, make in parts.items() if name in formats]
    if not wanted:
        raise ValueError(f"none of {', '.join(formats)} has streams; known are {', '.join(parts)}")
    return reduce(lambda a, b: a.unionByName(b), wanted)


def track_table(sources: DataFrame | Walk, formats: Sequence[str] = FORMATS) -> DataFrame:
    """The tracks of sources with what their headers say and what their samples add up to; files are opened once."""
    sources = sources if isinstance(sources, Walk) else Walk(sources, formats)
    key = F.concat_ws(":", "format", "kind", "source_track", "source_id")
    told = K.normalised(streams(sources, formats).withColumns({"index": F.lit(0), "key": key}), "key")
    summary = analyse(sources, formats)[0].select(F.col("track_id").alias("key"), "n_samples", F.col("duration_us").alias("sampled_us"), "n_bytes", "bitrate")
    return told.join(summary, "key", "left").drop("key", "index").fillna(0, ["n_samples"])


def overview(spark: SparkSession, path: str, formats: Sequence[str] = FORMATS) -> DataFrame:
    """Tracks of the files under a path."""
    return track_table(M.load_files(spark, path), formats)


def source_hex(sources: DataFrame, offset: int = 0, size: int = 256) -> DataFrame:
    """A stretch of the bytes of each source in hex, of 1 to 4096 bytes."""
    data = B.part(F.col("data"), F.least(F.lit(max(0, offset)), F.length("data")), max(1, min(4096, size)))
    return sources.select("source_id", F.length("data").alias("byte_length"), B.spaced_hex(data).alias("hex"))


def first_key_sample(samples: DataFrame) -> DataFrame:
    """The first key sample of each video track."""
    return S.select_samples(samples.where("kind = 'video'"), S.Criteria(frame_type="key", limit=1))


def audio_packets(samples: DataFrame, first: int = 0, last: int = 49) -> DataFrame:
    """A range of packets of each audio track."""
    return S.select_samples(samples.where("kind = 'audio'"), S.Criteria(start_index=first, end_index=last, kind="audio"))


def sample_bytes(samples: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the bytes of samples, after all selection has been done; null where they lie outside the source.

    What is wanted of a source is gathered first, so that each source's bytes meet one row and not one for each sample; cells hold no more than a source.
    """
    wanted = samples.groupBy(F.col("source_id").alias("_source")).agg(F.collect_list(F.struct(*samples.columns)).alias("_rows"))
    both = wanted.join(sources.select(F.col("source_id").cast("string").alias("_of"), F.col("data").alias("_all")), F.col("_source") == F.col("_of"))
    cut = F.transform("_rows", lambda r: F.struct(r.alias("row"), B.slice_bytes(F.col("_all"), r["offset"], r["size"]).alias("data")))
    return both.select(F.explode(cut).alias("_")).select("_.row.*", "_.data")


def remux_plan(samples: DataFrame, align: str = "none") -> DataFrame:
    """Samples of all tracks of each source in the order and at the places that one file would have: deltas and payload offsets.

    ``align`` keeps of each kind only what the span of the other covers: ``trim_to_video`` or ``trim_to_audio``.
    """
    video, audio = (samples.where(F.col("kind") == k) for k in ("video", "audio"))
    if align == "trim_to_video":
        samples = video.unionByName(T.align_to(audio, video))
    elif align == "trim_to_audio":
        samples = audio.unionByName(T.align_to(video, audio))
    sizes = samples.groupBy("source_id", "track_id").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_id").orderBy("track_id").rowsBetween(*T.BEFORE)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("track_id", "start")
    placed = T.sample_offsets(T.dts_deltas(samples).join(starts, "track_id"), "track_id", F.col("start"), ["pts_us", "index"], "size")
    return placed.drop("start")


REMUXABLE = ("mp4", "flv", "mpegts", "mpegps")


def remux(sources: DataFrame | Walk, align: str = "none", start_us: int = 0, end_us: int | None = None, formats: Sequence[str] = REMUXABLE) -> tuple[DataFrame, DataFrame]:
    """(files, errors): MP4 files of the first track of pictures and of sound of each source, without decoding.

    Sources in other containers than ``REMUXABLE`` have none. Units with start codes get lengths, sound in ADTS is cut into its frames, and configurations are
    those of the headers or what the packets carry. Tracks that can't be written are told as errors and left out. Files are opened once, by one walk that
    carries the bytes; a :class:`Walk` that is given must have been made ``with_data``.
    """
    none = F.lit(None).cast("binary")
    found = sources if isinstance(sources, Walk) else Walk(sources.where(F.col("format").isin(*formats)), formats, with_data=True)
    tracks = streams(found, formats).withColumn("key", F.concat_ws(":", "format", "kind", "source_track", "source_id"))
    tracks = tracks.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "kind").orderBy("key"))).where("n = 1")
    tracks = tracks.select(F.col("source_id").alias("file_id"), F.col("key").alias("track_id"), "kind", F.col("family").alias("codec"), mp4.inferred_config(F.col("family"), F.col("config"), none, none, none, none, F.col("rate"), F.col("channels")).alias("config"), "width", "height", "rate", "channels", "format")
    tracks = tracks.withColumn("problem", mp4.mux_problem())
    errors = T.diagnostics(tracks.where("problem is not null"), "mux.unsupported", "error", F.col("problem"), F.col("track_id"))
    good = tracks.where("problem is null").drop("problem")
    samples = samples_of(found.rows, True, formats)
    samples = samples.where(S.overlaps(start_us, end_us)).join(good.select("track_id", "codec", "format", F.col("rate").alias("r")), "track_id")
    transported = F.col("format").isin("mpegts", "mpegps")
    samples = samples.withColumn("parts", F.when(transported & (F.col("codec") == "aac"), N.adts_frames(F.col("data"))).otherwise(F.array("data")))
    samples = samples.select("*", F.posexplode("parts").alias("part", "one"))
    bytes_ = F.when(transported & (F.col("kind") == "video"), F.coalesce(N.length_prefixed(N.annexb_nals(F.col("one"))), F.col("one"))).otherwise(F.col("one"))
    later = F.floor(F.col("part") * 1024 * 1_000_000 / F.coalesce("r", F.lit(48_000)) + 0.5)
    samples = samples.select(F.col("source_id").alias("file_id"), "track_id", "kind", (F.col("index") * 64 + F.col("part")).alias("index"), (F.col("pts_us") + later).alias("pts_us"), (F.col("dts_us") + later).alias("dts_us"), "duration_us", "is_key", bytes_.alias("data"))
    if align != "none":
        keep, cut = ("video", "audio") if align == "trim_to_video" else ("audio", "video")
        span = samples.where(F.col("kind") == keep).groupBy("file_id").agg((F.max(F.col("pts_us") + F.coalesce("duration_us", F.lit(1))) - F.min("pts_us")).alias("span"))
        first = F.min("pts_us").over(Window.partitionBy("file_id", "track_id"))
        samples = samples.withColumn("since", F.col("pts_us") - first).join(span, "file_id", "left").where((F.col("kind") != cut) | F.col("span").isNull() | (F.col("since") < F.col("span"))).drop("since", "span")
    return mp4.mux(samples.drop("kind"), good.drop("format")), errors
