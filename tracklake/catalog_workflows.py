"""Queries of whole workflows: files are made of the tables, written, walked, and must give the rows back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog_containers import _MOVIE, _MP3, files, movies, mp3_files, parts, track, transport_files
from .functions import writers as W
from .plans import workflows as flows
from .registry import EV, query
from .sources import media as M
from .sources import mp4, ranges, sink, walk
from .tables import shared_folder

_SAMPLES = f"""{_MOVIE}, k AS (SELECT track_id, count(*) FILTER (is_key) AS keys FROM g WHERE kind = 'video' GROUP BY track_id)
SELECT g.track_id::VARCHAR AS source_id, kind, sample, n::BIGINT AS size, coalesce(sum(delta) OVER (PARTITION BY g.track_id, kind ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dts, p - d AS shift,
  CASE WHEN kind = 'audio' OR keys = 0 THEN true ELSE is_key END AS is_key FROM g LEFT JOIN k ON k.track_id = g.track_id"""


def read(sources: DataFrame) -> DataFrame:
    rows = walk.files(sources, ("mp4",)).where("what = 'sample'")
    return rows.select("source_id", "kind", F.col("index").alias("sample"), "size", F.col("ticks").alias("dts"), "shift", "is_key")


@query("q_workflow_tracks", f"""{_MOVIE}, f AS (SELECT track_id, kind, count(*) AS n_samples, sum(n) AS n_bytes FROM g GROUP BY ALL),
s AS (SELECT track_id::VARCHAR AS source_id, 'mpegps' AS format, CASE WHEN is_key THEN 'video' ELSE 'audio' END AS kind, count(*) AS n_samples, sum(size % 50 + 1) AS n_bytes FROM ev GROUP BY ALL)
SELECT 'm' || track_id AS source_id, 'mp4' AS format, kind, CASE kind WHEN 'video' THEN 'h264' ELSE 'aac' END AS family, CASE kind WHEN 'video' THEN 320 END::BIGINT AS width, CASE kind WHEN 'audio' THEN 44100 END::BIGINT AS rate, n_samples, n_bytes::BIGINT AS n_bytes FROM f
UNION ALL SELECT 'p' || source_id, format, kind, 'unknown', NULL, NULL, n_samples, n_bytes::BIGINT FROM s""")
def _(spark, d):
    """The track table of movies and program streams: what headers say and what samples add up to, by one walk over all files."""
    made = mp4.mux(*movies(spark, d)).select(F.concat(F.lit("m"), "file_id").alias("source_id"), "data")
    n = F.col("size") % 50 + 1
    pes = F.concat(F.lit(b"\0\0\1"), F.when(F.col("is_key"), F.lit(b"\xe0")).otherwise(F.lit(b"\xc0")), W.be(n + 8, 2), F.lit(b"\x80\x80\x05"), W.stamp33(F.expr("pts_us div 1000 % 80000000 * 90")), F.unhex(F.repeat(F.lit("AB"), n.cast("int"))))
    streams = files(parts(spark, d).withColumn("packet", pes), "packet", b"\0\0\1\xba\x44\0\4\0\4\1\0\0\3\xf8")
    both = made.unionByName(streams.select(F.concat(F.lit("p"), "source_id").alias("source_id"), "data"))
    rows = flows.track_table(both, ("mp4", "mpegps"))
    # a long track of events is several program streams
    return rows.groupBy(track(), "format", "kind", "family", "width", "rate").agg(F.sum("n_samples").alias("n_samples"), F.sum("n_bytes").alias("n_bytes"))


@query("q_workflow_remux", _SAMPLES)
def _(spark, d):
    """Movies taken apart and put together again without decoding; times in ticks survive."""
    made = mp4.mux(*movies(spark, d)).select(F.col("file_id").alias("source_id"), "data")
    again, _ = flows.remux(M.probe(made), formats=("mp4",))
    return read(again.select(F.col("file_id").alias("source_id"), "data"))


def written(spark, pieces: DataFrame, name: str, key: str, order: list[str]) -> str:
    """A new shared folder with the files of pieces."""
    path = shared_folder(spark, name)
    sink.write_files(pieces, path, key, order=order)
    return path


@query("q_file_sink", _SAMPLES)
def _(spark, d):
    """Movies streamed into files on disk, tracks interleaved in chunks of half a second, and read back."""
    path = written(spark, mp4.segments(*movies(spark, d)), "movies", "file_id", ["start_us", "number", "n"])
    return read(M.load_files(spark, path).select(F.col("name").alias("source_id"), "data"))


#: Small, so that files of a few hundred kilobytes have several splits.
SPLIT = 1 << 16


@query("q_split_packets", f"""WITH {EV}, p AS (SELECT *, (pts // 1000) % 80000000 * 90 AS ticks FROM ev) SELECT track_id::VARCHAR AS source_id, CASE WHEN is_key THEN 256 ELSE 257 END::BIGINT AS pid, CASE WHEN is_key THEN 'video' ELSE 'audio' END AS kind, floor(ticks * 100 / 9::DOUBLE + 0.5)::BIGINT AS pts_us FROM p""")
def _(spark, d):
    """Transport streams on disk, read in byte ranges."""
    path = written(spark, transport_files(spark, d), "streams", "source_id", [])
    rows = ranges.ts_pes(spark, path, SPLIT).withColumn("source_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), "%3A", ":"))
    return rows.select(track(), "pid", "kind", "pts_us")


@query("q_split_frames", f"""{_MP3} SELECT track_id::VARCHAR AS source_id, (30 + coalesce(sum(len) OVER (PARTITION BY track_id, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", k::BIGINT AS "index", len::BIGINT AS size, rate::BIGINT AS rate,
  bitrate::BIGINT AS bitrate, floor(1152 * k * 1000000 / rate::DOUBLE + 0.5)::BIGINT AS pts_us FROM l""")
def _(spark, d):
    """MP3 files on disk, read in byte ranges; frames are numbered and timed over all ranges."""
    path = written(spark, mp3_files(spark, d), "sound", "source_id", [])
    rows = ranges.mp3_frames(spark, path, SPLIT).withColumn("source_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), "%3A", ":"))
    return rows.select(track(), "offset", "index", "size", "rate", "bitrate", "pts_us")
