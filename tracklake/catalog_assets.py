"""Queries over sources with several tracks: a user's events are one source, and each type of event one stream of it.

Streams whose values stay low have no track, so their samples go to another track of their kind or to none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import packets as K
from .operators import selection as S
from .registry import query, table

_STREAMS = """e AS (SELECT user_id::VARCHAR AS source_id, event_id AS idx, epoch_us(ts) AS pts, value, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS stream,
  CASE WHEN event_type IN ('view', 'click') THEN 'video' WHEN event_type IN ('error', 'purchase') THEN 'audio' ELSE 'text' END AS kind, floor(value * 100 + 0.5)::BIGINT % 50 AS size FROM events),
t AS (SELECT source_id, stream, kind, source_id || ':' || stream AS track_id, max(value) < 250 AS told FROM e GROUP BY ALL HAVING max(value) >= 100),
f AS (SELECT source_id, kind, arg_min(track_id, stream) AS other FROM t GROUP BY ALL),
a AS (SELECT e.*, coalesce(track_id, other) AS track_id FROM e LEFT JOIN t USING (source_id, stream, kind) LEFT JOIN f USING (source_id, kind)),
m AS (SELECT *, track_id || ':' || idx AS sample_id, value > 60 AS is_key FROM a WHERE track_id IS NOT NULL)"""
#: The first track of each source and kind, those that a decoder takes, and their samples with places.
_PICKED = f"""{_STREAMS}, c AS (SELECT DISTINCT source_id FROM t),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source_id, kind ORDER BY stream) = 1),
s AS (SELECT m.*, k.kind AS of, k.told, row_number() OVER w - 1 AS position, first_value(pts) OVER w AS first_pts FROM m JOIN k USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY idx, pts))"""


def streams(spark, d) -> tuple[DataFrame, DataFrame]:
    """(samples by stream, tracks of the streams whose values reach 100); those that reach 250 have no configuration."""
    kinds = F.col("event_type")
    number = F.when(kinds == "view", 0).when(kinds == "click", 1).when(kinds == "error", 2).when(kinds == "purchase", 3).otherwise(4)
    kind = F.when(kinds.isin("view", "click"), "video").when(kinds.isin("error", "purchase"), "audio").otherwise("text")
    pts = F.unix_micros(F.col("ts").cast("timestamp"))
    size = F.floor(F.col("value") * 100 + 0.5) % 50
    samples = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("source_id"), number.alias("stream_index"), kind.alias("kind"), F.col("event_id").alias("index"), pts.alias("pts_us"), pts.alias("dts_us"),
        F.lit(None).cast("long").alias("duration_us"), (F.col("value") > 60).alias("is_key"), F.lit(None).cast("string").alias("picture_type"), F.lit(None).cast("boolean").alias("is_idr"),
        "value", F.unhex(F.repeat(F.lit("AB"), size.cast("int"))).alias("data"),
    )
    tracks = samples.groupBy("source_id", "stream_index", "kind").agg(F.max("value").alias("most")).where("most >= 100")
    pick = lambda a, b: F.when(F.col("kind") == "video", F.lit(a)).otherwise(F.lit(b))
    config = F.when(F.col("most") < 250, pick(b"\x01\x42\x00\x1e\xff\xe0", b"\x12\x10"))
    named = {"track_id": F.concat_ws(":", "source_id", "stream_index"), "index": F.col("stream_index"), "family": pick("h264", "aac"), "format": F.lit("mp4"), "config": config, "rate": F.lit(44_100)}
    return samples.drop("value"), tracks.withColumns(named).drop("most")


def mapped(spark, d) -> tuple[DataFrame, DataFrame]:
    samples, tracks = streams(spark, d)
    return S.map_to_tracks(samples, tracks)[0], tracks


@query("q_map_to_tracks", f"WITH {_STREAMS} SELECT source_id, idx, track_id, sample_id FROM m")
def _(spark, d):
    """Samples on the track of their stream, else on the first of their kind."""
    return mapped(spark, d)[0].select("source_id", F.col("index").alias("idx"), "track_id", "sample_id")


@query("q_unmapped_samples", f"WITH {_STREAMS} SELECT source_id, 'warning' AS severity, 'analysis.unmapped_sample' AS code, 'sample ' || idx || ' has no track' AS message FROM a WHERE track_id IS NULL")
def _(spark, d):
    """Samples of kinds of which their source has no track."""
    return S.map_to_tracks(*streams(spark, d))[1]


@query("q_tracks_of_sources", f"""WITH {_STREAMS}, p AS (SELECT * FROM t WHERE kind = 'video' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY stream) = 2)
SELECT p.source_id, p.track_id, count(*) AS n_samples FROM p JOIN m USING (track_id) GROUP BY ALL""")
def _(spark, d):
    """The second track of pictures of each source, and its samples."""
    samples, tracks = mapped(spark, d)
    picked, own, _ = S.select_tracks(tracks, samples, kind="video", nth=1)
    return picked.select("source_id", "track_id").join(own.groupBy("track_id").agg(F.count("*").alias("n_samples")), "track_id")


@query("q_sources_without_track", f"""WITH {_STREAMS} SELECT source_id, 'error' AS severity, 'selection.no_track' AS code, 'no track 1 of kind video' AS message FROM t
GROUP BY source_id HAVING count(*) FILTER (kind = 'video') < 2""")
def _(spark, d):
    samples, tracks = mapped(spark, d)
    return S.select_tracks(tracks, samples, kind="video", nth="1.9")[2]


@query("q_selection_facts", f"""WITH {_STREAMS}, w AS (SELECT *, first_value(pts) OVER v AS first_pts FROM m WINDOW v AS (PARTITION BY track_id ORDER BY idx, pts))
SELECT track_id, count(*) FILTER (pts >= first_pts + 1728000000000 AND is_key) AS n_selected, min(first_pts) + 1728000000000 AS range_start, arg_max(pts, idx) AS range_end FROM w GROUP BY track_id""")
def _(spark, d):
    """Key samples from the twentieth day on; values that ask for nothing possible are as if they were not given."""
    samples, _ = mapped(spark, d)
    c = S.Criteria(start_index=-3, end_index=math.nan, start_us=1_728_000_000_000, end_us="never", frame_type="key", order="?", limit=-2)
    return S.selection_facts(samples, S.select_samples(samples, c), c)[0]


@query("q_empty_selections", f"""WITH {_STREAMS}, w AS (SELECT *, first_value(pts) OVER v AS first_pts FROM m WINDOW v AS (PARTITION BY track_id ORDER BY idx, pts))
SELECT track_id AS source_id, 'warning' AS severity, 'selection.empty' AS code, 'no sample matches' AS message FROM w GROUP BY track_id HAVING count(*) FILTER (pts >= first_pts + 1728000000000 AND is_key) = 0""")
def _(spark, d):
    samples, _ = mapped(spark, d)
    c = S.Criteria(start_us=1_728_000_000_000, frame_type="key")
    return S.selection_facts(samples, S.select_samples(samples, c), c)[1]


_VIDEO = f"{_PICKED}, v AS (SELECT * FROM s WHERE of = 'video' AND told), h AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx, pts) AS n_key FROM v WHERE is_key)"


@query("q_video_decode", f"""WITH {_VIDEO}, q AS (SELECT * FROM h WHERE n_key = 1 UNION ALL BY NAME SELECT *, NULL AS n_key FROM v WHERE track_id NOT IN (SELECT track_id FROM h))
SELECT track_id, sample_id || ':packet' AS packet_id, 'avcc' AS layout, size::BIGINT AS n_bytes, row_number() OVER (PARTITION BY track_id ORDER BY pts, sample_id || ':packet')::INT AS n FROM q WHERE size > 0""")
def _(spark, d):
    """What a decoder of pictures gets where nothing is said: the first key sample of the first track of each source, or all of a track without one."""
    packets, _ = K.video_decode(*mapped(spark, d))
    return packets.select("track_id", "packet_id", "layout", F.length("data").cast("long").alias("n_bytes"), "n")


@query("q_video_decode_notes", f"""WITH {_VIDEO} SELECT source_id, 'error' AS severity, 'selection.no_track' AS code, 'no track 0 of kind video' AS message FROM c WHERE source_id NOT IN (SELECT source_id FROM k WHERE kind = 'video')
UNION ALL SELECT track_id, 'error', 'video_decode.track', 'has no decoder configuration' FROM k WHERE kind = 'video' AND NOT told
UNION ALL SELECT track_id, 'warning', 'selection.empty', 'no sample matches' FROM v GROUP BY track_id HAVING NOT bool_or(is_key)
UNION ALL SELECT track_id, 'info', 'video_decode.eager_decode_skipped', 'packets only, no pictures' FROM k WHERE kind = 'video' AND told""")
def _(spark, d):
    return K.video_decode(*mapped(spark, d))[1]


@query("q_video_decode_eager", f"""WITH {_VIDEO}, g AS (SELECT *, sum(is_key::INT) OVER (PARTITION BY track_id ORDER BY pts, idx ROWS UNBOUNDED PRECEDING) AS gop FROM v),
x AS (SELECT track_id, idx FROM g WHERE position >= 2 AND NOT is_key QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY pts, idx) <= 2),
n AS (SELECT g.*, max((x.idx IS NOT NULL)::INT) OVER (PARTITION BY g.track_id, gop ORDER BY pts, g.idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS need FROM g LEFT JOIN x ON x.track_id = g.track_id AND x.idx = g.idx)
SELECT track_id, sample_id, row_number() OVER (PARTITION BY track_id ORDER BY pts, sample_id || ':packet')::INT AS n FROM n WHERE need = 1 AND size > 0""")
def _(spark, d):
    """Two pictures that are no key samples, in decode order from the third sample on, and all that decoding them needs."""
    packets, _ = K.video_decode(*mapped(spark, d), S.Criteria(start_index=2, frame_type="non_key", order="decode", limit=2), eager=True)
    return packets.select("track_id", "sample_id", "n")


_AUDIO = f"{_PICKED}, r AS (SELECT * FROM s WHERE of = 'audio' AND told)"


@query("q_audio_decode", f"""WITH {_AUDIO}, b AS (SELECT *, lead(pts) OVER w - pts AS step, row_number() OVER w AS n FROM r WHERE size > 0 AND pts > first_pts + 172800000000 AND pts < first_pts + 777600000000 WINDOW w AS (PARTITION BY track_id ORDER BY pts, sample_id))
SELECT track_id, sample_id, CASE WHEN step > 0 THEN step ELSE 23220 END AS duration_us, true AS is_key, n::INT AS n FROM b""")
def _(spark, d):
    """Sound of the third to the ninth day of the first track of sound of each source; what no next packet tells lasts as long as a frame of AAC."""
    return K.audio_decode(*mapped(spark, d), start_seconds=172_800, end_seconds="777600")[0].select("track_id", "sample_id", "duration_us", "is_key", "n")


@query("q_audio_decode_notes", f"""WITH {_AUDIO}, z AS (SELECT track_id, min(first_pts) + 1728000000000 AS a, greatest(min(first_pts) + 1728000000000, arg_max(pts, idx)) AS b FROM r GROUP BY track_id)
SELECT source_id, 'error' AS severity, 'selection.no_track' AS code, 'no track 0 of kind audio' AS message FROM c WHERE source_id NOT IN (SELECT source_id FROM k WHERE kind = 'audio')
UNION ALL SELECT track_id, 'error', 'audio_decode.track', 'has no decoder configuration' FROM k WHERE kind = 'audio' AND NOT told
UNION ALL SELECT track_id, 'warning', 'audio_request.empty_range', 'the range is empty' FROM z WHERE b <= a
UNION ALL SELECT z.track_id, 'error', 'audio_request.missing_packet_data', 'the samples have no bytes' FROM z JOIN r ON r.track_id = z.track_id AND pts > a AND pts < b GROUP BY z.track_id HAVING max(size) = 0""")
def _(spark, d):
    """From the twentieth day to where the last sample of each track ends."""
    return K.audio_decode(*mapped(spark, d), start_seconds=1_728_000)[2]
