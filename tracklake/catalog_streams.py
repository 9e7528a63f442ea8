"""Queries of numbers, names and identities, of pictures and effects, of packets and requests, and of clocks and rings over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import bytesql as B
from .functions import names, planes
from .functions import pcm as P
from .functions import writers as W
from .operators import packets as K
from .operators import sound
from .operators import timeline as T
from .registry import EV, ev, query, table, vectors
from .streaming import live, rings

# --- numbers and names


@query("q_writers", """SELECT l_orderkey, l_linenumber, l_partkey, printf('%02x%04x%06x%08x', (l_partkey % 256)::INT, (l_partkey % 65536)::INT, l_partkey::INT, l_orderkey::INT) || printf('%016x', l_orderkey) || printf('%08x', ((4294967296 - l_suppkey) % 4294967296)::BIGINT) AS written, l_partkey / 8.0::DOUBLE AS number, 'x' || l_orderkey::VARCHAR AS name FROM lineitem""")
def _(spark, d):
    """Integers of all widths, a negative one, a number of eight bytes and a text up to a zero byte, written and read."""
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    written = F.concat(W.be(part, 1), W.be(part, 2), W.be(part, 3), W.be(order, 4), W.be(order, 8), W.be(-F.col("l_suppkey"), 4))
    data = F.concat(written, W.double_be(part / 8), F.encode(F.concat(F.lit("x"), order.cast("string")), "utf-8"), F.lit(b"\0tail"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", data.alias("data"))
    x = F.col("data")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.lower(F.hex(B.part(x, 0, 22))).alias("written"), W.float_be(x, 22, 8).alias("number"), W.cstring(x, 30).alias("name"))


@query("q_guards", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN -l_extendedprice ELSE l_extendedprice END::DOUBLE AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN isfinite(x) THEN x ELSE 0 END AS finite, CASE WHEN isfinite(x) AND x > 0 THEN floor(x + 0.5)::BIGINT ELSE 1 END AS positive_int, CASE WHEN isfinite(x) THEN greatest(0, floor(x + 0.5))::BIGINT ELSE 0 END AS non_negative,
  CASE WHEN isfinite(x) AND x > 0 THEN x END AS positive, CASE WHEN isfinite(x) THEN greatest(0, floor(x * 1000 + 0.5))::BIGINT ELSE 0 END AS micros, CASE WHEN isfinite(x) THEN CASE WHEN x < 1000 THEN 1000 WHEN x > 50000 THEN 50000 ELSE x END ELSE 1000 END::DOUBLE AS clamped,
  (l_partkey * 90000 / 1000000::DOUBLE) AS ticks FROM r""")
def _(spark, d):
    kind, price = F.col("l_partkey") % 5, F.col("l_extendedprice").cast("double")
    x = F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, -price).otherwise(price)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"))
    x = F.col("x")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", W.finite(x).alias("finite"), W.positive_int(x).alias("positive_int"), W.non_negative(x).alias("non_negative"), W.positive(x).alias("positive"), W.micros(x).alias("micros"),
        W.clamp(W.finite(x), 1000.0, 50000.0).alias("clamped"), W.ticks(F.col("l_partkey"), 90_000).alias("ticks"),
    )


@query("q_header_names", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Baseline' WHEN 1 THEN 'Main' WHEN 2 THEN 'High' WHEN 3 THEN 'High 4:2:2' ELSE 'Unknown Profile (1)' END AS profile, 'Level ' || printf('%.1f', p_size / 10.0) AS level,
  (['Monochrome', '4:2:0', '4:2:2', '4:4:4', 'Unknown'])[(p_size % 5 + 1)::INT] AS chroma, CASE WHEN p_size % 3 = 0 THEN 'P slice (Predicted)' WHEN p_size % 3 = 1 THEN 'I slice (all slices in picture are I)' ELSE 'SI slice' END AS slice,
  (['Main', 'Main 10', 'Main Still Picture'])[(p_size % 3 + 1)::INT] AS hevc, (['AAC LC (Low Complexity)', 'SBR', 'Unknown (7)'])[(p_size % 3 + 1)::INT] AS aac, (['Mono', 'Stereo', '5.1'])[(p_size % 3 + 1)::INT] AS layout FROM part""")
def _(spark, d):
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (n % len(x) + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", names.avc_profile(pick(key, 66, 77, 100, 122, 1)).alias("profile"), names.level(size).alias("level"), names.named(pick(size, 0, 1, 2, 3, 9), names.CHROMA, "Unknown").alias("chroma"), names.slice_name(pick(size, 0, 7, 4)).alias("slice"),
        names.named(pick(size, 1, 2, 3), names.HEVC_PROFILES).alias("hevc"), names.named(pick(size, 2, 5, 7), names.AAC_OBJECTS).alias("aac"), names.named(pick(size, 1, 2, 6), names.AAC_LAYOUTS).alias("layout"),
    )


_BASE36 = "SELECT *, CASE WHEN h < 0 THEN '-' ELSE '' END || list_reduce(list_prepend('', list_transform(range(0, 7), lambda i: CASE WHEN abs(h) >= 36 ** (6 - i) OR i = 6 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', (abs(h) // (36 ** (6 - i))::BIGINT % 36 + 1)::INT, 1) ELSE '' END)), lambda a, b: a || b) AS out FROM"


@query("q_bytes_hash", f"""WITH b AS (SELECT p_partkey, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name || p_partkey::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)::BIGINT AS h FROM part)
SELECT p_partkey, out AS hash FROM ({_BASE36} b)""")
def _(spark, d):
    data = F.encode(F.concat("p_name", F.col("p_partkey").cast("string")), "utf-8")
    return table(spark, d, "part").select("p_partkey", W.bytes_hash(data).alias("hash"))


@query("q_text_hash", f"""WITH b AS (SELECT p_partkey, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 33 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::BIGINT AS h FROM part)
SELECT p_partkey, out AS hash FROM ({_BASE36} b)""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", W.text_hash(F.col("p_name")).alias("hash"))


@query("q_fingerprint", """SELECT o_orderkey, '{count:n:' || o_custkey::VARCHAR || ',first:b:' || (o_orderkey % 2 = 0)::VARCHAR || ',name:s:' || o_orderpriority || ',parts:[n:' || o_orderkey::VARCHAR || ',n:0.5],source:source:' || o_custkey::VARCHAR || '@' || o_orderstatus || '}' AS fingerprint FROM orders""")
def _(spark, d):
    source = F.struct(F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("version"), F.col("o_orderkey").alias("rest"))
    value = F.struct(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("count"), (F.col("o_orderkey") % 2 == 0).alias("first"), F.array(F.col("o_orderkey").cast("double"), F.lit(0.5)).alias("parts"), source.alias("source"))
    rows = table(spark, d, "orders").select("o_orderkey", value.alias("v"))
    return rows.select("o_orderkey", W.fingerprint(F.col("v"), rows.schema["v"].dataType).alias("fingerprint"))


# --- pictures and sound

def pictures(spark, d) -> DataFrame:
    """Buffers of 7 x 5 pictures with 32 bytes a row: 5 rows of luma, then 3 of blue and red in turn. A text makes as many as it fills, the last one (or, without
    text, the only one) filled up with zeros."""
    docs = table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("t"))
    each = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("t") / 256)).cast("int") - 1)
    rows = docs.select("doc_id", F.posexplode(F.transform(each, lambda i: F.substring("t", i * 256 + 1, F.lit(256)))).alias("picture", "t"))
    return rows.select("doc_id", "picture", F.rpad("t", F.lit(256), F.lit(b"\0")).alias("data"))


_CUT = lambda row, at: f"h[{64 * row + 2 * at + 1}:{64 * row + 2 * at + 2}]"
_PLANES = f"""WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents), n AS (SELECT doc_id, h, unnest(range(greatest(1, (len(h) + 511) // 512))) AS picture FROM b),
h AS (SELECT doc_id, picture::INT AS picture, rpad(h[picture * 512 + 1 : picture * 512 + 512], 512, '0') AS h FROM n),
p AS (SELECT doc_id, picture, {" || ".join(f"h[{64 * r + 1}:{64 * r + 14}]" for r in range(5))} AS y, {" || ".join(_CUT(5 + r, 2 * i) for r in range(3) for i in range(4))} AS u, {" || ".join(_CUT(5 + r, 2 * i + 1) for r in range(3) for i in range(4))} AS v FROM h)"""


@query("q_nv12_to_i420", f"{_PLANES} SELECT * FROM p")
def _(spark, d):
    lit = F.lit
    got = planes.nv12_to_i420(F.col("data"), (lit(0), lit(32)), (lit(160), lit(32)), lit(7), lit(5))
    rows = pictures(spark, d).select("doc_id", "picture", got.alias("p"))
    return rows.select("doc_id", "picture", *[F.lower(F.hex(F.col(f"p.{k}"))).alias(k) for k in "yuv"])


@query("q_i420_pack", f"{_PLANES} SELECT doc_id, picture, y || u || v AS packed, true AS same, doc_id::VARCHAR || '.yuv' AS file_name, 59::BIGINT AS n_bytes FROM p")
def _(spark, d):
    """Planes packed into a file, told as an export, and cut out again."""
    lit = F.lit
    got = planes.nv12_to_i420(F.col("data"), (lit(0), lit(32)), (lit(160), lit(32)), lit(7), lit(5))
    rows = pictures(spark, d).select("doc_id", "picture", got.alias("p"))
    rows = rows.select("doc_id", "picture", "p", planes.yuv_file(F.col("doc_id"), F.col("p"), lit(7), lit(5), lit(0)).alias("f"))
    note = planes.export_note(F.col("f"))
    again = planes.i420_planes(F.col("f.data"), lit(7), lit(5))
    return rows.select("doc_id", "picture", F.lower(F.hex("f.data")).alias("packed"), (again == F.col("p")).alias("same"), F.get_json_object(note, "$.fileName").alias("file_name"), F.get_json_object(note, "$.byteLength").cast("long").alias("n_bytes"))


@query("q_effect_chain", """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 0.5) AS x FROM embeddings), n AS (SELECT vec_id, x, list_transform(range(0, len(x) // 2 + len(x) % 2), lambda i: x[2 * i + 1]) AS y FROM s)
SELECT vec_id, len(y)::INT AS n, list_transform(y, lambda v: floor(v * 1e6::DOUBLE + 0.5)::BIGINT) AS samples FROM n""")
def _(spark, d):
    """Played twice as fast and halved."""
    out = P.baked(F.col("embedding"), 8000, [("gain", {"gain": 0.5})], playback_rate=2.0)
    return vectors(spark, d).select("vec_id", F.size(out).alias("n"), F.transform(out, lambda x: F.floor(x * 1e6 + 0.5)).alias("samples"))


@query("q_biquad")
def _(spark, d):
    """A low-pass and a peaking filter one after the other; no SQL, as each sample depends on the two results before it."""
    chain = [("biquad", {"kind": "lowpass", "frequency": 1000.0, "q": 1.0}), ("biquad", {"kind": "peaking", "frequency": 500.0, "q": 2.0, "gain_db": 6.0})]
    out = P.baked(F.col("embedding"), 8000, chain)
    return vectors(spark, d).select("vec_id", F.transform(out, lambda x: F.floor(x * 1e6 + 0.5)).alias("samples"))


def clips(spark, d) -> DataFrame:
    """The vectors of a label as one clip of sound, a block each."""
    return vectors(spark, d).select(F.col("label").alias("clip"), F.col("vec_id").alias("place"), F.col("embedding").cast("array<double>").alias("samples"))


@query("q_filtered_clips")
def _(spark, d):
    """A low-pass filter over clips that lie in many rows; no SQL, as for q_biquad."""
    out = sound.filtered_clips(clips(spark, d), *P.biquad("lowpass", 1000.0, 8000))
    return out.select("clip", "place", F.transform("samples", lambda x: F.floor(x * 1e6 + 0.5)).alias("samples"))


@query("q_spectrum", """WITH c AS (SELECT label, flatten(list(embedding ORDER BY vec_id)) AS x FROM embeddings GROUP BY label), w AS (SELECT label, x, unnest(range((len(x) - 32) // 16 + 1)) AS k FROM c),
s AS (SELECT label, k, list_transform(range(32), lambda i: x[k * 16 + i + 1]::DOUBLE * (0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 32) + 0.08::DOUBLE * cos(4 * pi() * i / 32)) / 32) AS s FROM w),
b AS (SELECT label, k, s, unnest(range(16)) AS bin FROM s),
m AS (SELECT label, k, bin, list_sum(list_transform(range(32), lambda i: s[i + 1] * cos(2 * pi() * bin * i / 32))) AS re, list_sum(list_transform(range(32), lambda i: s[i + 1] * sin(2 * pi() * bin * i / 32))) AS im FROM b)
SELECT label AS clip, k AS "window", list(floor(sqrt(re * re + im * im) * 1e9::DOUBLE + 0.5)::BIGINT ORDER BY bin) AS magnitudes FROM m GROUP BY label, k""")
def _(spark, d):
    """Spectra of clips that lie in many rows, windows of 32 samples, half overlapping; in thousand millionths."""
    return sound.spectrum(clips(spark, d), 32).withColumn("magnitudes", F.transform("magnitudes", lambda x: F.floor(x * 1e9 + 0.5)))


@query("q_wav_float", "SELECT vec_id::VARCHAR AS source_id, 3::BIGINT AS kind, 32::BIGINT AS bits, len(embedding)::BIGINT AS frames, (44 + 4 * len(embedding))::BIGINT AS n_bytes FROM embeddings")
def _(spark, d):
    from .sources import media as M

    rows = vectors(spark, d).select(F.col("vec_id").cast("string").alias("source_id"), F.col("embedding").cast("array<double>").alias("v"))
    made = M.wav_bytes(rows, "v", 8000, form="float32").select("source_id", F.col("wav").alias("data"))
    kind = made.select("source_id", B.uint_le(F.col("data"), 20, 2).alias("kind"), F.length("data").cast("long").alias("n_bytes"))
    return M.wav_tracks(made).join(kind, "source_id").select("source_id", "kind", "bits", "frames", "n_bytes")


# --- packets

_SAMPLES = f"""WITH {EV}, s AS (SELECT track_id, 't' || track_id::VARCHAR || ':' || idx::VARCHAR AS sample_id, idx, pts, is_key, is_target, size % 50 AS n, CASE WHEN track_id % 2 = 0 THEN 'video' ELSE 'audio' END AS kind FROM ev)"""


def byte_samples(spark, d) -> tuple[DataFrame, DataFrame]:
    """(samples with size % 50 bytes, of which some have none, tracks): even tracks are pictures in MP4, odd ones sound in a transport stream."""
    rows = ev(spark, d)
    rows = rows.withColumns({"sample_id": F.concat(F.lit("t"), F.col("track_id").cast("string"), F.lit(":"), F.col("index").cast("string")), "data": F.unhex(F.repeat(F.lit("AB"), (F.col("size") % 50).cast("int")))})
    even = F.col("track_id") % 2 == 0
    pick = lambda a, b: F.when(even, a).otherwise(b)
    tracks = rows.select("track_id").distinct().select("track_id", pick("video", "audio").alias("kind"), pick("h264", "aac").alias("family"), pick("mp4", "mpegts").alias("format"))
    return rows, tracks


@query("q_encoded_packets", f"{_SAMPLES} SELECT track_id, sample_id || ':packet' AS packet_id, CASE kind WHEN 'video' THEN 'avcc' ELSE 'adts' END AS layout, n::BIGINT AS n_bytes, row_number() OVER (PARTITION BY track_id ORDER BY pts, sample_id)::INT AS n FROM s WHERE n > 0")
def _(spark, d):
    """Every sample with bytes as a packet, in the order in which a decoder gets them."""
    rows, tracks = byte_samples(spark, d)
    packets, _ = K.encoded_tracks(rows, rows, tracks)
    return packets.select("track_id", "packet_id", "layout", F.length("data").cast("long").alias("n_bytes"), "n")


@query("q_encoded_counts", f"{_SAMPLES}, k AS (SELECT track_id FROM s WHERE is_key GROUP BY track_id) SELECT track_id, count(*) AS n_samples, count(*) FILTER (n > 0) AS n_packets, count(*) FILTER (n = 0) AS n_missing FROM s WHERE is_key OR track_id NOT IN (SELECT track_id FROM k) GROUP BY track_id")
def _(spark, d):
    """Key samples are selected; a track without one gives all it has."""
    rows, tracks = byte_samples(spark, d)
    return K.encoded_tracks(rows.where("is_key"), rows, tracks)[1]


@query("q_decode_request", f"""{_SAMPLES}, g AS (SELECT *, row_number() OVER w - 1 AS position, first_value(pts) OVER w AS f, sum(is_key::INT) OVER (PARTITION BY track_id ORDER BY pts, idx ROWS UNBOUNDED PRECEDING) AS gop FROM s WINDOW w AS (PARTITION BY track_id ORDER BY pts, idx)),
t AS (SELECT *, position >= 2 AND pts - f <= 1728000000000 AS hit FROM g), c AS (SELECT *, hit AND sum(hit::INT) OVER (PARTITION BY track_id ORDER BY pts, idx ROWS UNBOUNDED PRECEDING) <= 5 AS target FROM t),
n AS (SELECT *, max(target::INT) OVER (PARTITION BY track_id, gop ORDER BY pts, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS need FROM c)
SELECT track_id, sample_id, row_number() OVER (PARTITION BY track_id ORDER BY pts, sample_id || ':packet')::INT AS n FROM n WHERE need = 1 AND n.n > 0""")
def _(spark, d):
    """At most five targets of each track, from the third sample to twenty days, and what decoding them needs."""
    rows, tracks = byte_samples(spark, d)
    packets, _ = K.decode_request(rows, tracks, K.Targets(start_index=2, end_us=1_728_000_000_000, limit=5))
    return packets.select("track_id", "sample_id", "n")


@query("q_decode_notes", f"""{_SAMPLES}, g AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pts, idx) - 1 AS position, sum(is_key::INT) OVER (PARTITION BY track_id ORDER BY pts, idx ROWS UNBOUNDED PRECEDING) AS gop FROM s),
o AS (SELECT track_id, count(*) FILTER (position IN (0, 4, 9)) AS targets, count(*) FILTER (position IN (0, 4, 9) AND gop = 0) AS orphans FROM g GROUP BY track_id)
SELECT track_id::VARCHAR AS source_id, 'warning' AS severity, 'video_request.no_preceding_keyframe' AS code, orphans::VARCHAR || ' targets before any key sample' AS message FROM o WHERE orphans > 0""")
def _(spark, d):
    """Targets by place, of which some have no key sample before them."""
    rows, tracks = byte_samples(spark, d)
    notes = K.decode_request(rows.withColumn("data", F.lit(b"\x01")), tracks, K.Targets(positions=(0, 4, 9)))[1]
    return notes


@query("q_audio_range", f"WITH {EV} SELECT track_id, min(pts) AS start_us, max(pts) AS end_us, max(pts) - min(pts) > 300000000 AS too_long FROM ev WHERE is_key GROUP BY track_id")
def _(spark, d):
    return K.audio_range(ev(spark, d).where("is_key"), most_us=300_000_000)


@query("q_g711_clips", """WITH b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n, list_transform(range(0, 8), lambda i: (p_partkey * 7 + i * 31) % 256) AS codes FROM part),
c AS (SELECT p_brand, flatten(list(codes ORDER BY n)) AS codes, count(*) AS k FROM b WHERE n * 1000 < 9000 GROUP BY p_brand),
f AS (SELECT p_brand, list_transform(codes, lambda c: (CASE WHEN c < 128 THEN -1 ELSE 1 END) * ((((255 - c) & 15) * 8 + 132) * (1 << (((255 - c) >> 4) & 7)::INT) - 132) / 32768::DOUBLE) AS x FROM c)
SELECT p_brand AS track_id, x[17:72] AS samples, 2000::BIGINT AS pts_us FROM f""")
def _(spark, d):
    """Packets of eight bytes, a millisecond each, cut to the third to ninth millisecond."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    codes = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: W.be((F.col("p_partkey") * 7 + i * 31) % 256, 1))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("track_id"), ((F.row_number().over(w) - 1) * 1000).cast("long").alias("pts_us"), W.joined(codes).alias("data"))
    ranges = rows.select("track_id").distinct().select("track_id", F.lit(2000).cast("long").alias("start_us"), F.lit(9000).cast("long").alias("end_us"), F.lit(False).alias("too_long"))
    return K.g711_clips(rows, ranges).select("track_id", F.get("planes", F.lit(0)).alias("samples"), "pts_us")


@query("q_encoded_selection", f"{_SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pts) - 1 AS i FROM (SELECT track_id, pts, min(n) AS n FROM s GROUP BY track_id, pts)) SELECT track_id::VARCHAR || ':aac' AS track_id, track_id::VARCHAR || ':aac:' || i::VARCHAR AS sample_id, pts AS pts_us, n::BIGINT AS size FROM r")
def _(spark, d):
    made = byte_samples(spark, d)[0].groupBy("track_id", "pts_us").agg(F.min(F.col("size") % 50).alias("n"))
    made = made.select(F.col("track_id").cast("string").alias("track_id"), "pts_us", F.lit(21_333).cast("long").alias("duration_us"), F.lit(True).alias("is_key"), F.unhex(F.repeat(F.lit("AB"), F.col("n").cast("int"))).alias("data"))
    return K.encoded_selection(made, "aac").select("track_id", "sample_id", "pts_us", "size")


@query("q_clock_packets", f"WITH {EV} SELECT 'clock:f' || idx::VARCHAR AS packet_id, pts AS pts_us, coalesce(lead(pts) OVER w - pts, pts - lag(pts) OVER w, 33333) AS duration_us FROM ev WINDOW w AS (PARTITION BY track_id ORDER BY pts, idx)")
def _(spark, d):
    frames = ev(spark, d).withColumns({"frame_id": F.concat(F.lit("f"), F.col("index").cast("string")), "sample_id": F.col("index").cast("string")})
    return K.clock_packets(frames).select("packet_id", "pts_us", "duration_us")


@query("q_byte_views", f"""{_SAMPLES} SELECT track_id, 'MediaSample[' || count(*)::VARCHAR || ']' AS source_type, arg_min(idx * 10, idx)::BIGINT AS base_offset, sum(n)::BIGINT AS n_bytes, md5(coalesce(string_agg(repeat('ab', n::INT), '' ORDER BY idx), '')) AS digest FROM s GROUP BY track_id""")
def _(spark, d):
    rows = byte_samples(spark, d)[0].withColumn("offset", F.col("index") * 10)
    views = K.byte_views(rows, "MediaSample", "track_id", ["index"])
    return views.select("track_id", "source_type", "base_offset", F.length("data").cast("long").alias("n_bytes"), F.md5(F.lower(F.hex("data"))).alias("digest"))


#: Every byte of a character beyond ASCII is a point.
_POINTS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[\x{80}-\x{7ff}]', '..', 'g'), '[\x{800}-\x{ffff}]', '...', 'g'), '[\x{10000}-\x{10ffff}]', '....', 'g'), '[^\x20-\x7e]', '.', 'g')"


@query("q_printable", f"SELECT page_id, strlen({_POINTS})::BIGINT AS n, md5({_POINTS}) AS digest FROM pages")
def _(spark, d):
    """The text beside a hex view, of whole pages."""
    rows = table(spark, d, "pages").select("page_id", K.printable(F.encode("html", "utf-8")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("q_normalised_tracks", """SELECT p_partkey::VARCHAR AS source_id, (['mp4', 'flv', 'mpegts'])[(p_partkey % 3 + 1)::INT] || ':' || CASE WHEN p_size % 2 = 0 THEN 'video' ELSE 'audio' END || ':' || CASE WHEN p_size % 5 = 0 THEN '7' ELSE p_size::VARCHAR END AS track_id,
  CASE WHEN p_size % 4 = 0 THEN 'Unknown' WHEN p_size % 4 = 1 THEN 'PCM' ELSE 'MP3' END AS codec, CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'pcm' WHEN 2 THEN 'mp3' ELSE 'aac' END AS family, floor(p_retailprice * 1000 + 0.5)::BIGINT AS duration_us, CASE WHEN p_size % 7 > 0 THEN (p_size % 7)::BIGINT END AS rate FROM part""")
def _(spark, d):
    size, none = F.col("p_size"), F.lit(None).cast("long")
    streams = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("source_id"), F.element_at(F.array(*[F.lit(x) for x in ("mp4", "flv", "mpegts")]), (F.col("p_partkey") % 3 + 1).cast("int")).alias("format"), F.when(size % 2 == 0, "video").otherwise("audio").alias("kind"),
        F.when(size % 5 > 0, size).alias("source_track"), F.lit(7).alias("index"), F.when(size % 4 == 1, "PCM").when(size % 4 > 1, "MP3").alias("codec"), F.when(size % 4 == 3, "aac").otherwise("unknown").alias("family"), F.lit(b"").alias("config"),
        F.col("p_retailprice").cast("double").alias("duration_ms"), (size % 7).cast("long").alias("rate"), none.alias("channels"), none.alias("width"), none.alias("height"), none.alias("fps"),
    )
    return K.normalised(streams).select("source_id", "track_id", "codec", "family", "duration_us", "rate")


@query("q_container_duration", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN floor(o_totalprice / (o_custkey % 7 + 1)::DOUBLE * 1000000 + 0.5)::BIGINT WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice * 1000 + 0.5)::BIGINT END AS duration_us FROM orders""")
def _(spark, d):
    price = F.col("o_totalprice").cast("double")
    stated = F.when(F.col("o_orderkey") % 3 > 0, price).otherwise(F.lit(float("nan")))
    last = F.when(F.col("o_orderkey") % 2 == 0, price)
    return table(spark, d, "orders").select("o_orderkey", K.container_duration(stated, (F.col("o_custkey") % 7 + 1).cast("double"), last).alias("duration_us"))


@query("q_decoder_config", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 4 > 0 THEN 'avc1.42c0' || printf('%02x', (p_size % 256)::INT) END WHEN 1 THEN 'mp4a.40.' || (p_size % 31)::VARCHAR ELSE CASE WHEN p_size % 2 = 0 THEN 'alaw' ELSE 'ulaw' END END AS codec FROM part""")
def _(spark, d):
    form, size = F.col("p_partkey") % 3, F.col("p_size")
    avc = F.when(size % 4 > 0, F.concat(F.lit(b"\x01\x42\xc0"), W.be(size, 1), F.lit(b"\xff"))).otherwise(F.lit(b"\x01\x42"))
    config = F.when(form == 0, avc).when(form == 1, F.concat(W.be(size % 31 * 8, 1), F.lit(b"\x10")))
    kind, family = F.when(form == 0, "video").otherwise("audio"), F.when(form == 0, "h264").when(form == 1, "aac").otherwise("g711")
    return table(spark, d, "part").select("p_partkey", K.decoder_config(kind, family, config, F.when(size % 2 == 0, "alaw")).alias("codec"))


# --- clocks and rings over streams

@query("q_state_clock", f"""WITH {EV}, s AS (SELECT track_id, idx, pts, coalesce(floor((pts - lag(pts) OVER w) * 1e-7::DOUBLE + 0.5), 0)::BIGINT AS step FROM ev WINDOW w AS (PARTITION BY track_id ORDER BY pts, idx)),
t AS (SELECT track_id, idx, pts, sum(step) OVER (PARTITION BY track_id ORDER BY pts, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM s) SELECT track_id, idx, pts AS pts_us, total // 33333 * 33333 AS clock_us, total % 33333 AS carry_us FROM t""")
def _(spark, d):
    """A clock of 30 pictures a second, ten million times slower than the samples: what is left of a picture is carried over."""
    rows = ev(spark, d, stream=True).withColumnRenamed("index", "idx")
    return rings.replayed(rings.presentation_clock(rows, rate=1e-7, fps=30))


@query("q_state_sample_ring", f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS i FROM ev), p AS (SELECT track_id, i // 2 AS pair, min(idx) AS w, max(idx) AS r, count(*) AS k FROM n GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pair) AS z FROM p)
SELECT track_id, w AS idx, 3::BIGINT AS taken, []::DOUBLE[] AS samples, 3::BIGINT AS available, (z - 1)::BIGINT AS underruns, 0::BIGINT AS overruns FROM x
UNION ALL SELECT track_id, r, 0, [w, w + 1, w + 2, 0]::DOUBLE[], 0, z, 0 FROM x WHERE k = 2""")
def _(spark, d):
    """Three samples are written and four read in turn, so every read runs dry by one."""
    rows = ev(spark, d, stream=True)
    whole = ev(spark, d).select("track_id", "index", (F.row_number().over(Window.partitionBy("track_id").orderBy("index")) % 2 == 1).alias("writes"))
    x = F.col("index").cast("double")
    rows = rows.select("track_id", "index").join(whole, ["track_id", "index"]).select("track_id", F.col("index").alias("idx"), F.when(F.col("writes"), F.array(x, x + 1, x + 2)).alias("samples"), F.lit(4).cast("long").alias("want"))
    return rings.replayed(rings.sample_ring(rows, capacity=8))


@query("q_pulses", f"WITH {EV} SELECT 'pulse' AS kind, 'Record' AS label, 'trigger_button:Record' AS source_id, track_id, pts AS pts_us FROM ev WHERE is_key")
def _(spark, d):
    return rings.pulses(ev(spark, d), "is_key", "Record")


@query("q_ring_source", f"WITH {EV} SELECT track_id, idx, pts FROM ev")
def _(spark, d):
    """A ring that is filled once takes the table; what is out of range in its settings is moved into it."""
    rows = rings.ring_source(rings.RingConfig(rate=0.0, capacity_seconds=-1.0, overrun="none of these"), static=ev(spark, d))
    return rows.select("track_id", F.col("index").alias("idx"), F.col("pts_us").alias("pts"))


@query("q_presentation_offsets", f"WITH {EV} SELECT track_id, idx, pts - first_value(pts) OVER (PARTITION BY track_id ORDER BY pts, idx) AS since FROM ev")
def _(spark, d):
    """How long after its track's first sample in decode order each sample is shown."""
    marked = K.target_samples(ev(spark, d).withColumn("sample_id", F.col("index").cast("string")), K.Targets())
    first = F.first("pts_us").over(Window.partitionBy("track_id").orderBy("position"))
    return marked.select("track_id", F.col("index").alias("idx"), (F.col("pts_us") - first).alias("since"))


@query("q_mux_durations", f"""WITH {EV}, x AS (SELECT track_id, greatest(1, coalesce(pts - lag(pts) OVER (PARTITION BY track_id ORDER BY pts, idx), 1)) AS delta FROM ev), t AS (SELECT track_id, sum(delta)::BIGINT AS ticks FROM x GROUP BY track_id)
SELECT track_id, ticks, max(ticks) OVER (PARTITION BY track_id % 10) AS movie_ticks FROM t""")
def _(spark, d):
    """Deltas summed up by track, and the longest track of each group of tracks that share a movie."""
    ticks = T.dts_deltas(ev(spark, d)).groupBy("track_id").agg(F.sum("delta").alias("ticks"))
    return ticks.withColumn("movie_ticks", F.max("ticks").over(Window.partitionBy(F.col("track_id") % 10)))


# --- live sessions

#: What the watermark has passed when a stream has read all events: ten seconds before the last of them.
_PASSED = "pts < ((SELECT max(pts) FROM ev) // 1000 - 10000) * 1000"


def live_events(spark, d):
    rows = ev(spark, d, stream=True).select("track_id", F.col("index").alias("idx"), "pts_us", "is_key", "is_target")
    return rows.withColumn("ts", F.timestamp_micros("pts_us"))


@query("q_released", f"WITH {EV} SELECT track_id, idx, pts AS pts_us, row_number() OVER (PARTITION BY track_id ORDER BY pts, idx) AS n FROM ev WHERE {_PASSED}")
def _(spark, d):
    """Packets of a stream, released when the watermark passes their times; what the watermark has not passed is held."""
    return rings.replayed(live.released(live_events(spark, d)))


@query("q_control_gate", f"""WITH {EV}, k AS (SELECT *, CASE WHEN is_key THEN 'start' WHEN is_target THEN 'stop' END AS action FROM ev),
s AS (SELECT *, last_value(action IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY pts, action IS NULL, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'start' AS open FROM k)
SELECT track_id, CASE WHEN action IS NULL THEN 'media' WHEN action = 'start' THEN CASE WHEN open THEN 'already_recording' ELSE 'started' END WHEN open THEN 'stopped' ELSE 'not_recording' END AS event, idx, CASE WHEN action IS NULL THEN pts END AS pts_us
FROM s WHERE (action IS NOT NULL OR open) AND {_PASSED}""")
def _(spark, d):
    """A gate that a control stream opens (signups) and shuts (purchases), with what it refuses."""
    rows = live_events(spark, d)
    control = rows.where("is_key or is_target").withColumn("action", F.when(F.col("is_key"), "start").otherwise("stop"))
    return rings.replayed(live.control_gate(rows.where("not is_key and not is_target"), control))


@query("q_presentable_within", f"""WITH {EV}, c AS (SELECT DISTINCT track_id, pts AS clock_us FROM ev WHERE is_target), p AS (SELECT track_id, pts FROM ev WHERE NOT is_target)
SELECT c.track_id, clock_us, coalesce(max(pts) FILTER (pts <= clock_us), min(pts)) AS pts_us FROM c LEFT JOIN p ON c.track_id = p.track_id AND abs(pts - clock_us) <= 172800000000 GROUP BY ALL""")
def _(spark, d):
    """The packet that is shown at each tick, within two days: the same plan serves two streams."""
    rows = ev(spark, d).withColumn("ts", F.timestamp_micros("pts_us"))
    return live.presentable(rows.where("is_target"), rows.where("not is_target"), "2 days")
