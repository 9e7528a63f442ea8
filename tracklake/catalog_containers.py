"""Queries of containers and of what stands in their packets: files are built from rows natively, and the readers must give the rows back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import bits, names
from .functions import bitstream as N
from .functions import bytesql as B
from .functions import writers as W
from .operators import timeline as T
from .plans import workflows as flows
from .registry import EV, ev, query, table
from .sources import audio as A
from .sources import flv, mp4, transport, walk
from .sources import media as M
from .tables import spread

#: Rows of a track that one file holds.
FILE_ROWS = 4096
_PARTS = f"p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS n FROM ev), q AS (SELECT *, n // {FILE_ROWS} AS part, n % {FILE_ROWS} AS k FROM p)"


def parts(spark, d) -> DataFrame:
    """Samples with their file ``part`` and place ``k`` in it."""
    n = F.row_number().over(Window.partitionBy("track_id").orderBy("index")).cast("long") - 1
    return ev(spark, d).withColumn("_n", n).withColumns({"part": F.expr(f"_n div {FILE_ROWS}"), "k": F.expr(f"_n % {FILE_ROWS}")}).drop("_n")


def files(rows: DataFrame, data: str, head: bytes = b"") -> DataFrame:
    """(source_id, data): one file for each track and part."""
    out = rows.groupBy("track_id", "part").agg(W.joined_in_order(data, "index").alias("data"))
    return out.select(F.concat_ws(":", "track_id", "part").alias("source_id"), F.concat(F.lit(head), "data").alias("data"))


def track() -> Column:
    return F.get(F.split("source_id", ":"), F.lit(0)).alias("source_id")


def transport_files(spark, d) -> DataFrame:
    """(source_id, data): one packet for each event, pictures and sound under two numbers."""
    ticks = F.floor(F.col("pts_us") / 1000) % 80_000_000 * 90
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    stamp = F.concat(byte(F.lit(0x21) + F.shiftleft(F.shiftright(ticks, 30).bitwiseAND(7), 1)), byte(F.shiftright(ticks, 22).bitwiseAND(255)), byte(F.shiftleft(F.shiftright(ticks, 15).bitwiseAND(127), 1) + 1), byte(F.shiftright(ticks, 7).bitwiseAND(255)), byte(F.shiftleft(ticks.bitwiseAND(127), 1) + 1))
    key = F.col("is_key")
    head = F.concat(F.lit(b"\x47"), F.when(key, F.lit(b"\x41\x00")).otherwise(F.lit(b"\x41\x01")), F.lit(b"\x10"))
    pes = F.concat(F.lit(b"\x00\x00\x01"), F.when(key, F.lit(b"\xe0")).otherwise(F.lit(b"\xc0")), F.lit(b"\x00\x00\x80\x80\x05"), stamp, F.lit(b"\xff" * 170))
    part = F.floor((F.row_number().over(Window.partitionBy("track_id").orderBy("index")) - 1) / FILE_ROWS)
    files = ev(spark, d).withColumns({"packet": F.concat(head, pes), "part": part}).groupBy("track_id", "part").agg(W.joined_in_order("packet", "index").alias("data"))
    return files.select(F.concat_ws(":", "track_id", "part").alias("source_id"), "data")


# --- sound files

_RATE1, _SAMPLING = [f"([{', '.join(map(str, x))}])" for x in (A.RATES_1, A.SAMPLING[3])]
_MP3 = f"""WITH {EV}, {_PARTS}, h AS (SELECT *, {_RATE1}[(size % 14 + 2)::INT] * 1000 AS bitrate, {_SAMPLING}[(idx % 3 + 1)::INT] AS rate FROM q),
l AS (SELECT *, 144 * bitrate // rate + idx % 2 AS len FROM h)"""


def mp3_files(spark, d) -> DataFrame:
    """An ID3 tag and a frame for each sample, its rates chosen by the sample."""
    rows = parts(spark, d)
    pick = lambda values, at: F.get(F.array(*[F.lit(x) for x in values]), at.cast("int"))
    bitrate, rate = pick(A.RATES_1, F.col("size") % 14 + 1) * 1000, pick(A.SAMPLING[3], F.col("index") % 3)
    size = F.floor(bitrate * 144 / rate) + F.col("index") % 2
    head = F.concat(F.lit(b"\xff\xfb"), W.be((F.col("size") % 14 + 1) * 16 + F.col("index") % 3 * 4 + F.col("index") % 2 * 2, 1), F.when(F.col("is_key"), F.lit(b"\xc0")).otherwise(F.lit(b"\x40")))
    frame = F.concat(head, F.unhex(F.repeat(F.lit("00"), (size - 4).cast("int"))))
    return files(rows.withColumn("frame", frame), "frame", b"ID3\4\0\0\0\0\0\x14" + bytes(20))


@query("q_mp3_frames", f"""{_MP3} SELECT track_id::VARCHAR AS source_id, (30 + coalesce(sum(len) OVER (PARTITION BY track_id, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", len::BIGINT AS size, rate::BIGINT AS rate,
  CASE WHEN is_key THEN 1 ELSE 2 END::BIGINT AS channels, bitrate::BIGINT AS bitrate, floor(1152 * k * 1000000 / rate::DOUBLE + 0.5)::BIGINT AS pts_us FROM l""")
def _(spark, d):
    return A.mp3_frames(mp3_files(spark, d)).select(track(), "offset", "size", "rate", "channels", "bitrate", "pts_us")


@query("q_mp3_tracks", f"{_MP3} SELECT track_id::VARCHAR AS source_id, part, arg_min(rate, k)::BIGINT AS rate, count(*) AS frames, floor(count(*) * 1152 * 1000000 / arg_min(rate, k)::DOUBLE + 0.5)::BIGINT AS duration_us FROM l GROUP BY track_id, part")
def _(spark, d):
    rows = A.mp3_tracks(A.mp3_frames(mp3_files(spark, d)))
    return rows.select(track(), F.get(F.split("source_id", ":"), F.lit(1)).cast("long").alias("part"), "rate", "frames", "duration_us")


@query("q_flac_header", """SELECT p_partkey::VARCHAR AS source_id, 8000 + p_partkey % 40000 AS rate, p_size % 8 + 1::BIGINT AS channels, p_size % 24 + 8::BIGINT AS bits, p_partkey * 1000 AS frames, CASE WHEN p_partkey > 0 THEN floor(p_partkey * 1000 * 1000000 / (8000 + p_partkey % 40000)::DOUBLE + 0.5)::BIGINT END AS duration_us FROM part""")
def _(spark, d):
    word = F.shiftleft(8000 + F.col("p_partkey") % 40000, 44) + F.shiftleft((F.col("p_size") % 8).cast("long"), 41) + F.shiftleft((F.col("p_size") % 24 + 7).cast("long"), 36) + F.col("p_partkey") * 1000
    data = F.concat(F.lit(b"fLaC\0\0\0\x22" + bytes(10)), W.be(word, 8), F.lit(bytes(16)))
    return A.flac_tracks(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_id"), data.alias("data")))


@query("q_opus_header", "SELECT p_partkey::VARCHAR AS source_id, (8000 + p_partkey)::BIGINT AS rate, (p_size % 8 + 1)::BIGINT AS channels, (p_partkey % 4000)::BIGINT AS pre_skip FROM part")
def _(spark, d):
    little = lambda c, n: F.reverse(F.array(*[W.be(F.shiftright(c, 8 * i), 1) for i in reversed(range(n))]))
    key, size = F.col("p_partkey"), F.col("p_size")
    data = F.concat(F.lit(b"OggS" + bytes(24) + b"OpusHead\1"), W.be(size % 8 + 1, 1), W.joined(little(key % 4000, 2)), W.joined(little(key + 8000, 4)), F.lit(bytes(3)))
    return A.opus_tracks(table(spark, d, "part").select(key.cast("string").alias("source_id"), data.alias("data")))


_ADTS = "WITH r AS (SELECT p_partkey, p_size % 4 + 1 AS object_type, p_partkey % 13 AS rate_index, p_size % 7 + 1 AS channels FROM part)"


@query("q_adts_config", f"""{_ADTS} SELECT p_partkey, object_type::BIGINT AS object_type, ([{', '.join(map(str, B.AAC_RATES))}])[(rate_index + 1)::INT]::BIGINT AS rate, channels::BIGINT AS channels,
  printf('%04x', ((object_type << 11) + (rate_index << 7) + (channels << 3))::INT) AS config FROM r""")
def _(spark, d):
    """A header after up to 40 bytes that are none."""
    r = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", (F.col("p_size") % 4).alias("t"), (F.col("p_partkey") % 13).alias("i"), (F.col("p_size") % 7 + 1).alias("c"))
    head = F.concat(F.lit(b"\xff\xf1"), W.be(F.col("t") * 64 + F.col("i") * 4 + F.shiftright(F.col("c").cast("int"), 2), 1), W.be(F.col("c") % 4 * 64, 1), F.lit(b"\x1f\xfc\0"))
    data = F.concat(F.unhex(F.repeat(F.lit("FF"), (F.col("p_partkey") % 41).cast("int"))), F.lit(b"\0"), head)
    rows = r.select("p_partkey", data.alias("data")).select("p_partkey", A.adts_header(F.col("data")).alias("h"))
    return rows.select("p_partkey", F.col("h.object_type").cast("long").alias("object_type"), F.col("h.rate").cast("long").alias("rate"), F.col("h.channels").cast("long").alias("channels"), F.lower(F.hex(A.asc_of_header(F.col("h")))).alias("config"))


@query("q_asc_parse", f"""WITH r AS (SELECT p_partkey, p_partkey % 3 AS form, p_partkey % 13 AS i, p_size % 8 AS c, p_size % 13 AS e FROM part), t AS (SELECT *, ([{', '.join(map(str, B.AAC_RATES))}]) AS rates FROM r)
SELECT p_partkey, CASE form WHEN 1 THEN 5 ELSE 2 END::BIGINT AS object_type, rates[(i + 1)::INT]::BIGINT AS rate, c::BIGINT AS channels, CASE WHEN form = 0 THEN NULL WHEN form = 1 THEN 2 ELSE 5 END::BIGINT AS extension_type,
  CASE WHEN form > 0 THEN rates[(e + 1)::INT] END::BIGINT AS extension_rate FROM t""")
def _(spark, d):
    """Plain, with an extension told first, and with one after a sync word."""
    form, i, c, e = F.col("p_partkey") % 3, F.col("p_partkey") % 13, F.col("p_size") % 8, F.col("p_size") % 13
    text = lambda x, n: F.lpad(F.bin(F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")), n, "0")
    head = lambda kind: F.concat(text(kind, 5), text(i, 4), text(c, 4))
    plain_, early = F.concat(head(2), F.lit("000")), F.concat(head(5), text(e, 4), text(2, 5), F.lit("000"))
    late = F.concat(plain_, text(0x2B7, 11), text(5, 5), F.lit("1"), text(e, 4))
    data = W.bits_to_bytes(F.when(form == 0, plain_).when(form == 1, early).otherwise(late))
    rows = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", data.alias("data")).select("p_partkey", A.audio_config(F.col("data")).alias("a"))
    return rows.select("p_partkey", *[F.col(f"a.{k}").cast("long").alias(k) for k in ("object_type", "rate", "channels", "extension_type", "extension_rate")])


# --- program and transport streams

@query("q_ps_roundtrip", f"WITH {EV} SELECT track_id::VARCHAR AS source_id, CASE WHEN is_key THEN 'video' ELSE 'audio' END AS kind, floor((pts // 1000 % 80000000 * 90) * 100 / 9::DOUBLE + 0.5)::BIGINT AS pts_us, (size % 50 + 1)::BIGINT AS size FROM ev")
def _(spark, d):
    ticks, n = F.expr("pts_us div 1000 % 80000000 * 90"), F.col("size") % 50 + 1
    pes = F.concat(F.lit(b"\0\0\1"), F.when(F.col("is_key"), F.lit(b"\xe0")).otherwise(F.lit(b"\xc0")), W.be(n + 8, 2), F.lit(b"\x80\x80\x05"), W.stamp33(ticks), F.unhex(F.repeat(F.lit("AB"), n.cast("int"))))
    pack = F.when(F.col("k") % 5 == 0, F.lit(b"\0\0\1\xba\x44\0\4\0\4\1\0\0\3\xf8")).otherwise(F.lit(b""))
    out = transport.ps_packets(files(parts(spark, d).withColumn("packet", F.concat(pack, pes)), "packet"))
    return out.select(track(), "kind", "pts_us", "size")


def _padded(payload: Column, pid: Column | int, start: Column | bool) -> Column:
    """A transport packet that is filled up to 188 bytes by its adaptation field."""
    fill = 183 - F.length(payload)
    number = (F.lit(pid) if isinstance(pid, int) else pid) + F.when(F.lit(start) if isinstance(start, bool) else start, 0x4000).otherwise(0)
    field = F.concat(W.be(fill, 1), F.when(fill > 0, F.concat(F.lit(b"\0"), F.unhex(F.repeat(F.lit("FF"), F.greatest(F.lit(0), fill - 1))))).otherwise(F.lit(b"")))
    return F.concat(F.lit(b"\x47"), W.be(number, 2), F.lit(b"\x30"), field, payload)


_SECOND = "CASE track_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 17 ELSE 6 END"


@query("q_program_map", f"""WITH {EV}, s AS (SELECT *, CASE WHEN is_key THEN CASE WHEN track_id % 2 = 0 THEN 27 ELSE 36 END ELSE {_SECOND} END AS t FROM ev)
SELECT track_id::VARCHAR AS source_id, CASE WHEN is_key THEN 257 ELSE 258 END::BIGINT AS pid, t::BIGINT AS stream_type, CASE t WHEN 27 THEN 'H.264 (AVC)' WHEN 36 THEN 'HEVC (H.265)' WHEN 15 THEN 'AAC (ADTS)' WHEN 17 THEN 'AAC (LATM)' ELSE 'PES private data' END AS stream_name,
  CASE t WHEN 27 THEN 'h264' WHEN 36 THEN 'h265' WHEN 6 THEN NULL ELSE 'aac' END AS codec, floor((pts // 1000 % 80000000 * 90) * 100 / 9::DOUBLE + 0.5)::BIGINT AS pts_us FROM s""")
def _(spark, d):
    """Packets with the stream that the program map says they are; one byte too many stands before every seventh packet after the first ten."""
    key, ticks = F.col("is_key"), F.expr("pts_us div 1000 % 80000000 * 90")
    table_ = lambda body: F.concat(F.lit(b"\0"), body, F.lit(bytes(4)))
    pat = table_(F.lit(b"\0\xb0\x0d\0\1\xc1\0\0\0\1\xe1\0"))
    types = W.be(F.when(F.col("track_id") % 2 == 0, 27).otherwise(36), 1), W.be(F.expr(_SECOND), 1)
    pmt = table_(F.concat(F.lit(b"\2\xb0\x19\0\1\xc1\0\0\xe1\1\xf0\0"), types[0], F.lit(b"\xe1\1\xf0\0"), types[1], F.lit(b"\xe1\2\xf0\2\x0a\0")))
    tables = F.concat(_padded(pat, 0, True), _padded(pmt, 256, True))
    pes = F.concat(F.lit(b"\0\0\1"), F.when(key, F.lit(b"\xe0")).otherwise(F.lit(b"\xc0")), F.lit(b"\0\0\x80\x80\5"), W.stamp33(ticks), F.lit(b"data"))
    packet = F.concat(F.when(F.col("k") == 0, tables).when((F.col("k") > 10) & (F.col("k") % 7 == 0), F.lit(b"\xff")).otherwise(F.lit(b"")), _padded(pes, F.when(key, 257).otherwise(258), True))
    rows = flows.Walk(files(parts(spark, d).withColumn("packet", packet), "packet"), ("mpegts",)).rows
    told = transport.streams(flows.sections_of(rows)).select("source_id", F.col("pid").alias("track"), "stream_type", "stream_name", "codec")
    pes = M.pes_times(rows.where("what = 'pes'")).join(told, ["source_id", "track"])
    return pes.select(track(), F.col("track").alias("pid"), "stream_type", "stream_name", "codec", "pts_us")


@query("q_track_spans", f"WITH {EV} SELECT track_id::VARCHAR AS source_id, CASE WHEN is_key THEN 257 ELSE 258 END::BIGINT AS pid, count(*) AS n, CASE WHEN count(*) >= 2 THEN max(pts) - min(pts) END AS duration_us FROM ev GROUP BY ALL")
def _(spark, d):
    rows = ev(spark, d).select(F.col("track_id").cast("string").alias("source_id"), F.when(F.col("is_key"), 257).otherwise(258).cast("long").alias("pid"), "pts_us")
    return transport.track_spans(rows)


@query("q_access_units", f"WITH {EV} SELECT track_id::VARCHAR AS source_id, idx, CASE WHEN is_key THEN 'I' ELSE 'P' END AS picture_type, is_key AS is_idr FROM ev")
def _(spark, d):
    """Each sample as an access unit in transport packets: a delimiter, parameter sets before key pictures, then slices."""
    key = F.col("is_key")
    body = F.concat(F.lit(b"\0\0\0\1\x09\xf0"), F.when(key, F.lit(b"\0\0\0\1\x67\x42\xc0\x1e\0\0\0\1\x68\xce")).otherwise(F.lit(b"")), F.lit(b"\0\0\1"), F.when(key, F.lit(b"\x65")).otherwise(F.lit(b"\x41")), F.unhex(F.repeat(F.lit("AB"), (F.col("size") % 20 + 1).cast("int"))), F.lit(b"\0\0\1\x01\xaa"))
    pes = F.concat(F.lit(b"\0\0\1\xe0\0\0\x80\x80\5"), W.stamp33(F.col("k") * 3000), body)
    rows = M.ts_pes(M.ts_packets(files(parts(spark, d).withColumn("packet", _padded(pes, 257, True)), "packet")), with_data=True)
    found = transport.access_units(transport.numbered_units(rows, N.annexb_nals), "h264")
    known = parts(spark, d).select(F.concat_ws(":", "track_id", "part").alias("source_id"), "k", F.col("index").alias("idx"))
    return found.withColumnRenamed("index", "k").join(known, ["source_id", "k"]).select(track(), "idx", "picture_type", "is_idr")


@query("q_first_configs", f"""WITH {EV}, k AS (SELECT track_id, arg_min(size, idx) AS size FROM ev WHERE is_key GROUP BY track_id), h AS (SELECT track_id, lower(hex(encode(lpad(size::VARCHAR, 8, '0')))) AS h FROM k)
SELECT track_id::VARCHAR AS source_id, '01' || '42c0' || '1e' || 'ffe1' || '000c' || '6742c01e' || h || '010002' || '68ce' AS config FROM h""")
def _(spark, d):
    """The decoder configuration of the first parameter sets of each track."""
    text = F.encode(F.lpad(F.col("size").cast("string"), 8, "0"), "utf-8")
    body = F.concat(F.lit(b"\0\0\0\1\x67\x42\xc0\x1e"), text, F.lit(b"\xff\0\0\0\1\x68\xce\0\0\0\1\x65\xaa"))
    rows = ev(spark, d).where("is_key").select(F.col("track_id").cast("string").alias("source_id"), F.lit(257).alias("pid"), "index", body.alias("data"))
    units = transport.numbered_units(rows, N.annexb_nals)
    cut = F.when(N.h264_nal_type(F.col("unit")) == 7, F.substring("unit", 1, 12)).otherwise(F.col("unit"))
    sets = transport.first_configs(units.withColumn("unit", cut))
    none = F.lit(None).cast("binary")
    config = mp4.inferred_config(F.lit("h264"), none, F.col("sps"), F.col("pps"), none, none, F.lit(48000), F.lit(2))
    return sets.select("source_id", F.lower(F.hex(config)).alias("config"))


# --- bits

@query("q_exp_golomb", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey::BIGINT AS a, (l_suppkey - 50)::BIGINT AS b, l_linenumber::BIGINT AS c, (l_quantity * 1000)::BIGINT AS d FROM lineitem")
def _(spark, d):
    """Numbers written as Exp-Golomb codes and plain bits, with emulation prevention, and read again."""
    quantity = (F.col("l_quantity") * 1000).cast("long")
    text = F.concat(W.ue_bits(F.col("l_partkey")), W.se_bits(F.col("l_suppkey") - 50), F.lpad(F.bin(F.col("l_linenumber").cast("long")), 5, "0"), W.ue_bits(quantity), F.lit("1"))
    unit = N.with_emulation_prevention(W.bits_to_bytes(text))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bits.header(unit, [("a", "ue"), ("b", "se"), ("c", 5), ("d", "ue")]).alias("f"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.col("f")[k].alias(k) for k in "abcd"])


_SPS_SQL = """WITH r AS (SELECT p_partkey, p_size, p_partkey % 3 AS form, p_partkey % 120 AS w, p_size AS h, p_size % 4 AS crop FROM part)"""


@query("q_sps_size", f"""{_SPS_SQL} SELECT p_partkey, ((w + 1) * 16 - crop * 2)::BIGINT AS width, CASE WHEN form = 2 THEN (h + 1) * 32 - 4 * crop ELSE (h + 1) * 16 - 2 * crop END::BIGINT AS height,
  CASE form WHEN 0 THEN 'High' ELSE 'Main' END AS profile, 'Level 4.0' AS level, CASE WHEN form < 2 THEN 60000 / (2.0 * (1000 + p_size))::DOUBLE END AS fps FROM r""")
def _(spark, d):
    """Sequence parameter sets of three forms: with chroma and timing, with timing, and interlaced without either."""
    form, ue = F.col("p_partkey") % 3, lambda x: W.ue_bits(F.lit(x).cast("long") if isinstance(x, int) else x.cast("long"))
    high = F.when(form == 0, F.concat(ue(1), ue(0), ue(0), F.lit("00"))).otherwise(F.lit(""))
    lines = F.when(form == 2, F.lit("00")).otherwise(F.lit("1"))
    crop = F.col("p_size") % 4
    timing = F.concat(F.lit("1" + "0000" + "1"), F.lpad(F.bin(F.col("p_size").cast("long") + 1000), 32, "0"), F.lit(f"{60000:032b}" + "1" + "000" + "0"))
    text = F.concat(
        F.lit("01100111"), F.when(form == 0, F.lit(f"{100:08b}")).otherwise(F.lit(f"{77:08b}")), F.lit("00000000" + f"{40:08b}"), ue(0), high, ue(0), ue(0), ue(2), ue(4), F.lit("0"),
        ue(F.col("p_partkey") % 120), ue(F.col("p_size")), lines, F.lit("1"), F.lit("1"), ue(0), ue(crop), ue(0), ue(crop), F.when(form < 2, timing).otherwise(F.lit("0")), F.lit("1"),
    )
    unit = N.with_emulation_prevention(W.bits_to_bytes(text))
    rows = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", bits.header(unit, "h264_sps", ("width", "height", "profile_idc", "level_idc", *bits.TIMING)).alias("f"))
    return rows.select("p_partkey", F.col("f")["width"].alias("width"), F.col("f")["height"].alias("height"), names.avc_profile(F.col("f")["profile_idc"]).alias("profile"), names.level(F.col("f")["level_idc"]).alias("level"), bits.frame_rate(F.col("f")).alias("fps"))


@query("q_hevc_sps_size", """SELECT p_partkey, ((p_partkey % 500 + 8) * 8 - 2 * (p_size % 4))::BIGINT AS width, ((p_size + 8) * 8 - 2 * (p_size % 3))::BIGINT AS height, 'Main' AS profile, 'High' AS tier, 'Level 5.0' AS level, (8 + p_size % 3)::BIGINT AS depth,
  60000 / (1000 + p_size)::DOUBLE AS fps, (p_size % 3)::BIGINT AS negative FROM part""")
def _(spark, d):
    ue = lambda x: W.ue_bits(F.lit(x).cast("long") if isinstance(x, int) else x.cast("long"))
    size, key = F.col("p_size"), F.col("p_partkey")
    profile = F.lit("00" + "1" + f"{1:05b}" + "01" + "0" * 30 + "1001" + "0" * 43 + "0" + f"{150:08b}")
    sets = F.concat(ue(1), ue(size % 3), ue(1), F.when(size % 3 > 0, F.repeat(F.concat(ue(0), F.lit("1")), (size % 3).cast("int"))).otherwise(F.lit("")), ue(2), F.lit("0"))
    timing = F.concat(F.lit("0000" + "000" + "0" + "1"), F.lpad(F.bin(size.cast("long") + 1000), 32, "0"), F.lit(f"{60000:032b}" + "0" + "0"))
    text = F.concat(
        F.lit("0" + f"{33:06b}" + "000000" + "001" + "0000" + "000" + "1"), profile, ue(0), ue(1), ue((key % 500 + 8) * 8), ue((size + 8) * 8), F.lit("1"), ue(0), ue(size % 4), ue(0), ue(size % 3),
        ue(size % 3), ue(0), ue(4), F.lit("1"), ue(4), ue(0), ue(0), ue(0), ue(3), ue(0), ue(3), ue(1), ue(1), F.lit("0" + "1" + "1" + "0"), sets, F.lit("0" + "1" + "1" + "1"), timing, F.lit("01"),
    )
    unit = N.with_emulation_prevention(W.bits_to_bytes(text))
    asked = ("width", "height", "general_profile_idc", "general_tier_flag", "general_level_idc", "bit_depth_luma_minus8", "short_term_ref_pic_set[0].num_negative_pics", *bits.TIMING)
    rows = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", bits.header(unit, "h265_sps", asked).alias("f"))
    f = lambda k: F.col("f")[k]
    return rows.select(
        "p_partkey", f("width").alias("width"), f("height").alias("height"), names.named(f("general_profile_idc"), names.HEVC_PROFILES).alias("profile"), names.named(f("general_tier_flag"), names.HEVC_TIERS).alias("tier"),
        names.level(f("general_level_idc"), 30).alias("level"), (f("bit_depth_luma_minus8") + 8).alias("depth"), bits.frame_rate(F.col("f"), "h265").alias("fps"), f("short_term_ref_pic_set[0].num_negative_pics").alias("negative"),
    )


@query("q_slice_header", """SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber % 10)::BIGINT AS slice_type, CASE l_linenumber % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'B' WHEN 2 THEN 'I' WHEN 3 THEN 'SP' ELSE 'SI' END AS picture, (l_partkey % 256)::BIGINT AS frame_num,
  (l_suppkey % 64)::BIGINT AS poc, (l_linenumber - 4)::BIGINT AS qp FROM lineitem""")
def _(spark, d):
    """Slice headers of all five kinds under one pair of parameter sets."""
    n, ue = F.col("l_linenumber"), lambda x: W.ue_bits(F.lit(x).cast("long") if isinstance(x, int) else x.cast("long"))
    kind = n % 5
    bit = lambda cond, text: F.when(cond, F.lit(text)).otherwise(F.lit(""))
    text = F.concat(
        F.lit("00100001"), ue(0), ue(n % 10), ue(0), F.lpad(F.bin(F.col("l_partkey") % 256), 8, "0"), F.lpad(F.bin(F.col("l_suppkey") % 64), 6, "0"), bit(kind == 1, "1"), bit(kind.isin(0, 1, 3), "0"),
        bit(kind.isin(0, 1, 3), "0"), bit(kind == 1, "0"), F.lit("0"), bit(kind.isin(0, 1, 3), "1"), W.se_bits(n - 4), bit(kind == 3, "0"), F.when(kind >= 3, W.se_bits(n - 2)).otherwise(F.lit("")), ue(1), F.lit("1"),
    )
    number = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    sps = number({"pic_order_cnt_type": 0, "log2_max_frame_num_minus4": 4, "log2_max_pic_order_cnt_lsb_minus4": 2, "frame_mbs_only_flag": 1})
    pps = number({"entropy_coding_mode_flag": 1, "deblocking_filter_control_present_flag": 1})
    unit = N.with_emulation_prevention(W.bits_to_bytes(text))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bits.slice_header(unit, sps, pps).alias("f"))
    f = lambda k: F.col("f")[k]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", f("slice_type").alias("slice_type"), B.picture_of_slice("h264", f("slice_type")).alias("picture"), f("frame_num").alias("frame_num"), f("pic_order_cnt_lsb").alias("poc"), f("slice_qp_delta").alias("qp"))


@query("q_active_sets", f"""WITH {EV}, u AS (SELECT track_id, idx, size, CASE WHEN is_key THEN 'sps' WHEN is_target THEN 'pps' ELSE 'slice' END AS kind, CASE WHEN is_key THEN size % 2 ELSE size % 3 END AS n FROM ev),
p AS (SELECT *, last_value(CASE WHEN kind = 'pps' THEN size // 3 % 2 END IGNORE NULLS) OVER (PARTITION BY track_id, n ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seq FROM u WHERE kind <> 'sps'),
b AS (SELECT track_id, idx, kind, n AS seq, size FROM u WHERE kind = 'sps' UNION ALL SELECT track_id, idx, kind, seq, size FROM p WHERE kind = 'slice'),
s AS (SELECT *, last_value(CASE WHEN kind = 'sps' THEN 4 + size % 9 END IGNORE NULLS) OVER (PARTITION BY track_id, seq ORDER BY idx ROWS UNBOUNDED PRECEDING) AS bits FROM b)
SELECT track_id, idx, CASE WHEN seq IS NOT NULL THEN (size % 4096) >> (12 - bits)::INT END::BIGINT AS frame_num FROM s WHERE kind = 'slice'""")
def _(spark, d):
    """Streams in which two sequence sets and three picture sets come again and again with other contents; each slice is read under those it has at its place."""
    size, ue = F.col("size"), lambda x: W.ue_bits(F.lit(x).cast("long") if isinstance(x, int) else x.cast("long"))
    sps = F.concat(F.lit(f"{0x67:08b}{77:08b}{0:08b}{30:08b}"), ue(size % 2), ue(size % 9), ue(2), ue(1), F.lit("0"), ue(19), ue(10), F.lit("11001"))
    pps = F.concat(F.lit(f"{0x68:08b}"), ue(size % 3), ue(F.expr("size div 3 % 2")), F.lit("00" + "1" * 3 + "000" + "111" + "000" + "1"))
    slice_ = F.concat(F.lit(f"{0x41:08b}" + "11"), ue(size % 3), F.lpad(F.bin(size % 4096), 12, "0"), F.lit("0001"))
    unit = F.when(F.col("is_key"), sps).when(F.col("is_target"), pps).otherwise(slice_)
    units = ev(spark, d).select("track_id", F.col("index").alias("idx"), N.with_emulation_prevention(W.bits_to_bytes(unit)).alias("unit"))
    slices = bits.with_active_sets(units, ["track_id"], ["idx"])
    return slices.select("track_id", "idx", bits.slice_header(F.col("unit"), F.col("sps"), F.col("pps")).alias("f"), "sps").select("track_id", "idx", F.when(F.col("sps").isNotNull(), F.col("f")["frame_num"]).alias("frame_num"))


@query("q_sei_messages", r"""WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, 5::BIGINT AS type, (16 + n)::BIGINT AS size, regexp_replace(m, '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') AS uuid, false AS captions FROM t
UNION ALL SELECT doc_id, 4, 11, NULL, true FROM t""")
def _(spark, d):
    """Two messages a document: its text under the id of its digest, and a caption marker; texts whole."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    size = F.length(text) + 16
    length = F.concat(F.unhex(F.repeat(F.lit("FF"), F.floor(size / 255).cast("int"))), W.be(size % 255, 1))
    unit = F.concat(F.lit(b"\6"), N.with_emulation_prevention(F.concat(F.lit(b"\5"), length, F.unhex(F.md5(text)), text, F.lit(b"\4\x0b\xb5\0\x31GA94\1\2\3\4"))), F.lit(b"\x80"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(bits.sei_messages(unit)).alias("m"))
    found = bits.sei_fields(F.col("m.type"), F.col("m.payload"))
    return rows.select("doc_id", "m.type", "m.size", found.alias("x")).select("doc_id", "type", "size", "x.uuid", "x.captions")


# --- units

_PIECES = "regexp_extract_all(regexp_replace(coalesce(text, ''), '[^a-z ]', 'x', 'g'), '.{1,20}')"


def pieces(spark, d) -> DataFrame:
    """The units of each text: its pieces of 20 characters; none for null and empty texts."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", "x")
    units = F.transform(F.regexp_extract_all(t, F.lit("(.{1,20})"), 1), lambda p: F.encode(p, "utf-8"))
    return table(spark, d, "documents").select("doc_id", units.alias("units"))


@query("q_avcc_to_annexb", f"WITH u AS (SELECT doc_id, {_PIECES} AS u FROM documents) SELECT doc_id, CASE WHEN len(u) > 0 THEN md5(array_to_string(list_transform(u, lambda x: '00000001' || lower(hex(encode(x)))), '')) END AS codes, CASE WHEN len(u) > 0 THEN md5(array_to_string(list_transform(u, lambda x: printf('%08x', len(x)) || lower(hex(encode(x)))), '')) END AS lengths FROM u")
def _(spark, d):
    """Packets with lengths made ones with start codes, and back."""
    from .operators import packets as K

    lit = F.lit
    rows = pieces(spark, d).select("doc_id", N.length_prefixed(F.col("units")).alias("data"))
    rows = rows.withColumn("codes", K.adapted(F.col("data"), lit("avcc"), lit("annexb"))).withColumn("lengths", K.adapted(F.col("codes"), lit("annexb"), lit("avcc")))
    return rows.select("doc_id", *[F.md5(F.lower(F.hex(k))).alias(k) for k in ("codes", "lengths")])


@query("q_unit_rows", f"""WITH u AS (SELECT doc_id, {_PIECES} AS u FROM documents), e AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS n FROM u)
SELECT doc_id, n::BIGINT AS n, (ascii(x) & 31)::BIGINT AS kind, lower(hex(encode(x))) AS payload FROM e""")
def _(spark, d):
    rows = pieces(spark, d).select("doc_id", N.length_prefixed(F.col("units"), 2).alias("data"))
    return N.unit_rows(rows, "data", size=2).select("doc_id", F.col("n").cast("long").alias("n"), F.col("kind").cast("long").alias("kind"), F.lower(F.hex("payload")).alias("payload"))


@query("q_strict_split", f"WITH u AS (SELECT doc_id, {_PIECES} AS u FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND len(u) > 0 THEN len(u) END::BIGINT AS strict, len(u)::BIGINT AS loose FROM u")
def _(spark, d):
    """A stray byte after every second packet makes the strict split give none."""
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit(b"")).otherwise(F.lit(b"\0"))
    data = F.concat(F.coalesce(N.length_prefixed(F.col("units")), F.lit(b"")), tail)
    count = lambda strict: F.size(N.units_of_lengths(F.col("data"), 4, strict)).cast("long")
    rows = pieces(spark, d).select("doc_id", data.alias("data")).select("doc_id", N.units_of_lengths(F.col("data"), 4, True).alias("s"), count(False).alias("loose"))
    return rows.select("doc_id", F.when(F.col("s").isNotNull(), F.size("s")).cast("long").alias("strict"), "loose")


@query("q_emulation_prevention", """WITH r AS (SELECT o_orderkey, printf('%016x', o_orderkey) AS h FROM orders) SELECT o_orderkey, h AS payload, o_orderkey < 281474976710656 AS longer FROM r""")
def _(spark, d):
    """Numbers with many zero bytes, escaped and restored; the header byte stays as it is."""
    raw = W.be(F.col("o_orderkey"), 8)
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(b"\x67"), N.with_emulation_prevention(raw)).alias("unit"))
    restored = N.with_header(F.col("unit"), 1)
    return rows.select("o_orderkey", F.lower(F.hex(F.substring(restored, 2, 8))).alias("payload"), (F.length("unit") > 9).alias("longer"))


# --- FLV script and sound

def scripted(spark, d) -> DataFrame:
    """FLV files with two script tags (of which the second wins) and one packet of sound, for each part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = lambda k: F.lit(len(k).to_bytes(2, "big") + k.encode())
    number = lambda k, x: F.concat(name(k), F.lit(b"\0"), W.double_be(x.cast("double")))
    event = F.lit(b"\2\0\x0aonMetaData\x08\0\0\0\3")
    first = F.concat(event, number("audiosamplerate", key * 0 + 1), F.lit(b"\0\0\x09"))
    stereo = F.concat(name("stereo"), F.lit(b"\1"), F.when(size % 2 == 0, F.lit(b"\1")).otherwise(F.lit(b"\0")))
    title = F.concat(name("title"), F.lit(b"\2"), W.be(F.octet_length("p_name"), 2), F.encode("p_name", "utf-8"))
    second = F.concat(event, number("audiosamplerate", 8000 + key), stereo, title, number("offset", -(size / 4)), F.lit(b"\0\0\x09"))
    tag = lambda kind, body: F.concat(F.lit(bytes([kind])), W.be(F.length(body), 3), F.lit(bytes(7)), body, W.be(F.length(body) + 11, 4))
    sound = F.when(key % 3 == 0, F.lit(b"\x2f\xff\xfb\x90\xc0" + bytes(8))).when(key % 3 == 1, F.lit(b"\x7f\xd5\xd5")).otherwise(F.lit(b"\xaf\1\x21"))
    data = F.concat(F.lit(b"FLV\1\5\0\0\0\x09\0\0\0\0"), *[tag(kind, F.col(body)) for kind, body in ((18, "first"), (18, "second"), (8, "sound"))])
    rows = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size"))
    bodies = rows.select(key.cast("string").alias("source_id"), first.alias("first"), second.alias("second"), sound.alias("sound"))
    return bodies.select("source_id", data.alias("data"))


@query("q_script_values", """SELECT p_partkey::VARCHAR AS source_id, unnest(['audiosamplerate', 'stereo', 'title', 'offset']) AS key, unnest([(8000 + p_partkey)::DOUBLE, (p_size % 2 = 0)::INT::DOUBLE, NULL, -(p_size / 4.0)::DOUBLE]) AS number, unnest([NULL, NULL, p_name, NULL]) AS text FROM part""")
def _(spark, d):
    return flv.script_values(scripted(spark, d))


@query("q_flv_audio", """SELECT p_partkey::VARCHAR AS source_id, CASE p_partkey % 3 WHEN 0 THEN 'mp3' WHEN 1 THEN 'g711' ELSE 'aac' END AS codec, CASE p_partkey % 3 WHEN 0 THEN 44100 WHEN 1 THEN 8000 ELSE 8000 + p_partkey END::BIGINT AS rate,
  CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END END::BIGINT AS channels FROM part""")
def _(spark, d):
    """MP3 by its frame, G.711 by definition, AAC without configuration by the script."""
    return flv.audio_streams(scripted(spark, d)).select("source_id", "codec", F.col("rate").cast("long").alias("rate"), F.col("channels").cast("long").alias("channels"))


@query("q_flv_header", "SELECT p_partkey::VARCHAR AS source_id, 1::BIGINT AS version, true AS has_audio, true AS has_video, 9::BIGINT AS data_offset FROM part")
def _(spark, d):
    return flv.headers(scripted(spark, d))


# --- MP4

def movies(spark, d) -> tuple[DataFrame, DataFrame]:
    """(samples, tracks): a movie for each track of events, key and target samples as pictures and the rest as sound; times run a thousandth as fast."""
    video = F.col("is_key") | F.col("is_target")
    rows = ev(spark, d).withColumns({"file_id": F.col("track_id").cast("string"), "track_id": F.when(video, "v").otherwise("a"), "dts_us": F.expr("pts_us div 1000")})
    rows = rows.withColumns({"pts_us": F.when(F.col("is_key"), F.col("dts_us") + 40_000).otherwise(F.col("dts_us")), "data": F.unhex(F.repeat(F.lit("AB"), (F.col("size") % 50 + 1).cast("int")))})
    config = F.when(F.col("track_id") == "v", F.lit(bytes.fromhex("0142c01effe1000467 42c01e01000268ce".replace(" ", "")))).otherwise(F.lit(b"\x12\x10"))
    tracks = rows.select("file_id", "track_id").distinct().select(
        "file_id", "track_id", F.when(F.col("track_id") == "v", "video").otherwise("audio").alias("kind"), F.when(F.col("track_id") == "v", "h264").otherwise("aac").alias("codec"), config.alias("config"),
        F.lit(320).alias("width"), F.lit(180).alias("height"), F.lit(44100).alias("rate"), F.lit(2).alias("channels"),
    )
    return rows, tracks


_MOVIE = f"""WITH {EV}, r AS (SELECT track_id, idx, is_key, CASE WHEN is_key OR is_target THEN 'video' ELSE 'audio' END AS kind, pts // 1000 AS dts, pts // 1000 + CASE WHEN is_key THEN 40000 ELSE 0 END AS pts, size % 50 + 1 AS n FROM ev),
t AS (SELECT *, floor(dts * CASE kind WHEN 'video' THEN 90000 ELSE 44100 END / 1000000::DOUBLE + 0.5)::BIGINT AS d, floor(pts * CASE kind WHEN 'video' THEN 90000 ELSE 44100 END / 1000000::DOUBLE + 0.5)::BIGINT AS p FROM r),
g AS (SELECT *, row_number() OVER w - 1 AS sample, greatest(1, coalesce(lead(d) OVER w - d, d - lag(d) OVER w, 1)) AS delta FROM t WINDOW w AS (PARTITION BY track_id, kind ORDER BY dts, idx))"""


@query("q_mp4_roundtrip", f"""{_MOVIE}, k AS (SELECT track_id, count(*) FILTER (is_key) AS keys, count(*) AS all_ FROM g WHERE kind = 'video' GROUP BY track_id)
SELECT g.track_id::VARCHAR AS source_id, kind, sample, n::BIGINT AS size, coalesce(sum(delta) OVER (PARTITION BY g.track_id, kind ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dts, p - d AS shift,
  CASE WHEN kind = 'audio' OR keys = 0 THEN true ELSE is_key END AS is_key, n::BIGINT AS good FROM g LEFT JOIN k ON k.track_id = g.track_id""")
def _(spark, d):
    """Movies written and read again by one walk: times, offsets and key flags, and how many bytes at each place are those that were written."""
    made = mp4.mux(*movies(spark, d)).select(F.col("file_id").alias("source_id"), "data")
    rows = walk.files(made, ("mp4",), with_data=True).where("what = 'sample'")
    good = F.length(F.regexp_replace(F.hex("data"), "[^AB]", "")) / 2
    return rows.select("source_id", "kind", F.col("index").alias("sample"), "size", F.col("ticks").alias("dts"), "shift", "is_key", good.cast("long").alias("good"))


@query("q_mp4_tracks", f"""{_MOVIE} SELECT DISTINCT track_id::VARCHAR AS source_id, kind, dense_rank() OVER (PARTITION BY track_id ORDER BY kind DESC)::BIGINT AS track_id, CASE kind WHEN 'video' THEN 'avc1' ELSE 'mp4a' END AS entry,
  CASE kind WHEN 'video' THEN 320 END::BIGINT AS width, CASE kind WHEN 'audio' THEN 44100 END::BIGINT AS rate, CASE kind WHEN 'audio' THEN 2 END::BIGINT AS channels, sum(delta) OVER (PARTITION BY track_id, kind)::BIGINT AS duration FROM g""")
def _(spark, d):
    made = mp4.mux(*movies(spark, d)).select(F.col("file_id").alias("source_id"), "data")
    rows = mp4.track_headers(M.mp4_boxes(made))
    return rows.select("source_id", "kind", "track_id", F.coalesce("v", "a").alias("entry"), "width", "rate", "channels", "duration")


@query("q_movie_summary", f"{_MOVIE} SELECT track_id::VARCHAR AS source_id, count(DISTINCT kind) AS n_tracks, count(DISTINCT kind) FILTER (kind = 'video') AS n_video, count(DISTINCT kind) FILTER (kind = 'audio') AS n_audio FROM g GROUP BY track_id")
def _(spark, d):
    made = mp4.mux(*movies(spark, d)).select(F.col("file_id").alias("source_id"), "data")
    return mp4.movie_summary(M.mp4_boxes(made)).select("source_id", "n_tracks", "n_video", "n_audio")


@query("q_mux_errors", """WITH t AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'video' ELSE 'audio' END AS kind, (['h264', 'h265', 'aac', 'mp3', 'g711'])[(p_partkey % 5 + 1)::INT] AS codec, p_size % 4 > 0 AS has FROM part)
SELECT p_partkey::VARCHAR AS source_id, 'mux.unsupported' AS code FROM t WHERE CASE WHEN kind = 'video' THEN codec <> 'h264' OR NOT has WHEN codec = 'g711' THEN true ELSE NOT has AND codec <> 'mp3' END""")
def _(spark, d):
    codec = F.element_at(F.array(*[F.lit(x) for x in ("h264", "h265", "aac", "mp3", "g711")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    tracks = table(spark, d, "part").select(
        F.col("p_partkey").alias("track_id"), F.when(F.col("p_size") % 3 == 0, "video").otherwise("audio").alias("kind"), codec.alias("codec"), F.when(F.col("p_size") % 4 > 0, F.lit(b"\x12\x10")).alias("config"), F.lit(44100).alias("rate"), F.lit(2).alias("channels")
    )
    return mp4.mux_errors(tracks).select("source_id", "code")
