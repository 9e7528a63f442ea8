"""Queries that run over all rows and whole texts, against plain Python."""

import datetime
import random
import re
from collections import Counter

from tracklake import catalog


def test_flv_writes_every_event(spark, tmp_path):
    """Long gaps, sizes that are multiples of 50 and events before their track's first."""
    day, first = datetime.timedelta(days=1), datetime.datetime(2024, 1, 1)
    rows = [(1, i, first + k * day, "signup" if i % 3 == 0 else "view", i / 100) for i, k in enumerate((0, 1, 13, 24, 25, 26, 60, 3, -2))]
    rows += [(2, 50, first, "view", 0.5), (2, 100, first + 30 * day, "signup", 1.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    starts = {1: first, 2: first}
    expected = Counter((str(u), (ts - starts[u]) // datetime.timedelta(microseconds=1), kind == "signup", int(value * 100 + 0.5) % 50 + 1) for u, _, ts, kind, value in rows)
    got = catalog.QUERIES["q_flv_roundtrip"](spark, str(tmp_path)).collect()
    assert Counter((r.source_id, r.pts_us, r.is_key, r["size"]) for r in got) == expected


def test_bytes_of_whole_texts(spark, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é\nZ€😀") for _ in range(n)) for n in (1, 2, 19, 20, 21, 40, 41, 63, 64, 65, 400, 9000)] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: {r.doc_id: r for r in catalog.QUERIES[f"q_{name}"](spark, str(tmp_path)).collect()} for name in ("g711_ulaw", "annexb_split", "length_prefix", "adts_strip")}

    def linear(c):
        c ^= 255
        size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
        return -size if c & 128 else size

    assert (linear(0), linear(128), linear(255)) == (-32124, 32124, 0)
    for i, text in enumerate(texts):
        data, t = (text or "").encode(), re.sub("[^a-z ]", "x", text or "")
        assert got["g711_ulaw"][i].total == sum(map(linear, data))
        units = [t[k : k + 20].encode().hex() for k in range(0, len(t), 20)]
        assert (got["annexb_split"][i].n_units, got["annexb_split"][i].units) == (len(units), units)
        assert got["length_prefix"][i].data == ((len(t).to_bytes(4, "big") + t.encode()).hex() if t else None)
        head, skip = (b"\xff\xf1\x50\x80\x00\x00\xfc", 0) if i % 2 == 0 else (b"\xff\xf0\x50\x80\x00\x00\xfc", 2)
        assert got["adts_strip"][i].raw == (data[skip:] if len(data) > skip else head + data).hex()


def test_pictures_and_pages_whole(spark, tmp_path):
    texts = ["", None, "é" * 100, "a" * 256, "b" * 257, "€😀\n" * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.doc_id, r.picture): r.y for r in catalog.QUERIES["q_nv12_to_i420"](spark, str(tmp_path)).collect()}
    whole = {i: (t or "").encode() for i, t in enumerate(texts)}
    assert {k: max(p for i, p in got if i == k) + 1 for k in whole} == {i: max(1, -(-len(b) // 256)) for i, b in whole.items()}
    for (i, p), y in got.items():
        data = whole[i][256 * p : 256 * p + 256].ljust(256, b"\0")
        assert y == b"".join(data[32 * r : 32 * r + 7] for r in range(5)).hex()
    shown = {r.page_id: r.n for r in catalog.QUERIES["q_printable"](spark, str(tmp_path)).collect()}
    assert shown == {i: None if t is None else len(whole[i]) for i, t in enumerate(texts)}
