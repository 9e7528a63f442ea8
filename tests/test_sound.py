"""Clips in many rows against the same clips as one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import pcm as P
from tracklake.operators import sound

rng = np.random.default_rng(4)
CLIPS = {"a": rng.standard_normal(5000), "b": rng.standard_normal(37), None: rng.standard_normal(700), "c": rng.standard_normal(1)}


def blocks(spark, seed=0):
    cuts, rows = np.random.default_rng(seed), []
    for name, x in CLIPS.items():
        at = 0
        for place in range(1000):
            n = int(cuts.integers(0, 150))
            if at < len(x):
                rows.append((name, place * 3, x[at : at + n].tolist() if n else cuts.choice([None, 0]) and []))
                at += n
    rows.append(("empty", 0, []))
    return spark.createDataFrame(rows, "clip string, place long, samples array<double>").repartition(5)


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.place):
        out.setdefault(r.clip, []).extend(r.samples or [])
    return out


def loop(x, b, a):
    y, out = [0.0, 0.0], []
    past = [0.0, 0.0]
    for v in x:
        now = b[0] * v + b[1] * past[0] + b[2] * past[1] - a[1] * y[0] - a[2] * y[1]
        past, y = [v, past[0]], [now, y[0]]
        out.append(now)
    return out


@pytest.mark.parametrize(("kind", "frequency", "q"), [("lowpass", 300.0, 1.0), ("peaking", 2000.0, 5.0), ("lowpass", 20.0, 30.0)])
def test_filters_over_many_rows(spark, kind, frequency, q):
    b, a = P.biquad(kind, frequency, 8000, q)
    got = joined(sound.filtered_clips(blocks(spark), b, a))
    assert set(got) == {*CLIPS, "empty"}
    for name, x in CLIPS.items():
        assert np.allclose(got[name], loop(x, b, a), rtol=1e-8, atol=1e-9)


def plain_spectrum(x, size, hop, smoothing):
    out, now = [], np.zeros(size // 2)
    i = np.arange(size)
    shape = 0.42 - 0.5 * np.cos(2 * np.pi * i / size) + 0.08 * np.cos(4 * np.pi * i / size)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size // 2), i) / size)
    for at in range(0, len(x) - size + 1, hop):
        now = smoothing * now + (1 - smoothing) * np.abs(turn @ (x[at : at + size] * shape)) / size
        out.append(now)
    return out


@pytest.mark.parametrize(("size", "hop", "smoothing"), [(32, 16, 0.0), (64, 80, 0.0), (128, 7, 0.0), (32, 16, 0.8)])
def test_spectra_over_many_rows(spark, monkeypatch, size, hop, smoothing):
    monkeypatch.setattr(sound, "WINDOWS", 9)
    got = {(r.clip, r.window): r.magnitudes for r in sound.spectrum(blocks(spark, 1), size, hop, smoothing).collect()}
    expected = {(name, k): m for name, x in CLIPS.items() for k, m in enumerate(plain_spectrum(x, size, hop, smoothing))}
    assert set(got) == set(expected) and len(got) > 50
    assert all(np.allclose(got[k], m, atol=1e-12) for k, m in expected.items())


def test_levels_and_preview(spark):
    rows = spark.createDataFrame([("a", 0, [0.0, 1e-5, 10 ** (-55 / 20), 1.0])], "clip string, window long, magnitudes array<double>")
    assert sound.byte_bins(rows).first().bins == [0, 0, 127, 255]
    assert sound.preview(2048, 48_000, 1000)["bin"] == 43 and sound.preview(256, 48_000)["bin"] == -1


def test_a_chunk_gets_only_what_it_needs(spark):
    """Of a long block each chunk gets its own part."""
    one = spark.createDataFrame([("a", 0, [float(i) for i in range(40_000)])], "clip string, place long, samples array<double>")
    got = sound.spectrum(one, 64, 32)
    assert got.count() == (40_000 - 64) // 32 + 1 and got.agg(F.max("window")).first()[0] == (40_000 - 64) // 32
