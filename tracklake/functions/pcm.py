"""Sampled values as arrays: conversions, trimming, resampling, interleaving; native expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise16(samples: Column) -> Column:
    """Floats of -1 to 1 as 16-bit integers: clamped, times 32767, rounded half up."""
    return F.transform(samples, lambda x: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767 + 0.5).cast("int"))


def from_pcm16(samples: Column) -> Column:
    return F.transform(samples, lambda x: x.cast("double") / 32768)


def gain(samples: Column, factor: float) -> Column:
    return F.transform(samples, lambda x: x.cast("double") * factor)


def resample_linear(samples: Column, from_rate: int, to_rate: int) -> Column:
    """Linear interpolation with the ends aligned; max(1, floor(n * to / from + 0.5)) samples. The same rate changes nothing."""
    if from_rate == to_rate:
        return F.transform(samples, lambda x: x.cast("double"))
    n = F.size(samples)
    count = F.greatest(F.lit(1), F.floor(n * to_rate / from_rate + 0.5).cast("int"))

    def value(i: Column) -> Column:
        at = i * (n - 1) / F.greatest(count - 1, F.lit(1))
        low = F.floor(at).cast("int")
        left, right = (F.get(samples, x).cast("double") for x in (low, F.least(low + 1, n - 1)))
        return left + (right - left) * (at - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), value)).otherwise(F.array().cast("array<double>"))


def trim(samples: Column, rate: int, pts_us: Column, start_us: Column, end_us: Column) -> Column:
    """Samples of [start, end): from the floor of the first to the ceiling of the last offset, within the array."""
    n = F.size(samples)
    bound = lambda x: F.greatest(F.lit(0), F.least(n, x.cast("int")))
    first = bound(F.floor((start_us - pts_us) * rate / 1_000_000))
    last = bound(F.ceil((end_us - pts_us) * rate / 1_000_000))
    return F.slice(samples, first + 1, F.greatest(F.lit(0), last - first))


def interleave(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda x: F.array(x["l"], x["r"])))


def moving_average(samples: Column, taps: int) -> Column:
    """Mean of each sample and up to ``taps`` - 1 before it."""
    return F.transform(samples, lambda x, i: F.aggregate(F.slice(samples, F.greatest(F.lit(1), i - taps + 2), F.least(i + 1, F.lit(taps))), F.lit(0.0), lambda a, b: a + b.cast("double")) / F.least(i + 1, F.lit(taps)))


def wav_header(frames: Column, rate: int, channels: int, width: int = 2) -> Column:
    """44-byte header of 16-bit PCM, or of floats for a width of 4 bytes."""
    block, kind = channels * width, 3 if width == 4 else 1
    return F.concat(F.lit(b"RIFF"), little(frames * block + 36, 4), F.lit(b"WAVEfmt "), little(F.lit(16), 4), little(F.lit(kind), 2), little(F.lit(channels), 2), little(F.lit(rate), 4), little(F.lit(rate * block), 4), little(F.lit(block), 2), little(F.lit(width * 8), 2), F.lit(b"data"), little(frames * block, 4))


def little(value: Column, size: int) -> Column:
    """Non-negative integers as little-endian bytes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(255)), 2, "0")) for i in range(size)])


def float_planes(codes: Column, channels: int) -> Column:
    """Interleaved 16-bit values as one array of floats for each channel; what does not fill a frame is left out."""
    frames = F.floor(F.size(codes) / channels).cast("int")
    places = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda c: F.transform(places, lambda i: F.get(codes, i * channels + c).cast("double") / 32768)
    return F.array(*[one(c) for c in range(channels)])


def biquad(kind: str, frequency: float, rate: int, q: float = 1.0, gain_db: float = 0.0, detune: float = 0.0) -> tuple[list[float], list[float]]:
    """Normalised coefficients (b, a) of a second-order filter; ``detune`` is in hundredths of a semitone.

    As browsers define them: Q of low and high pass is in decibels, shelves have a slope of 1 and no Q.
    """
    f = min(max(frequency * 2 ** (detune / 1200), 0.0), rate / 2)
    w = 2 * math.pi * f / rate
    cos, sin, big = math.cos(w), math.sin(w), 10 ** (gain_db / 40)
    alpha = sin / (2 * (10 ** (q / 20) if kind in ("lowpass", "highpass") else max(q, 1e-4)))
    slope = sin / 2 * math.sqrt(2)
    root = 2 * math.sqrt(big) * slope
    shapes = {
        "lowpass": ([(1 - cos) / 2, 1 - cos, (1 - cos) / 2], [1 + alpha, -2 * cos, 1 - alpha]),
        "highpass": ([(1 + cos) / 2, -1 - cos, (1 + cos) / 2], [1 + alpha, -2 * cos, 1 - alpha]),
        "bandpass": ([alpha, 0.0, -alpha], [1 + alpha, -2 * cos, 1 - alpha]),
        "notch": ([1.0, -2 * cos, 1.0], [1 + alpha, -2 * cos, 1 - alpha]),
        "allpass": ([1 - alpha, -2 * cos, 1 + alpha], [1 + alpha, -2 * cos, 1 - alpha]),
        "peaking": ([1 + alpha * big, -2 * cos, 1 - alpha * big], [1 + alpha / big, -2 * cos, 1 - alpha / big]),
        "lowshelf": (
            [big * (big + 1 - (big - 1) * cos + root), 2 * big * (big - 1 - (big + 1) * cos), big * (big + 1 - (big - 1) * cos - root)],
            [big + 1 + (big - 1) * cos + root, -2 * (big - 1 + (big + 1) * cos), big + 1 + (big - 1) * cos - root],
        ),
        "highshelf": (
            [big * (big + 1 + (big - 1) * cos + root), -2 * big * (big - 1 + (big + 1) * cos), big * (big + 1 + (big - 1) * cos - root)],
            [big + 1 - (big - 1) * cos + root, 2 * (big - 1 - (big + 1) * cos), big + 1 - (big - 1) * cos - root],
        ),
    }
    b, a = shapes[kind]
    return [x / a[0] for x in b], [x / a[0] for x in a]


def flat_lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all numbers, where each list starts, sizes) of a list array; a null list is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(values), 0))
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes, sizes


def as_lists(values: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Numbers as lists of such sizes, null where ``values`` are."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
    return pc.if_else(values.is_null(), pa.scalar(None, lists.type), lists) if values.null_count else lists


def second_order(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, b: list[float], a: list[float], state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(output, states at the end) of a second-order filter over lists side by side, one step for each place; from states at the start, or from rest."""
    out = np.zeros(len(flat))
    state = np.zeros((2, len(sizes))) if state is None else state
    for place in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > place)
        x = flat[start[live] + place]
        y = b[0] * x + state[0, live]
        state[0, live], state[1, live] = b[1] * x - a[1] * y + state[1, live], b[2] * x - a[2] * y
        out[start[live] + place] = y
    return out, state


def filtered(samples: Column, b: list[float], a: list[float]) -> Column:
    """Samples through a second-order filter that starts at rest.

    A filter's output depends on its own last outputs, which no array function can express without copying the array at each step; so it runs over
    Arrow lists, all arrays of a batch side by side. Clips that lie in many rows are filtered by :func:`tracklake.operators.sound.filtered_clips`.
    """

    def run(values: pa.Array) -> pa.Array:
        flat, start, sizes = flat_lists(values)
        return as_lists(values, sizes, second_order(flat, start, sizes, b, a)[0])

    return F.arrow_udf(run, "array<double>", F.ArrowUDFType.SCALAR)(samples.cast("array<double>"))


#: A chain's step: ("gain", {"gain": x}) or ("biquad", {"kind": ..., "frequency": ..., "q": ..., "gain_db": ..., "detune": ...}).
Step = tuple[str, dict]


def baked(samples: Column, rate: int, chain: list[Step], playback_rate: float = 1.0, most_seconds: float = 120.0) -> Column:
    """Samples through a chain of effects, played at a rate: min(ceil(n / rate), seconds) of them, at least one."""
    speed = max(0.05, playback_rate)
    n = F.size(samples)
    count = F.greatest(F.lit(1), F.least(F.ceil(n / speed), F.lit(int(rate * most_seconds)))).cast("int")

    def value(i: Column) -> Column:
        at = i * speed
        low = F.floor(at).cast("int")
        left, right = (F.coalesce(F.get(samples, x).cast("double"), F.lit(0.0)) for x in (low, low + 1))
        return left + (right - left) * (at - low)

    out = F.transform(F.sequence(F.lit(0), count - 1), value)
    for name, p in chain:
        out = gain(out, p.get("gain", 1.0)) if name == "gain" else filtered(out, *biquad(p.get("kind", "lowpass"), p.get("frequency", 350.0), rate, p.get("q", 1.0), p.get("gain_db", 0.0), p.get("detune", 0.0)))
    return out
