"""Sound in blocks: filters and spectra of clips that lie in many rows, and no task holds a clip.

A clip is rows (clip, place, samples): blocks in the order of ``place``. A filter's state at the end of a block is a linear map of the state at its start plus what the block adds from
rest, so blocks run alone, the small maps are composed along each clip, and each block is replayed from its own start. Spectra cut the clip anew into
chunks of windows; what a window needs of the next block is sent along with its chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import pcm as P

#: Windows of a chunk.
WINDOWS = 256


def _along(table: pa.Table, step, width: int) -> pa.Table:
    """Of one clip: the start of each block by the blocks before it, in order of place. What meets here is ``width`` numbers a block."""
    table = table.sort_by("place")
    own, n = np.array(table["own"].to_pylist(), np.float64).reshape(-1, width), table["n"].to_numpy()
    starts, now = np.zeros_like(own), np.zeros(width)
    for k in range(len(own)):
        starts[k] = now
        now = step(now, int(n[k])) + own[k]
    return table.drop_columns(["own", "n"]).append_column("start", pa.array(starts.tolist(), pa.list_(pa.float64())))


def filtered_clips(blocks: DataFrame, b: list[float], a: list[float]) -> DataFrame:
    """``blocks`` (clip, place, samples) through a second-order filter that starts at rest at the start of each clip.

    Equal to the filter over the clip as one array up to rounding: states are composed by powers of a matrix instead of steps. Null and empty blocks change nothing.
    """
    matrix = np.array([[-a[1], 1.0], [-a[2], 0.0]])

    def ends(samples: pa.Array) -> pa.Array:
        flat, start, sizes = P.flat_lists(samples)
        _, state = P.second_order(flat, start, sizes, b, a)
        return pa.array(state.T.tolist(), pa.list_(pa.float64()))

    def replay(samples: pa.Array, starts: pa.Array) -> pa.Array:
        flat, start, sizes = P.flat_lists(samples)
        out, _ = P.second_order(flat, start, sizes, b, a, np.array(starts.to_pylist(), np.float64).reshape(-1, 2).T.copy())
        return P.as_lists(samples, sizes, out)

    x = F.col("samples").cast("array<double>")
    own = F.arrow_udf(ends, "array<double>", F.ArrowUDFType.SCALAR)
    maps = blocks.select("clip", "place", own(x).alias("own"), F.coalesce(F.size(x), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in ("clip", "place"))
    starts = maps.groupBy("clip").applyInArrow(lambda t: _along(t, lambda s, n: np.linalg.matrix_power(matrix, n) @ s, 2), f"{kinds}, start array<double>")
    starts = starts.withColumnsRenamed({"clip": "_clip", "place": "_place"})
    both = blocks.join(starts, F.col("clip").eqNullSafe(F.col("_clip")) & (F.col("place") == F.col("_place")))
    return both.withColumn("samples", F.arrow_udf(replay, "array<double>", F.ArrowUDFType.SCALAR)(x, F.col("start"))).drop("_clip", "_place", "start")


def blackman(size: int) -> np.ndarray:
    i = 2 * np.pi * np.arange(size) / size
    return 0.42 - 0.5 * np.cos(i) + 0.08 * np.cos(2 * i)


def spectrum(blocks: DataFrame, fft_size: int = 2048, hop: int | None = None, smoothing: float = 0.0) -> DataFrame:
    """(clip, window, magnitudes array<double>): the spectrum of every window of ``fft_size`` samples of each clip, ``hop`` apart (half a window, unless it is given).

    Magnitudes are those of an analyser: a Blackman window, the transform divided by its size, the lower half of the bins; with ``smoothing`` each is so much of the one before it and the rest its
    own. Clips shorter than a window have none; samples after the last whole window take no part.
    """
    hop = hop or fft_size // 2
    size = F.coalesce(F.size("samples"), F.lit(0)).cast("long")
    before = Window.partitionBy("clip").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("clip", "place", F.greatest(size, F.lit(0)).alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # the places of blocks are small rows; samples are joined to them
    places = places.where("_n > 0").withColumnsRenamed({"clip": "_clip", "place": "_place"})
    rows = blocks.join(places, F.col("clip").eqNullSafe(F.col("_clip")) & (F.col("place") == F.col("_place")))
    wide = hop * WINDOWS  # samples from the start of one chunk to that of the next; a chunk also needs what its last window covers of the next
    first, last = F.floor(F.greatest(F.lit(0), F.col("_at") - (wide - hop + fft_size) + 1) / wide), F.floor((F.col("_at") + F.col("_n") - 1) / wide)
    rows = rows.withColumn("chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    start, stop = F.greatest(F.col("_at"), F.col("chunk") * wide), F.least(F.col("_at") + F.col("_n"), F.col("chunk") * wide + wide - hop + fft_size)
    rows = rows.where(stop > start).select("clip", "chunk", start.alias("at"), F.slice(F.col("samples").cast("array<double>"), (start - F.col("_at") + 1).cast("int"), (stop - start).cast("int")).alias("x"))
    kind = blocks.schema["clip"].dataType.simpleString()
    shape = blackman(fft_size) / fft_size

    def transform(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = max(0, (len(x) - fft_size) // hop + 1)
        n = min(n, WINDOWS)
        windows = np.lib.stride_tricks.sliding_window_view(x, fft_size)[::hop][:n] if n else np.zeros((0, fft_size))
        found = np.abs(np.fft.rfft(windows * shape, axis=1))[:, : fft_size // 2]
        chunk = table["chunk"][0].as_py()
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), fft_size // 2).cast(pa.list_(pa.float64()))
        return pa.table({"clip": pa.array([table["clip"][0].as_py()] * n, table["clip"].type), "window": pa.array(np.arange(n) + chunk * WINDOWS), "magnitudes": lists})

    out = rows.groupBy("clip", "chunk").applyInArrow(transform, f"clip {kind}, window long, magnitudes array<double>")
    return smoothed(out, smoothing, fft_size // 2) if smoothing else out


def smoothed(spectra: DataFrame, smoothing: float, bins: int) -> DataFrame:
    """Each spectrum as ``smoothing`` of the smoothed one before it and the rest of its own: chunks from rest, chunk ends composed along each clip, chunks again from their starts."""
    kind = spectra.schema["clip"].dataType.simpleString()
    rows = spectra.withColumn("place", F.floor(F.col("window") / WINDOWS))

    def run(table: pa.Table, start: np.ndarray) -> np.ndarray:
        x, now = np.array(table["magnitudes"].to_pylist(), np.float64).reshape(-1, bins), start
        out = np.zeros_like(x)
        for k in range(len(x)):
            now = smoothing * now + (1 - smoothing) * x[k]
            out[k] = now
        return out

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("window")
        return pa.table({"clip": table["clip"].slice(0, 1), "place": table["place"].slice(0, 1), "own": pa.array([run(table, np.zeros(bins))[-1].tolist()]), "n": pa.array([table.num_rows])})

    def replay(left: pa.Table, right: pa.Table) -> pa.Table:
        table = left.sort_by("window")
        found = run(table, np.array(right["start"][0].as_py()))
        return table.select(["clip", "window"]).append_column("magnitudes", pa.array(found.tolist(), pa.list_(pa.float64())))

    key = ["clip", "place"]
    maps = rows.groupBy(*key).applyInArrow(ends, f"clip {kind}, place long, own array<double>, n long")
    starts = maps.groupBy("clip").applyInArrow(lambda t: _along(t, lambda s, n: smoothing**n * s, bins), f"clip {kind}, place long, start array<double>")
    return rows.groupBy(*key).cogroup(starts.groupBy(*key)).applyInArrow(replay, f"clip {kind}, window long, magnitudes array<double>")


def byte_bins(spectra: DataFrame, low_db: float = -100.0, high_db: float = -10.0) -> DataFrame:
    """``magnitudes`` as numbers from 0 to 255 between two levels in decibels, as analysers draw them."""
    level = lambda x: F.when(x > 0, 20 * F.log10(x)).otherwise(F.lit(low_db))
    byte = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((level(x) - low_db) * (255 / (high_db - low_db))))).cast("int")
    return spectra.withColumn("bins", F.transform("magnitudes", byte)).drop("magnitudes")


def preview(fft_size: int, rate: int, mark: float = -1, continuous: bool = True) -> dict:
    """What a drawing of a spectrum is told; ``bin`` is that of the marked frequency."""
    marked = 0 <= mark <= rate / 2
    return {"binCount": fft_size // 2, "sampleRate": rate, "fftSize": fft_size, "continuous": continuous, "mark": mark, "bin": min(fft_size // 2 - 1, int(mark * fft_size / rate + 0.5)) if marked else -1}
