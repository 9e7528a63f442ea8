"""Buffers, clocks and gates over streams of samples.

The state of a track is small and bounded (a ring of so many places, a clock, an open flag), kept by Structured Streaming per track, so that tracks divide over
executors and a restarted query goes on from its checkpoint. :func:`replayed` runs a stream over what its source holds now and reads the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklake.tables import shared_folder

OUT = "track_id long, idx long, pts_us long, clock_us long, overruns long"


def advance(elapsed_us: int, rate: float, fps: float = 0, carry_us: int = 0) -> tuple[int, int]:
    """(advance, carry) of a presentation clock: elapsed time times rate; at a fixed rate whole frames, at most ceil(fps) at once."""
    step = int(elapsed_us * rate + 0.5)
    if not fps:
        return step, 0
    period = int(1_000_000 / fps)
    total = step + carry_us
    frames = total // period
    most = int(-(-fps // 1))
    return (min(frames, most) * period, total % period) if frames <= most else (most * period, 0)


def decoded_window(seconds: float, fps: float | None) -> int:
    """Places of a window of decoded frames: max(4, seconds times frames a second, rounded up)."""
    need = max(0.05, seconds) * max(1.0, fps or 30.0)
    return max(4, int(need) + (need > int(need)))


def push(ring: list[tuple[int, int]], rows: list[tuple[int, int]], capacity: int, policy: str) -> tuple[list[tuple[int, int]], int]:
    """(ring, overruns) after packets (pts, idx) arrive: the oldest or the newest go where there is no place."""
    overruns = 0
    for row in rows:
        if len(ring) >= capacity:
            overruns += 1
            if policy == "drop_newest":
                continue
            ring = ring[1:]
        ring = [*ring, row]
    return ring, overruns


def packet_ring(samples: DataFrame, capacity: int = 8, delay_us: int = 0, policy: str = "drop_oldest", ends: str = "false") -> DataFrame:
    """A bounded ring per track (track_id, idx, pts_us) on a stream; packets leave when they are due.

    The clock of a track is the latest time that it has seen, less ``delay_us``; each micro-batch of a track pushes its packets, in order of time, and
    pulls what is due before each further push, so that only what is not yet due counts against the capacity. A row for which ``ends`` (SQL) holds is the last
    of its stretch: all that the ring holds leaves with it. Rows come out with the clock that released them.
    """
    state_schema = "pts array<long>, idx array<long>, clock long, overruns long"
    marked = samples.select("track_id", "idx", "pts_us", F.expr(ends).alias("ends"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pts, idx, clock, overruns = state.get if state.exists else ([], [], -(1 << 62), 0)
        ring, out = list(zip(pts, idx, strict=True)), []
        for row in sorted((int(p), int(i), bool(e)) for f in frames for p, i, e in zip(f["pts_us"], f["idx"], f["ends"], strict=True)):
            clock = max(clock, row[0] - delay_us)
            ring, more = push(ring, [row[:2]], capacity, policy)
            overruns += more
            due = [r for r in ring if row[2] or r[0] <= clock]
            ring = [] if row[2] else [r for r in ring if r[0] > clock]
            out += [(key[0], i, p, clock, overruns) for p, i in sorted(due)]
        state.update(([p for p, _ in ring], [i for _, i in ring], clock, overruns))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return marked.groupBy("track_id").applyInPandasWithState(step, OUT, state_schema, "append", GroupStateTimeout.NoTimeout)


def record_gate(samples: DataFrame, opens: str, closes: str) -> DataFrame:
    """The samples of a stream between a row for which ``opens`` holds and the next for which ``closes`` does, per track."""
    marked = samples.select("track_id", "idx", "pts_us", F.expr(opens).alias("opens"), F.expr(closes).alias("closes"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("idx", kind="stable")
        marks = np.where(rows["opens"], 1.0, np.where(rows["closes"], 0.0, np.nan))
        is_open = pd.Series(np.concatenate([[float(state.get[0]) if state.exists else 0.0], marks])).ffill().to_numpy()[1:] > 0
        if len(rows):
            state.update((bool(is_open[-1]),))
        yield rows.loc[is_open, ["track_id", "idx", "pts_us"]]

    return marked.groupBy("track_id").applyInPandasWithState(step, "track_id long, idx long, pts_us long", "open boolean", "append", GroupStateTimeout.NoTimeout)


def presentation_clock(samples: DataFrame, rate: float = 1.0, fps: float = 0) -> DataFrame:
    """(track_id, idx, pts_us, clock_us, carry_us): the clock of each track after each row of a stream, by :func:`advance` over the time since the row before."""
    out = "track_id long, idx long, pts_us long, clock_us long, carry_us long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, clock, carry = state.get if state.exists else (None, 0, 0)
        rows = []
        for pts, idx in sorted((int(p), int(i)) for f in frames for p, i in zip(f["pts_us"], f["idx"], strict=True)):
            more, carry = advance(pts - last if last is not None else 0, rate, fps, carry)
            last, clock = pts, clock + more
            rows.append((key[0], idx, pts, clock, carry))
        state.update((last, clock, carry))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return samples.select("track_id", "idx", "pts_us").groupBy("track_id").applyInPandasWithState(step, out, "last long, clock long, carry long", "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class RingConfig:
    """How a ring is filled and paced; numbers out of range are moved to the nearest allowed one."""

    fill: str = "static_once"
    io: str = "producer_push"
    clock: str = "realtime"
    rate: float = 1.0
    target_rate: float = 0
    target_fps: float = 0
    capacity_seconds: float = 1.0
    underrun: str = "silence"
    overrun: str = "drop_oldest"
    loop: bool = True
    gain: float = 1.0

    # The names that each choice may have, the first one standing for any other.
    CHOICES: ClassVar = {
        "fill": ("static_once", "continuous"), "io": ("producer_push", "consumer_pull"), "clock": ("realtime", "fixed_rate"),
        "underrun": ("silence", "wait", "loop"), "overrun": ("drop_oldest", "block_producer", "drop_newest"),
    }

    def __post_init__(self) -> None:
        for name, allowed in self.CHOICES.items():
            if getattr(self, name) not in allowed:
                object.__setattr__(self, name, allowed[0])
        for name, least in (("rate", 0.05), ("capacity_seconds", 0.05), ("target_rate", 0), ("target_fps", 0)):
            object.__setattr__(self, name, max(least, getattr(self, name)))


def ring_source(config: RingConfig, static: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """What fills a ring: the stream of a continuous one, the table of one that is filled once; an error where that is missing."""
    if static is None and live is None:
        raise ValueError("a ring needs a table or a stream")
    if config.fill == "continuous":
        if live is None or not live.isStreaming:
            raise ValueError("a continuous ring needs a stream")
        return live
    if static is None or static.isStreaming:
        raise ValueError("a ring that is filled once needs a table")
    return static


def pulses(rows: DataFrame, when: str, label: str = "Trigger") -> DataFrame:
    """Control events (kind, label, source_id, track_id, pts_us) of the rows of a stream for which ``when`` (SQL) holds."""
    return rows.where(when).select(F.lit("pulse").alias("kind"), F.lit(label).alias("label"), F.lit(f"trigger_button:{label}").alias("source_id"), "track_id", "pts_us")


class SampleRing:
    """A bounded queue of samples of one channel, and how often it ran dry or over."""

    def __init__(self, capacity: int, underrun: str, overrun: str, held: np.ndarray, snapshot: np.ndarray, counts: tuple[int, int]) -> None:
        self.capacity, self.underrun, self.overrun = max(1, capacity), underrun, overrun
        self.held, self.snapshot, (self.underruns, self.overruns) = held, snapshot, counts

    def write(self, samples: np.ndarray) -> int:
        """Samples taken. A full ring drops the oldest (at least a quarter of its places), drops the new ones, or takes none."""
        taken = 0
        while taken < len(samples):
            free = self.capacity - len(self.held)
            left = len(samples) - taken
            if not free:
                if self.overrun != "drop_oldest":
                    self.overruns += left if self.overrun == "drop_newest" else 0
                    break
                drop = min(len(self.held), max(left, self.capacity // 4))
                self.held, self.overruns = self.held[drop:], self.overruns + drop
                continue
            self.held = np.concatenate([self.held, samples[taken : taken + free]])
            taken += min(free, left)
        return taken

    def read(self, count: int) -> np.ndarray:
        """``count`` samples; a dry ring gives silence, waits (fewer come) or plays its snapshot again."""
        out = [np.zeros(0)]
        while count > 0:
            if len(self.held):
                part, self.held = self.held[:count], self.held[count:]
                out.append(part)
                count -= len(part)
            elif self.underrun == "wait":
                break
            elif self.underrun == "loop" and len(self.snapshot):
                self.underruns += 1
                self.held = self.snapshot[: self.capacity]
            else:
                self.underruns += count
                out.append(np.zeros(count))
                break
        return np.concatenate(out)


def sample_ring(rows: DataFrame, capacity: int, underrun: str = "silence", overrun: str = "drop_oldest") -> DataFrame:
    """A ring of samples per track on a stream of writes and reads (track_id, idx, samples, want), in the order of ``idx``.

    A row with samples writes them, one without reads ``want``. Out come (track_id, idx, taken, samples, available, underruns, overruns). The first write of a
    track is what a ring that loops plays again.
    """
    out = "track_id long, idx long, taken long, samples array<double>, available long, underruns long, overruns long"
    state_schema = "held array<double>, snapshot array<double>, underruns long, overruns long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, snapshot, *counts = state.get if state.exists else ([], [], 0, 0)
        ring = SampleRing(capacity, underrun, overrun, np.array(held, float), np.array(snapshot, float), tuple(counts))
        made = []
        for row in pd.concat(list(frames)).sort_values("idx", kind="stable").to_dict("records"):
            taken, read = 0, np.zeros(0)
            if row["samples"] is not None:
                taken = ring.write(np.asarray(row["samples"], float))
                ring.snapshot = ring.snapshot if len(ring.snapshot) else ring.held.copy()
            else:
                read = ring.read(int(row["want"]))
            made.append((key[0], int(row["idx"]), taken, read.tolist(), len(ring.held), ring.underruns, ring.overruns))
        state.update((ring.held.tolist(), ring.snapshot.tolist(), ring.underruns, ring.overruns))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    return rows.select("track_id", "idx", "samples", "want").groupBy("track_id").applyInPandasWithState(step, out, state_schema, "append", GroupStateTimeout.NoTimeout)


def held(samples: DataFrame, capacity: int, policy: str = "drop_oldest") -> DataFrame:
    """What a ring of each track would hold after all samples of a table, none of them due: the latest, or with ``drop_newest`` the first ones."""
    order = [F.col("pts_us"), F.col("index")] if policy == "drop_newest" else [F.desc("pts_us"), F.desc("index")]
    return samples.withColumn("_n", F.row_number().over(Window.partitionBy("track_id").orderBy(*order))).where(F.col("_n") <= capacity).drop("_n")


def gated(samples: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """The samples of a table that a record gate lets through."""
    state = F.when(opens, True).when(closes, False)
    w = Window.partitionBy("track_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("_open", F.last(state, ignorenulls=True).over(w)).where("_open").drop("_open")


def clock_ticks(samples: DataFrame, period: str, late: str, time_col: str = "ts") -> DataFrame:
    """Samples of each track per tick of a clock: a tumbling window that closes when the watermark passes."""
    ticks = samples.withWatermark(time_col, late).groupBy("track_id", F.window(time_col, period)).agg(F.count("*").alias("n"))
    return ticks.select("track_id", F.col("window.start").alias("tick"), "n")


def latest_frames(samples: DataFrame, late: str, time_col: str = "ts") -> DataFrame:
    """Each frame of a track once, by its time, among those within the watermark."""
    return samples.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["track_id", "pts_us"])


def replayed(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over all that its source holds, append to Parquet, and read that.

    ``folder`` must be shared by all executors; unset, it is below spark.checkpoint.dir, or in a local session a temporary one.
    """
    spark = stream.sparkSession
    path = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}" if folder else shared_folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
