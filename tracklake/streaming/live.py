"""Live sessions as streams: what arrives out of order is held until the watermark passes it, then taken in order of time by a small machine for each key.

:func:`in_order` is the one stateful operator: rows wait in list state, a timer is set for the earliest of them, and when the watermark passes it all that are due go through the
machine in order of time. So results don't depend on how rows are dealt over micro-batches, a key that falls silent is emptied by its timer, and a query that is
started again goes on from its checkpoint. State that timers need is kept in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import IntegralType, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A machine gets the state of a key (None at first) and a row, and gives the new state and output rows; all are tuples.
Machine = Callable[["tuple | None", tuple], "tuple[tuple, list[tuple]]"]


class _InOrder(StatefulProcessor):
    def __init__(self, machine: Machine, held: StructType, state: str, out: list[str]) -> None:
        self.machine, self.held_schema, self.state_schema, self.out = machine, held, state, out
        self.whole = [isinstance(f.dataType, IntegralType) for f in held]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def _due(self, key: tuple, rows: list[tuple], watermark_ms: int) -> pd.DataFrame:
        """What is due by the watermark goes through the machine; the rest waits, with a timer at its first time."""
        rows.sort(key=lambda r: r[:2])
        due = [r for r in rows if r[0] < watermark_ms * 1000]
        rest = rows[len(due) :]
        state, out = self.state.get(), []
        for row in due:
            state, more = self.machine(state, row)
            out += [(*key, *m) for m in more]
        if due and state is not None:
            self.state.update(state)
        self.held.clear()
        if rest:
            self.held.put(rest)
            at = rest[0][0] // 1000 + 1
            timers = {t for t in self.handle.listTimers()}
            if at not in timers:
                self.handle.registerTimer(at)
        return pd.DataFrame(out, columns=self.out, dtype=object)

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.held.get()] if self.held.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # by place: names that are no identifiers are changed on the way
        new = [tuple(_plain(x, w) for x, w in zip(r[2:], self.whole, strict=True)) for frame in rows for r in frame.itertuples(index=False, name=None)]
        yield self._due(key, self._waiting() + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._due(key, self._waiting(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _plain(x: object, whole: bool) -> object:
    """A cell as Python has it; whole numbers beside nulls come as floats (exact up to 2**53)."""
    if isinstance(x, np.ndarray):
        return [float(v) for v in x]
    x = x.item() if isinstance(x, np.generic) else x
    if x is None or (isinstance(x, float) and np.isnan(x)):
        return None
    return int(x) if whole else x


def in_order(stream: DataFrame, key: str, columns: list[str], machine: Machine, state: str, out: str, time: str = "ts", late: str = "10 seconds") -> DataFrame:
    """(key, ``out``): what a machine makes of the rows of each key in order of ``time`` and then of the first of ``columns``; rows up to ``late`` behind the latest may come out of order.

    The machine sees (time in microseconds, columns).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    marked = stream.withWatermark(time, late).withColumn("at_us", F.unix_micros(F.col(time).cast("timestamp"))).select(key, time, "at_us", *columns)
    held = StructType([marked.schema[c] for c in ["at_us", *columns]])
    kind = marked.schema[key].dataType.simpleString()
    outs = [key, *[x.split()[0] for x in out.split(", ")]]
    processor = _InOrder(machine, held, state, outs)
    return marked.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {out}", "append", "eventTime")


# --- packets that leave by event time


def released(stream: DataFrame, key: str = "track_id", late: str = "10 seconds") -> DataFrame:
    """(key, idx, pts_us, n): packets in order, each when the watermark passes its time; ``n`` counts those of its key."""

    def machine(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        n = (state[0] if state else 0) + 1
        return (n,), [(row[1], row[2], n)]

    return in_order(stream, key, ["idx", "pts_us"], machine, "n long", "idx long, pts_us long, n long", late=late)


# --- a gate under a control stream


def control_gate(media: DataFrame, control: DataFrame, key: str = "track_id", late: str = "10 seconds") -> DataFrame:
    """(key, event, idx, pts_us): what a recorder takes of a media stream (key, ts, idx, pts_us) while it is on, by a control stream (key, ts, idx, action).

    ``event`` is ``media`` for a row that is taken, ``started`` and ``stopped`` for what the control does, and ``already_recording`` or ``not_recording`` for an action that is
    refused: a start while it is on, a stop while it is off. An ``abort`` while it is off does nothing. At one time control goes before media.
    """
    none = F.lit(None)
    first = (F.col("idx") - (1 << 62)).alias("place")  # before all media of its time
    both = media.select(key, "ts", F.col("idx").alias("place"), "idx", "pts_us", none.cast("string").alias("action")).unionByName(control.select(key, "ts", first, "idx", none.cast("long").alias("pts_us"), "action"))

    def machine(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        on, (_, _, idx, pts, action) = bool(state and state[0]), row
        if action is None:
            return (on,), [("media", idx, pts)] if on else []
        if action == "start":
            return (True,), [("already_recording" if on else "started", idx, pts)]
        told = "stopped" if on else None if action == "abort" else "not_recording"
        return (False,), [(told, idx, pts)] if told else []

    return in_order(both, key, ["place", "idx", "pts_us", "action"], machine, "on boolean", "event string, idx long, pts_us long", late=late)


# --- a recorder


PIECE = 1024


def recorded(stream: DataFrame, rate: int, channels: int = 1, fps: int = 30, key: str = "session_id", late: str = "10 seconds") -> DataFrame:
    """(key, kind, idx, pts_us, is_key, samples): the packets-to-be of a recording session of pictures and sound, without a codec.

    ``stream`` has (key, ts, idx, kind, pts_us, rate, channels, samples). Times are relative to the session's first event of either kind. Sound is cut into pieces of ``PIECE`` frames, what is
    left of a chunk waits for the next one; chunks of another rate or number of channels are told as ``dropped``. Pictures are key every two seconds' worth of them.
    """

    def machine(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        base, shown, carry = state or (None, 0, [])
        _, idx, kind, pts, own_rate, own_channels, samples = row
        base, out = pts if base is None else base, []
        if kind == "video":
            out.append((kind, idx, max(0, pts - base), shown % (2 * fps) == 0, None))
            shown += 1
        elif own_rate != rate or max(1, min(2, own_channels)) != channels:
            out.append(("dropped", idx, max(0, pts - base), None, None))
        else:
            merged, at, width = [*carry, *(samples or [])], 0, PIECE * channels
            while at + width <= len(merged):
                out.append(("audio", idx, max(0, pts - base + int(at / channels / rate * 1_000_000 + 0.5)), True, merged[at : at + width]))
                at += width
            carry = merged[at:]
        return (base, shown, list(carry)), out

    out = "kind string, idx long, pts_us long, is_key boolean, samples array<double>"
    return in_order(stream, key, ["idx", "kind", "pts_us", "rate", "channels", "samples"], machine, "base long, shown long, carry array<double>", out, late=late)


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch replaces its own folder, so one that runs again after a failure writes nothing twice."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return write


# --- clock and packets, stream by stream


def presentable(clock: DataFrame, packets: DataFrame, lookahead: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(track_id, clock_us, pts_us): for each tick of a clock stream (track_id, ts) the latest packet (track_id, ts) at or before it, else the earliest after it, within ``lookahead``; null if there is none.

    A join of two streams by a range of time, and an aggregate by tick: both keep only what the watermarks have not passed, and a tick comes out when they have. Works on tables as well.
    """
    if clock.isStreaming:
        clock, packets = clock.withWatermark("ts", late), packets.withWatermark("ts", late)
    c, p = clock.select("track_id", F.col("ts").alias("clock_ts")), packets.select(F.col("track_id").alias("of"), F.col("ts").alias("packet_ts"))
    near = F.expr(f"track_id = of AND packet_ts >= clock_ts - INTERVAL {lookahead} AND packet_ts <= clock_ts + INTERVAL {lookahead}")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    both = c.join(p, near, "leftOuter")
    past = F.max(F.when(F.col("packet_ts") <= F.col("clock_ts"), us("packet_ts")))
    later = F.min(F.when(F.col("packet_ts") > F.col("clock_ts"), us("packet_ts")))
    # a window of one microsecond is the tick itself; groups by event time leave state when the watermark passes them
    tick = F.window("clock_ts", "1 microsecond")
    return both.groupBy("track_id", tick).agg(F.coalesce(past, later).alias("pts_us")).select("track_id", us("window.start").alias("clock_us"), "pts_us")


# --- metrics


class Counters(StreamingQueryListener):
    """Sums of what queries observe (see :func:`counted`), by name, over all their progress."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            own = self.totals.setdefault(name, {})
            for k, v in row.asDict().items():
                own[k] = own.get(k, 0) + (v or 0)


def counted(stream: DataFrame, name: str, **counts: Column) -> DataFrame:
    """A stream whose query counts rows and those for which conditions hold, as metrics of the query and no column of its rows."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()])


def listen(spark: SparkSession) -> Counters:
    counters = Counters()
    spark.streams.addListener(counters)
    return counters
