"""Dependency plans, durations, validation and sample tables, as windows and aggregates per track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.buckets import bucketed, over

BEFORE = (Window.unboundedPreceding, -1)


def gop_closure(samples: DataFrame, per: int | None = None) -> DataFrame:
    """Rows that decoding the targets (``is_target``) needs: from the last key sample at or before each target to it.

    A running count of keys numbers the groups; a row is needed if a target stands at or after it in its group. One sort per track serves
    both windows. Targets before any key need every row up to them, in group 0. With ``per``, tracks are cut into ranges of so many rows, for tracks that
    are too long for a task: the count is carried from range to range, and each group's last target is joined to its rows.
    """
    if per:
        rows = over(bucketed(samples, ["track_id"], ["dts_us", "index"], per), ["track_id"], ["dts_us", "index"], sums={"gop": F.col("is_key").cast("int")}).drop("_bucket")
        last = rows.where("is_target").groupBy("track_id", "gop").agg(F.max(F.struct("dts_us", "index")).alias("_last"))
        return rows.join(last, ["track_id", "gop"]).where(F.struct("dts_us", "index") <= F.col("_last")).drop("_last")
    w = Window.partitionBy("track_id").orderBy("dts_us", "index")
    gop = F.sum(F.col("is_key").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = Window.partitionBy("track_id", "gop").orderBy("dts_us", "index").rowsBetween(0, Window.unboundedFollowing)
    return samples.withColumn("gop", gop).withColumn("_need", F.max(F.col("is_target").cast("int")).over(after)).where("_need = 1").drop("_need")


def orphan_targets(samples: DataFrame) -> DataFrame:
    """Targets without a key sample at or before them."""
    return gop_closure(samples).where("gop = 0 and is_target")


def ranged(rows: DataFrame, group: list[str], order: list[str], per: int | None) -> DataFrame:
    """Rows cut into ranges of ``per``, or as they are."""
    return bucketed(rows, group, order, per) if per else rows


def durations(samples: DataFrame, fallback_us: int, per: int | None = None) -> DataFrame:
    """Own duration if positive, else the time to the next sample if positive, else a constant; ``per`` as in :func:`gop_closure`."""
    group, order = ["track_id"], ["pts_us", "index"]
    rows = over(ranged(samples, group, order, per), group, order, after={"_next": F.col("pts_us")})
    own, gap = (F.when(x > 0, x) for x in (F.col("duration_us"), F.col("_next") - F.col("pts_us")))
    return rows.withColumn("duration_us", F.coalesce(own, gap, F.lit(fallback_us))).drop("_next", "_bucket")


def frame_durations(samples: DataFrame, fallback_us: int = 33_333) -> DataFrame:
    """Time to the next frame, else from the one before, else a constant."""
    w = Window.partitionBy("track_id").orderBy("pts_us", "index")
    return samples.withColumn("frame_us", F.coalesce(F.lead("pts_us").over(w) - F.col("pts_us"), F.col("pts_us") - F.lag("pts_us").over(w), F.lit(fallback_us)))


def dts_deltas(samples: DataFrame) -> DataFrame:
    """1 for the first sample of a track, then at least 1."""
    step = F.col("dts_us") - F.lag("dts_us").over(Window.partitionBy("track_id").orderBy("dts_us", "index"))
    return samples.withColumn("delta", F.greatest(F.lit(1).cast("long"), F.coalesce(step, F.lit(1).cast("long"))))


def track_summary(samples: DataFrame) -> DataFrame:
    """Counts, durations and bitrates of tracks; one pass with map-side combining."""
    end = F.max(F.col("pts_us") + F.coalesce("duration_us", F.lit(0)))
    out = samples.groupBy("track_id").agg(F.count("*").alias("n_samples"), (end - F.min("dts_us")).alias("duration_us"), F.sum("size").alias("n_bytes"))
    out = out.withColumn("duration_us", F.when(F.col("duration_us") >= 0, F.col("duration_us")))
    return out.withColumn("bitrate", F.when(F.col("duration_us") > 0, F.floor(F.col("n_bytes") * 8 * 1e6 / F.col("duration_us") + 0.5).cast("long")))


def container_summary(tracks: DataFrame) -> DataFrame:
    """One row: the longest track's duration and the bitrate of all bytes over it."""
    out = tracks.agg(F.max("duration_us").alias("duration_us"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_tracks"))
    return out.withColumn("bitrate", F.when(F.col("duration_us") > 0, F.floor(F.col("n_bytes") * 8 * 1e6 / F.col("duration_us") + 0.5).cast("long")))


def inferred_frame_rate(samples: DataFrame) -> DataFrame:
    """Frames a second of each track, at least 1; 30 for fewer than two samples."""
    span = F.max("pts_us") - F.min("pts_us")
    rate = F.when((F.count("*") < 2) | (span <= 0), 30).otherwise(F.greatest(F.lit(1), F.floor(F.count("*") * 1e6 / span + 0.5).cast("int")))
    return samples.groupBy("track_id").agg(rate.cast("int").alias("frame_rate"))


def non_monotonic(samples: DataFrame, order: list[str], value: str, per: int | None = None) -> DataFrame:
    """(track_id, violations): how often a value does not exceed the one before it; ``per`` as in :func:`gop_closure`."""
    rows = over(ranged(samples, ["track_id"], order, per), ["track_id"], order, before={"_last": F.col(value)})
    return rows.withColumn("_bad", F.coalesce((F.col(value) <= F.col("_last")).cast("long"), F.lit(0))).groupBy("track_id").agg(F.sum("_bad").alias("violations"))


def diagnostics(rows: DataFrame, code: str, severity: str, message: Column, source: Column) -> DataFrame:
    return rows.select(source.cast("string").alias("source_id"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def run_lengths(rows: DataFrame, group: list[str], order: list[str], value: str, per: int | None = None) -> DataFrame:
    """Runs of equal values in order: (group, run, value, n), by islands; ``per`` as in :func:`gop_closure`."""
    rows = over(ranged(rows, group, order, per), group, order, before={"_before": F.struct(value)})
    head = (F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before")[value])).cast("int")
    numbered = over(rows.withColumn("_head", head), group, order, sums={"run": F.col("_head")})
    return numbered.groupBy(*group, "run", value).agg(F.count("*").alias("n"))


def expand_runs(runs: DataFrame, group: list[str], order: list[str], count: str, delta: str) -> DataFrame:
    """Run-length decoding with running times: (group, sample, delta, dts), dts exclusive."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(*BEFORE)
    started = runs.withColumns({"_at": F.coalesce(F.sum(F.col(count)).over(w), F.lit(0)), "_dts": F.coalesce(F.sum(F.col(count) * F.col(delta)).over(w), F.lit(0))})
    each = started.withColumn("_i", F.explode(F.expr(f"CASE WHEN {count} > 0 THEN sequence(0L, cast({count} as long) - 1) ELSE array() END")))
    return each.select(*group, (F.col("_at") + F.col("_i")).alias("sample"), F.col(delta).alias("delta"), (F.col("_dts") + F.col("_i") * F.col(delta)).alias("dts"))


def sample_offsets(rows: DataFrame, chunk: str, base: Column, order: list[str], size: str) -> DataFrame:
    """Offset of each sample: its chunk's and the sizes before it in the chunk."""
    w = Window.partitionBy(chunk).orderBy(*order).rowsBetween(*BEFORE)
    return rows.withColumn("offset", base + F.coalesce(F.sum(size).over(w), F.lit(0)))


def last_run_at(points: DataFrame, runs: DataFrame, key: str, value: str) -> DataFrame:
    """As-of lookup: the value of the last run at or before each point, within groups ``g``; (g, key, value)."""
    both = points.select("g", F.col(key).alias("k"), F.lit(None).cast(runs.schema[value].dataType).alias("v"), F.lit(1).alias("_p"))
    both = both.unionByName(runs.select("g", F.col(key).alias("k"), F.col(value).alias("v"), F.lit(0).alias("_p")))
    w = Window.partitionBy("g").orderBy("k", "_p").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("_p = 1").select("g", F.col("k").alias(key), F.col("v").alias(value))


def nearest_target(queries: DataFrame, targets: DataFrame, tolerance_us: int) -> DataFrame:
    """(track_id, query, target): the nearest target in time within a tolerance, the earlier of two as near, else null.

    One sorted union per track instead of a join by range."""
    both = queries.select("track_id", F.col("pts_us").alias("t"), F.col("index").alias("query"), F.lit(None).cast("struct<p:bigint,i:bigint>").alias("here"))
    both = both.unionByName(targets.select("track_id", F.col("pts_us").alias("t"), F.lit(None).cast("long").alias("query"), F.struct(F.col("pts_us").alias("p"), F.col("index").alias("i")).alias("here")))
    w = Window.partitionBy("track_id").orderBy("t", F.col("query").isNotNull(), "here.i")
    down = F.last("here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first("here", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"lo": down, "hi": up}).where("query is not null")
    low, high = F.col("t") - F.col("lo.p"), F.col("hi.p") - F.col("t")
    pick = F.when(low.isNotNull() & (high.isNull() | (low <= high)), F.when(low <= tolerance_us, F.col("lo.i"))).when(high <= tolerance_us, F.col("hi.i"))
    return near.select("track_id", "query", pick.alias("target"))


def align_to(samples: DataFrame, other: DataFrame) -> DataFrame:
    """Samples whose time since their first is less than the span of ``other``, which is one row by aggregation."""
    span = other.agg((F.max(F.col("pts_us") + F.coalesce("duration_us", F.lit(0))) - F.min("pts_us")).alias("_span"))
    origin = samples.agg(F.min("pts_us").alias("_origin"))
    return samples.crossJoin(F.broadcast(span.crossJoin(origin))).where("pts_us - _origin < _span").drop("_span", "_origin")


def with_scalars(rows: DataFrame, *totals: Column) -> DataFrame:
    """``rows`` with aggregates over all of them as columns: one row, made in the same plan and sent to the tasks."""
    return rows.crossJoin(F.broadcast(rows.agg(*totals)))


def running_totals(rows: DataFrame, bucket: Column, order: str, value: str, name: str) -> DataFrame:
    """Exclusive running sums over a whole table in the order of a column, of which ``bucket`` is a monotonic function.

    A task holds one bucket of rows; only the totals of buckets meet in one window, and are joined back by their size.
    """
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy("_bucket").agg(F.sum(value).alias("_t"))
    starts = totals.select("_bucket", F.coalesce(F.sum("_t").over(Window.orderBy("_bucket").rowsBetween(*BEFORE)), F.lit(0)).alias("_s"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_bucket").orderBy(order).rowsBetween(*BEFORE)), F.lit(0))
    return rows.withColumn(name, within).join(starts, "_bucket").withColumn(name, F.col(name) + F.col("_s")).drop("_bucket", "_s")
