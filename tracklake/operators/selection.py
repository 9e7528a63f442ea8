"""Track and sample selection.

Samples are rows (track_id, index, pts_us, dts_us, duration_us, is_key, picture_type, size, ...). A window per track gives places, neighbours and
the track's first time; everything else is a filter that the optimizer can push.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators import timeline as T

PRESENTATION, DECODE = ("index", "pts_us"), ("dts_us", "index")
FRAME_TYPES = ("all", "key", "non_key", "I", "P", "B", "IDR")


class NoTrack(ValueError):
    """No track matches a selection."""


def finite(value: object) -> float | None:
    """The finite number that a value is or spells, else None."""
    try:
        number = value if isinstance(value, int) else float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


@dataclass(frozen=True)
class Criteria:
    """What a selection asks for; times in microseconds after the track's first sample, negative ends and limits mean none.

    Values may come from outside as they are: places are rounded down, starts below 0 are 0, what is no finite number is left at its default, unknown
    frame types mean all and unknown orders presentation.
    """

    start_index: int = 0
    end_index: int = -1
    start_us: float = 0
    end_us: float = -1
    frame_type: str = "all"
    order: str = "presentation"
    limit: int = -1
    kind: str = "video"

    def __post_init__(self) -> None:
        for name, least, whole in (("start_index", 0, True), ("end_index", -1, True), ("start_us", 0, False), ("end_us", -1, False), ("limit", -1, True)):
            given = finite(getattr(self, name))
            value = least if given is None or given < 0 else math.floor(given) if whole or given == math.floor(given) else given
            object.__setattr__(self, name, value)
        object.__setattr__(self, "frame_type", self.frame_type if self.frame_type in FRAME_TYPES else "all")
        object.__setattr__(self, "order", "decode" if self.order == "decode" else "presentation")


def nth_of(rows: DataFrame, group: list[str], order: list[str], nth: int) -> DataFrame:
    """The nth row of each group, from 0."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_n", place).where(F.col("_n") == nth + 1).drop("_n")


def first_match(rows: DataFrame, group: list[str], value: str, rank: list[Column]) -> DataFrame:
    """(group, value): the best of each group by a rank, as a decoder is picked for a codec and a layout; an aggregate, so no sort."""
    return rows.groupBy(*group).agg(F.max_by(value, F.struct(*rank)).alias(value))


def select_track(tracks: DataFrame, samples: DataFrame, track_id: str | None = None, kind: str = "video", nth: int = 0) -> tuple[DataFrame, DataFrame]:
    """(track, its samples) of the tables of one source: by id if one is given, else the nth of a kind; raises NoTrack. For many sources: :func:`select_tracks`."""
    if track_id and track_id.strip():
        track = tracks.where(F.col("track_id") == track_id)
    else:
        track = nth_of(tracks.where(F.col("kind") == kind), ["kind"], ["index"], nth)
    if track.isEmpty():
        raise NoTrack(f"No track matched {track_id or f'{kind} {nth}'}")
    return track, samples.join(F.broadcast(track.select("track_id")), "track_id", "left_semi")


def select_tracks(tracks: DataFrame, samples: DataFrame, track_id: str | None = None, kind: str = "any", nth: object = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, their samples, errors): one track of each source, by id if one is given, whatever its kind, else the nth of a kind by its index, from 0.

    Tracks are rows (source_id, track_id, index, kind, ...) with ids that no two sources share. Sources without such a track are told as errors and have
    no rows. A source's tracks meet in one small window; samples are only filtered by the ids picked.
    """
    given = (track_id or "").strip()
    place = 0 if given else max(0, math.floor(finite(nth) or 0))
    fitting = F.col("track_id") == given if given else F.lit(True) if kind == "any" else F.col("kind") == kind
    picked = nth_of(tracks.where(fitting), ["source_id"], ["index", "track_id"], place)
    without = tracks.select("source_id").distinct().join(picked.select("source_id"), "source_id", "left_anti")
    errors = T.diagnostics(without, "selection.no_track", "error", F.lit(f"no track {given}" if given else f"no track {place} of kind {kind}"), F.col("source_id"))
    return picked, samples.join(picked.select("track_id"), "track_id", "left_semi"), errors


def map_to_tracks(samples: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples with track_id and sample_id, warnings): samples (source_id, stream_index, kind, index, ...) on the tracks (source_id, stream_index, kind,
    index, track_id) of their source.

    A sample goes to the first track of its stream, else to the first of its kind; samples that find none are told and left out. A source's tracks become one
    row with two maps, so samples are joined once, by source.
    """

    def firsts(key: str) -> DataFrame:
        first = tracks.where(F.col(key).isNotNull()).groupBy("source_id", key).agg(F.min_by("track_id", F.struct("index", "track_id")).alias("t"))
        return first.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "t"))).alias(f"_{key}"))

    found = samples.join(firsts("stream_index").join(firsts("kind"), "source_id", "full"), "source_id", "left")
    found = found.withColumn("track_id", F.coalesce(F.try_element_at("_stream_index", F.col("stream_index")), F.try_element_at("_kind", F.col("kind")))).drop("_stream_index", "_kind")
    told = F.concat(F.lit("sample "), F.coalesce(F.col("index").cast("string"), F.lit("without index")), F.lit(" has no track"))
    notes = T.diagnostics(found.where("track_id is null"), "analysis.unmapped_sample", "warning", told, F.col("source_id"))
    return found.where("track_id is not null").withColumn("sample_id", F.concat_ws(":", "track_id", F.col("index").cast("string"))), notes


def matches_frame_type(kind: str) -> Column:
    if kind == "all":
        return F.lit(True)
    if kind == "key":
        return F.col("is_key")
    if kind == "non_key":
        return ~F.col("is_key")
    same = F.upper("picture_type") == kind
    return same | F.coalesce(F.col("is_idr"), F.lit(False)) if kind == "IDR" else same


def _located(samples: DataFrame, c: Criteria) -> tuple[DataFrame, Column]:
    """Samples with their place in their track, and which of them criteria ask for, but for the limit."""
    w = Window.partitionBy("track_id").orderBy(*PRESENTATION)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = samples.withColumns({"position": F.row_number().over(w) - 1, "_first": F.first("pts_us").over(whole), "_next": F.lead("pts_us").over(w)})
    keep = (F.col("position") >= c.start_index) & matches_frame_type(c.frame_type)
    if c.end_index >= 0:
        keep &= F.col("position") <= c.end_index
    start, end = F.col("_first") + c.start_us, F.col("_first") + c.end_us
    if c.kind == "audio":
        own = F.col("pts_us") + F.col("duration_us")
        keep &= F.when(F.col("duration_us") > 0, own).otherwise(F.greatest(F.col("pts_us") + 1, F.coalesce("_next", F.col("pts_us") + 1))) > start
    else:
        keep &= F.col("pts_us") >= start
    return rows, keep & (F.col("pts_us") < end) if c.end_us >= 0 else keep


def _ordered(c: Criteria) -> Window:
    return Window.partitionBy("track_id").orderBy(*(DECODE if c.order == "decode" else PRESENTATION))


def select_samples(samples: DataFrame, c: Criteria) -> DataFrame:
    """The samples of each track that criteria ask for, with their place in it and the order ``n`` of the selection."""
    rows, keep = _located(samples, c)
    out = rows.where(keep).drop("_first", "_next").withColumn("n", F.row_number().over(_ordered(c)))
    return out.where(F.col("n") <= c.limit) if c.limit >= 0 else out


def mark_samples(samples: DataFrame, c: Criteria) -> DataFrame:
    """All samples with ``is_target`` for those that :func:`select_samples` gives; the windows of both share one exchange."""
    rows, keep = _located(samples, c)
    rows = rows.withColumn("is_target", F.coalesce(keep, F.lit(False))).drop("_first", "_next", "position")
    if c.limit < 0:
        return rows
    count = F.sum(F.col("is_target").cast("long")).over(_ordered(c).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("is_target", F.col("is_target") & (count <= c.limit))


def selection_ranges(samples: DataFrame, c: Criteria) -> DataFrame:
    """(track_id, range_start, range_end): a selection's range starts ``start_us`` after the track's first sample and ends ``end_us`` after it, or where
    the track's last sample ends. One aggregate with map-side combining; no window."""
    place, start = F.struct(*PRESENTATION), F.min_by("pts_us", F.struct(*PRESENTATION))
    end = start + c.end_us if c.end_us >= 0 else F.max_by(F.col("pts_us") + F.greatest(F.lit(0), F.coalesce("duration_us", F.lit(0))), place)
    return samples.groupBy("track_id").agg((start + c.start_us).alias("range_start"), end.alias("range_end"))


def selection_facts(samples: DataFrame, selected: DataFrame, c: Criteria) -> tuple[DataFrame, DataFrame]:
    """((track_id, n_selected, range_start, range_end), warnings of tracks of which nothing is selected)."""
    counts = selected.groupBy("track_id").agg(F.count("*").alias("n_selected"))
    facts = selection_ranges(samples, c).join(counts, "track_id", "left").fillna(0, ["n_selected"]).select("track_id", "n_selected", "range_start", "range_end")
    return facts, T.diagnostics(facts.where("n_selected = 0"), "selection.empty", "warning", F.lit("no sample matches"), F.col("track_id"))


def range_end(selected: DataFrame) -> DataFrame:
    """(track_id, range_end): where the last selected sample of a track ends."""
    end = F.col("pts_us") + F.greatest(F.lit(0), F.coalesce("duration_us", F.lit(0)))
    return selected.groupBy("track_id").agg(F.max_by(end, F.struct("index", "pts_us")).alias("range_end"))


def overlaps(start_us: int | Column, end_us: int | Column | None) -> Column:
    """Samples that reach into an absolute range; those without duration last 1 microsecond."""
    end = F.when(F.col("duration_us") > 0, F.col("pts_us") + F.col("duration_us")).otherwise(F.col("pts_us") + 1)
    return (end > start_us) & (F.lit(True) if end_us is None else F.col("pts_us") < end_us)


def nearest_frame(samples: DataFrame, pts_us: int | Column) -> DataFrame:
    """The sample of each track nearest a time; the earlier of two as near."""
    return samples.groupBy("track_id").agg(F.min_by(F.col("index"), F.struct(F.abs(F.col("pts_us") - pts_us), F.col("pts_us"), F.col("index"))).alias("index"))
