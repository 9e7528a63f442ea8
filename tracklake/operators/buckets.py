"""Windows over tracks that may be the whole table: rows are cut into ranges of their order, and ranges are linked by what they carry.

:func:`bucketed` deals rows into about equal ranges of (group, order), so a track of any length divides over tasks, and writes them, so that every reader
sees the same ranges. :func:`over` then computes running sums, last values and neighbours within each range, and adds to them what the ranges before (or the one after) hand on: one
row for each range and group, which is what meets in a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.tables import written

#: Rows of a range.
PER = 1_000_000


#: Rows that one task sorts, of as many ranges as they make: ranges may be many, but tasks and the samples that divide them must not be.
ROWS_A_TASK = 250_000


def bucketed(rows: DataFrame, group: list[str], order: list[str], per: int = PER) -> DataFrame:
    """``rows`` with ``_bucket``, which grows with (group, order) and holds about ``per`` rows; rows that are equal in both stay together.

    Tasks sort larger ranges and cut them by place, so what the driver is told of tasks does not grow with the number of buckets.
    """
    tasks, cluster = max(1, -(-rows.count() // max(per, ROWS_A_TASK))), [*group, *order]
    placed = rows.repartitionByRange(tasks, *cluster).sortWithinPartitions(*cluster).withColumn("_bucket", F.monotonically_increasing_id())
    first = F.min("_bucket").over(Window.partitionBy(*cluster))  # the ranges are already divided by what it is partitioned by
    place = first.bitwiseAND((1 << 33) - 1)
    out, _ = written(placed.withColumn("_bucket", first - place + F.floor(place / per)), "buckets")
    return out


def over(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """Adds columns to bucketed rows, in the order of each group.

    ``sums``: running sums up to a row, null counts as 0; ``lasts``: the last value that is not null up to a row; ``before`` and ``after``: the value of the row before or after, null
    where there is none. Rows without ``_bucket`` are taken as one range for each group: a plain window.
    """
    sums, lasts, before, after = (x or {} for x in (sums, lasts, before, after))
    split = "_bucket" in rows.columns
    w = Window.partitionBy(*group, *["_bucket"] * split).orderBy(*order)
    upto, boxed = w.rowsBetween(Window.unboundedPreceding, 0), lambda c: F.struct(c.alias("v"))
    within = {**{k: F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()}, **{k: F.last(c, ignorenulls=True).over(upto) for k, c in lasts.items()}, **{k: F.lag(boxed(c)).over(w) for k, c in before.items()}, **{k: F.lead(boxed(c)).over(w) for k, c in after.items()}}
    out = rows.withColumns(within)
    if not split:
        return out.withColumns({k: F.col(k)["v"] for k in (*before, *after)})
    key = F.struct(*order)
    totals = rows.groupBy(*group, "_bucket").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_c_{k}") for k, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), key)).alias(f"_c_{k}") for k, c in lasts.items()],
        *[F.max_by(boxed(c), key).alias(f"_c_{k}") for k, c in before.items()], *[F.min_by(boxed(c), key).alias(f"_c_{k}") for k, c in after.items()],
    )
    along = Window.partitionBy(*group).orderBy("_bucket")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c_{k}": F.coalesce(F.sum(f"_c_{k}").over(past), F.lit(0)) for k in sums} | {f"_c_{k}": F.last(f"_c_{k}", ignorenulls=True).over(past) for k in lasts}
    carried |= {f"_c_{k}": F.lag(f"_c_{k}").over(along) for k in before} | {f"_c_{k}": F.lead(f"_c_{k}").over(along) for k in after}
    keys = [*group, "_bucket"]
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c.alias(k) for k, c in carried.items()])
    out = out.join(totals, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    final = {k: F.col(k) + F.col(f"_c_{k}") for k in sums} | {k: F.coalesce(k, f"_c_{k}") for k in lasts} | {k: F.coalesce(k, f"_c_{k}")["v"] for k in (*before, *after)}
    return out.withColumns(final).drop(*[f"_k_{k}" for k in keys], *[f"_c_{k}" for k in final])
