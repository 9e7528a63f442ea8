"""Line deduplication over overlapping three-line windows.

Every ``SIZE`` consecutive lines of a document make a window, known by two 64-bit hashes of its bytes. Windows that occur
more than once anywhere are found by an aggregate with map-side combining; of each, the occurrence in the smallest id, and there at the
first place, stays, and the lines of all later ones are removed, overlaps merged. A window that a million documents share is a
million short rows of a join that the engine can split; texts are shuffled once, to meet the places to remove.

Defined cases: null and empty texts have no lines; texts of fewer than ``SIZE`` lines have no window and lose nothing; a null id is smaller
than others; rows equal in id and text are one document and lose the same lines; a repeat within a document counts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import drop_written, small_batches, written

SIZE = 3
_TABLES = [bs.byte_table(s, lower=False) for s in (401, 402)]


def line_bounds(block: bs.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, place in its row) of the lines of a block; a text without bytes has none."""
    cut = np.flatnonzero(block.buf == 10)
    full = np.flatnonzero(block.end > block.start)
    owner = full[np.searchsorted(block.start[full], cut, "right") - 1]
    row = np.concatenate([full, owner])
    start, end = np.concatenate([block.start[full], cut + 1]), np.concatenate([block.end[full], cut])
    start, end = start[np.lexsort((start, row))], end[np.lexsort((end, row))]
    row = np.sort(row)
    return start, end, row, np.arange(len(row)) - np.searchsorted(row, row)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in bs.blocks(batch.column("text"), most_rows=1 << 14):
            start, end, row, place = line_bounds(block)
            first = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
            hashes = [bs.run_hash(bs.prefix(block.buf, t), start[first], end[first + size - 1]).view(np.int64) for t in _TABLES]
            at = pa.array(block.first + row[first])
            yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), batch.column("id").take(at), batch.column("key").take(at), pa.array(place[first].astype(np.int32))], names=["h1", "h2", "id", "key", "place"])


def _remove(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count = np.asarray(pc.fill_null(pc.list_value_length(batch.column("places")), 0))
        flat, ends = batch.column("places").flatten().to_numpy(zero_copy_only=False), np.cumsum(count)
        data, offsets, _ = bs.arrow_bytes(batch.column("text"))
        kept, lines, removed, starts = [], [], [], []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            parts = text.split(b"\n") if text else []
            lines.append(len(parts))
            gone = np.zeros(len(parts) + 1, bool)
            for place in flat[ends[i] - count[i] : ends[i]]:
                gone[place : place + size] = True
            kept.append(b"\n".join(p for p, g in zip(parts, gone, strict=False) if not g) if count[i] else text)
            removed.append(int(gone.sum()))
            starts.append(np.flatnonzero(gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(parts)]).tolist() if count[i] else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
            names=["id", "n_lines", "n_removed", "starts", "kept"],
        )


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_lines, n_removed, starts of removed runs, kept binary)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.encode(F.col(text_col).cast("string"), "utf-8"), F.lit(b""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("id", "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    windows = written(keyed.mapInArrow(lambda b: _windows(b, size), f"h1 long, h2 long, id {kind}, key long, place int"), "windows")
    here = F.struct("id", "key", "place")
    repeated = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first != last").select("h1", "h2", "first")
    repeated = written(repeated, "repeated")  # so that a hot window's join is between plain tables, which can be split
    later = windows.join(repeated, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first"))).select("key", "place").distinct()
    places = written(later.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places")), "places")
    drop_written(windows, repeated)
    # a merge join at every size: the places grow with the texts, so a broadcast would only ever suit small tables
    out = keyed.join(places.hint("merge"), "key", "left").select("id", "text", "places")
    return out.mapInArrow(lambda b: _remove(b, size), f"id {kind}, n_lines long, n_removed long, starts array<long>, kept binary").withColumnRenamed("id", id_col)


def op9_line_dedup(spark, sf_dir):
    """What is left of every document's lines."""
    out = remove_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {
    "op9_line_dedup": """
WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (SELECT doc_id, p, array_to_string(l[p : p + 2], chr(10)) AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM later)),
line AS (SELECT doc_id, q, l[q] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS q FROM d)),
marked AS (SELECT line.doc_id, line.q, s, gone.q IS NOT NULL AS g FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.q = gone.q),
runs AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY q), false) AS head FROM marked),
sums AS (SELECT doc_id, count(*) FILTER (g) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(s, chr(10) ORDER BY q) FILTER (NOT g) AS kept FROM runs GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)"""
}
