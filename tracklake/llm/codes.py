"""Compression of vectors to codes: a codebook for each part of a vector, searched by kd-trees and refined in rounds.

Components become integers floor(``UNIT`` * x); vectors are cut into ``PARTS`` consecutive parts. The codebooks start as the parts of the ``ENTRIES`` smallest ids.
A round broadcasts one kd-tree for each codebook (a few kilobytes: entries times components). A task searches its vectors batch by batch: whole
columns of rows go down the nearer branch first, and a branch is left out only where its box is farther than the best entry so far, so boxes at an equal distance are
searched and an equal entry of a lower index is found. Each task hands on one integer sum and count for each entry; Spark adds them, and what comes
back is one row per component of the codebooks. The vectors are read once for each round, from a table of integers, and never shuffled.

Defined cases: vectors that are null or hold null or non-finite components are left out, and so are those of another length than most (ties: the shorter), which have no distance to the others;
a length that ``PARTS`` does not divide gives parts that differ by one component; components beyond ``LARGEST`` units either way count as that bound, so that squares
stay exact; fewer vectors than ``ENTRIES`` make smaller codebooks; an id that repeats is as many vectors, and among equal ids the smaller vector by its components starts a codebook first; a
null id comes after all others; entries that are equal leave all to the lowest index; null labels are one label; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written

UNIT, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries of a leaf, and the largest component: five hundred squared differences of it fit 64 bits.
LEAF, LARGEST = 2, (1 << 26) - 1
#: Rows searched at once.
ROWS_AT_ONCE = 4096


@dataclass
class Tree:
    """A kd-tree over the entries of one codebook: leaves hold the entries' indexes, and every node the box of its entries."""

    entries: np.ndarray
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    index: np.ndarray | None = None
    children: tuple[Tree, Tree] | None = None

    def __post_init__(self) -> None:
        if self.index is None:
            self.index = np.arange(len(self.entries))
        own = self.entries[self.index]
        self.low, self.high = own.min(0), own.max(0)
        spread = self.high - self.low
        if len(self.index) > LEAF and spread.size and spread.max() > 0:
            order = self.index[np.argsort(own[:, spread.argmax()], kind="stable")]
            half = len(order) // 2
            self.children = Tree(self.entries, np.sort(order[:half])), Tree(self.entries, np.sort(order[half:]))

    def apart(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows from the box."""
        gap = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (gap * gap).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each row, of equals the lowest index."""
        best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))
        self._visit(x, np.arange(len(x)), best, who)
        return who, best

    def _visit(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        if not len(rows):
            return
        if self.children is None:
            for i in self.index:
                gap = x[rows] - self.entries[i]
                far = (gap * gap).sum(1)
                better = (far < best[rows]) | ((far == best[rows]) & (i < who[rows]))
                best[rows[better]], who[rows[better]] = far[better], i
            return
        one, two = self.children
        to_one, to_two = one.apart(x[rows]), two.apart(x[rows])
        first = to_one <= to_two
        one._visit(x, rows[first], best, who)
        two._visit(x, rows[~first], best, who)
        # an equal bound is visited: it can hold an equal entry of a lower index
        two._visit(x, rows[first & (to_two <= best[rows])], best, who)
        one._visit(x, rows[~first & (to_one <= best[rows])], best, who)


def cuts(size: int, parts: int) -> list[int]:
    """Where the parts of a vector start and end."""
    return [size * p // parts for p in range(parts + 1)]


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        ends = np.cumsum(np.asarray(v.value_lengths()))
        x = np.clip(np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * UNIT), -LARGEST, LARGEST).astype("<i4")
        cells = [x[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(cells, pa.binary())], names=["id", "label", "v"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), size)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(at, ROWS_AT_ONCE)
            yield some, _matrix(some.column("v"), size)


def _sums(batches: Iterator[pa.RecordBatch], trees: list[Tree], at: list[int]) -> Iterator[pa.RecordBatch]:
    """Of a task: for each part, entry and component (place -1: the number of parts) one sum."""
    total = [np.zeros((len(t.entries), t.entries.shape[1] + 1), np.int64) for t in trees]
    for _, x in _chunks(batches, at[-1]):
        for tree, into, a, b in zip(trees, total, at[:-1], at[1:], strict=True):
            who, _ = tree.nearest(x[:, a:b])
            np.add.at(into, who, np.concatenate([x[:, a:b], np.ones((len(x), 1), np.int64)], 1))
    for p, into in enumerate(total):
        entry, place = np.nonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(np.where(place == into.shape[1] - 1, -1, place).astype(np.int32)), pa.array(into[entry, place])], names=["part", "entry", "place", "total"])


def _codes(batches: Iterator[pa.RecordBatch], trees: list[Tree], at: list[int]) -> Iterator[pa.RecordBatch]:
    for batch, x in _chunks(batches, at[-1]):
        found = [tree.nearest(x[:, a:b]) for tree, a, b in zip(trees, at[:-1], at[1:], strict=True)]
        code = np.stack([who for who, _ in found], 1).astype(np.uint8)
        error = sum(far for _, far in found)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(id, label, v) of the vectors that take part, and their length."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("v is not null")
    # exists() is null where a component is null; only a plain false keeps the row
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.where(F.size("v") == most["n"]), most["n"]) if most else (rows, 0)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error) of every vector that takes part, the codebooks).

    A code has two hex digits for each part, so ``entries`` is at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part")
    rows, size = usable(vectors, id_col, vector_col, label_col)
    kind = vectors.schema[label_col].dataType.simpleString()
    numbers = written(rows.mapInArrow(_integers, f"id long, label {kind}, v binary"), "vectors")
    at = cuts(size, parts)
    # by components: equal ids are told apart by their vectors
    start = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    first = np.clip(np.floor(np.array([r.v for r in start], np.float64).reshape(len(start), size) * UNIT), -LARGEST, LARGEST).astype(np.int64)
    books = [first[:, a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]
    for _ in range(rounds if start else 0):
        trees = [Tree(book) for book in books]
        sums = numbers.mapInArrow(lambda b, t=trees: _sums(b, t, at), "part int, entry int, place int, total long")
        found = {(r.part, r.entry, r.place): int(r.total) for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        for (p, e, place), count in list(found.items()):
            if place == -1:
                books[p][e] = [found.get((p, e, j), 0) // count for j in range(books[p].shape[1])]
    trees = [Tree(book) for book in books] if start else []
    coded = written(numbers.mapInArrow(lambda b: _codes(b, trees, at), f"id long, label {kind}, code string, error long"), "codes")
    drop_written(numbers)
    return coded, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir):
    """Code and error of every vector, with the error of its label."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    labels = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")  # written, so that the join is chosen by its real size
    out = coded.join(labels.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds as a chain of tables: parts, codebooks, nearest entries."""
    near = "SELECT vec_id, label, p, arg_min(e, d * 256 + e) AS e, min(d) AS d, any_value(x) AS x FROM (SELECT v.*, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN {book} b USING (p)) GROUP BY vec_id, label, p"
    chain = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, label, p, x[len(x) // {PARTS} * p + 1 : len(x) // {PARTS} * (p + 1)] AS x FROM k, range({PARTS}) t(p))",
        f"b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES})",
    ]
    for i in range(ROUNDS):
        chain += [
            f"n{i} AS MATERIALIZED ({near.format(book=f'b{i}')})",
            f"m{i} AS (SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT p, e, j, (s - ((s % c) + c) % c) // c AS m FROM (SELECT p, e, j, sum(y)::BIGINT AS s, count(*) AS c FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS j FROM n{i}) GROUP BY p, e, j)) GROUP BY p, e)",
            f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (p, e))",
        ]
    chain += [
        f"last AS MATERIALIZED ({near.format(book=f'b{ROUNDS}')})",
        "coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id, label)",
        f"sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS})",
    ]
    return f"WITH {', '.join(chain)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded, sha"


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _sql()}
