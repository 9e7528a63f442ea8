"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Index: vectors are centred, normalised and rotated; a code keeps the sign of each coordinate, packed in 64-bit
words, with two correction scalars, the distance from the centre and the code's inner product with its
vector. All rows are indexed; only the centre (the mean over all rows) is fitted.

Search: a block of queries meets every partition of codes. A query's coordinates are quantised to
``PLANES`` bits, so that inner products with codes are sums of population counts. Divided by the scalar they
estimate the inner product of the vectors; the estimate's bound, ``BOUND`` standard deviations plus the
quantisation's largest error, gives the least distance a row can have, and only rows whose least distance reaches
the tenth best so far are measured on the original vectors. Each partition hands on its best rows per query.

Queries are taken in blocks of ``QUERIES_AT_ONCE``, so that what is sent to tasks is bounded (about 20 MB at 64 components); one pass over the codes
serves a block, and a task compares the block in parts of ``COMPARED``. A partition keeps k rows for each query of a block. Scans of codes grow with queries
times rows, which exact recall asks for.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; ties go to the smaller id; rows without id are neither queries nor candidates, as they could not be told; an id that repeats counts
by rows: each of its rows has a list of its own, and is a candidate for the others; with fewer candidates than k all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, written

PLANES, BOUND = 6, 3.5
QUERIES_AT_ONCE, COMPARED = 16_384, 1024
#: Rows of codes compared at once with a block of queries.
ROWS_AT_ONCE = 512


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the vectors that take part, and their length."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    # exists() is null where a component is null; only a plain false keeps the row
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.where(F.size("v") == most["n"]), most["n"]) if most else (rows, 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(size), 0
    for batch in batches:
        total += _matrix(batch.column("v"), size).sum(0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "v"])


def centre_of(rows: DataFrame, size: int) -> np.ndarray:
    total, n = np.zeros(size), 0
    for part in rows.mapInArrow(lambda b: _sums(b, size), "n long, v array<double>").toLocalIterator():
        total, n = total + np.array(part["v"]), n + part["n"]
    return total / max(n, 1)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, distances from the centre, inner products of code and vector)."""
    d = x.shape[1]
    y = x - centre
    radius = np.sqrt((y * y).sum(1))
    o = (y / np.maximum(radius, 1e-300)[:, None]) @ turn
    bits = np.zeros((len(x), -(-d // 64) * 64), np.uint8)
    bits[:, :d] = o > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), radius, np.abs(o).sum(1) / np.sqrt(d)


def _index(batches: Iterator[pa.RecordBatch], size: int, centre: np.ndarray, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, radius, inner = encode(_matrix(batch.column("v"), size), centre, turn)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(radius), pa.array(inner)], names=["row", "id", "v", "code", "radius", "inner"])


class Search:
    """A block of queries, and the best k rows of each so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> None:
        self.rows, self.vectors, self.k = rows, vectors, k
        y = vectors - centre
        self.radius = np.sqrt((y * y).sum(1))
        q = (y / np.maximum(self.radius, 1e-300)[:, None]) @ turn
        d = q.shape[1]
        self.d, self.low = d, q.min(1)
        self.step = np.maximum((q.max(1) - self.low) / (2**PLANES - 1), 1e-12)
        level = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        fitted = self.low[:, None] + self.step[:, None] * level
        self.off, self.total = np.abs(q - fitted).sum(1) / np.sqrt(d), fitted.sum(1)
        bits = np.zeros((PLANES, len(q), -(-d // 64) * 64), np.uint8)
        for j in range(PLANES):
            bits[j, :, :d] = (level >> j) & 1
        self.planes = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.best = np.full((len(q), k), np.inf)
        self.who = np.full((len(q), k), np.iinfo(np.int64).max)

    def least(self, code: np.ndarray, radius: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The least squared distance (queries x rows) that the bounds allow."""
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        weighted = np.zeros((len(self.rows), len(code)), np.int32)
        for j in range(PLANES):
            for word in range(code.shape[1]):
                weighted += np.bitwise_count(self.planes[j, :, word, None] & code[None, :, word]).astype(np.int32) << j
        dot = 2 * (self.low[:, None] * ones + self.step[:, None] * weighted) - self.total[:, None]
        inner = np.maximum(inner, 1e-9)
        slack = BOUND * np.sqrt(np.maximum(1 - inner**2, 0) / max(self.d - 1, 1)) / inner
        upper = np.minimum((dot / np.sqrt(self.d) + self.off[:, None]) / inner + slack, 1)
        return self.radius[:, None] ** 2 + radius**2 - 2 * self.radius[:, None] * radius * upper

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, code: np.ndarray, radius: np.ndarray, inner: np.ndarray) -> None:
        least = self.least(code, radius, inner)
        least[self.rows[:, None] == rows] = np.inf
        first = np.argpartition(least, min(self.k, len(ids)) - 1, axis=1)[:, : self.k]
        done = np.zeros(least.shape, bool)
        np.put_along_axis(done, first, True, axis=1)
        self.measure(*np.nonzero(done & np.isfinite(least)), ids, x)
        reach = self.best[:, -1] ** 2
        self.measure(*np.nonzero(~done & (least <= (reach * (1 + 1e-9) + 1e-12)[:, None]) & np.isfinite(least)), ids, x)

    def measure(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Exact distances of pairs; the best k of each query stay."""
        if not len(query):
            return
        parts = [slice(i, i + 65536) for i in range(0, len(query), 65536)]  # summed coordinate by coordinate, in their order
        distance = np.concatenate([np.sqrt(np.ascontiguousarray(((self.vectors[query[s]] - x[row[s]]) ** 2).T).sum(0)) for s in parts])
        some = distance <= self.best[query, -1]
        query, row, distance = query[some], row[some], distance[some]
        live = np.unique(query)
        all_q = np.concatenate([query, np.repeat(live, self.k)])
        all_d = np.concatenate([distance, self.best[live].ravel()])
        all_i = np.concatenate([ids[row], self.who[live].ravel()])
        order = np.lexsort((all_i, all_d, all_q))
        all_q, all_d, all_i = all_q[order], all_d[order], all_i[order]
        take = np.searchsorted(all_q, live)[:, None] + np.arange(self.k)
        self.best[live], self.who[live] = all_d[take], all_i[take]


def _search(batches: Iterator[pa.RecordBatch], block: tuple, size: int, centre: np.ndarray, turn: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    parts = [Search(*(x[i : i + COMPARED] for x in block), centre, turn, k) for i in range(0, len(block[0]), COMPARED)]
    for batch in batches:
        rows, ids, x = batch.column("row").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("v"), size)
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
        radius, inner = (batch.column(c).to_numpy() for c in ("radius", "inner"))
        for i in range(0, len(ids), ROWS_AT_ONCE):
            s = slice(i, i + ROWS_AT_ONCE)
            for search in parts:
                search.add(rows[s], ids[s], x[s], code[s], radius[s], inner[s])
    for search in parts:
        query, place = np.nonzero(np.isfinite(search.best))
        yield pa.RecordBatch.from_arrays([pa.array(search.rows[query]), pa.array(search.who[query, place]), pa.array(search.best[query, place])], names=["query_row", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which ``is_query`` (SQL over id) holds."""
    spark = vectors.sparkSession
    schema = "query_row long, vec_id long, score double"
    rows, size = usable(vectors, id_col, vector_col)
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre, turn = centre_of(rows, size), rotation(size)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")  # written below, so that a row keeps its number
    index = written(numbered.mapInArrow(lambda b: _index(b, size, centre, turn), "row long, id long, v array<double>, code binary, radius double, inner double"), "codes")
    queries = index.where(is_query).select("row", "v")
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    found = []
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
        if part:
            block = spark.sparkContext.broadcast((np.array([r.row for r in part]), np.array([r.v for r in part])))
            found.append(written(index.mapInArrow(lambda x, q=block: _search(x, q.value, size, centre, turn, k), schema), "near"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    best = written(every.withColumn("rank", rank).where(F.col("rank") <= k), "nearest")
    names = index.where(is_query).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    out = written(best.join(names, "query_row").select("query_id", "rank", "vec_id", "score"), "neighbours")
    drop_written(index, best, *found)
    return out


def op7_nearest(spark, sf_dir):
    """Ten nearest vectors of every hundredth."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 100 = 0")


QUERIES = {"op7_nearest": op7_nearest}
SQL = {
    "op7_nearest": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
