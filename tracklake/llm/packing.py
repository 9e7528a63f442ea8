"""Token ids packed into rows of fixed length, best fit first, long documents in lossless pieces.

A task tokenises its documents into a pool of at most ``POOL_TOKENS`` tokens, cuts documents longer than a row into pieces (whole rows and a
rest), and packs the pieces of a pool by best fit, longest first: a segment tree over the room left in open rows finds the smallest room
that fits in log2(length) steps. Pools make packing independent of the size of the corpus and need no shuffle; with thousands of pieces in a pool
next to no room stays empty.

Each packed row has its ids (little-endian 16-bit matrix row, padded), cumulative segment lengths, the places where positions start again at 0,
and for each segment the document and the token of it that comes first, so that :func:`unpack` gives the ids of every document back.

Defined cases: null and empty texts have no tokens and are in no row; a null id is kept as null; repeated rows are packed each; ids that don't
fit 16 bits are refused; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
POOL_TOKENS = 1 << 22
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PAD = 50256
#: The word pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Rooms:
    """Open rows by the room they have: a segment tree whose nodes tell how many rows are below."""

    def __init__(self, length: int) -> None:
        self.width = 1 << length.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the smallest room of at least ``size``, removed."""
        node = size + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.width
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Pieces (by number) of each row; sizes are at most ``length``."""
    out: list[list[int]] = []
    rooms = Rooms(length)
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        if size == length or (found := rooms.take(size)) is None:
            out.append([piece])
            room, row = length - size, len(out) - 1
        else:
            room, row = found[0] - size, found[1]
            out[row].append(piece)
        if room:
            rooms.add(room, row)
    return out


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of this vocabulary don't fit 16 bits")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(documents: list[tuple[object, np.ndarray]], length: int, pad: int) -> pa.RecordBatch:
    """Packed rows of documents' ids."""
    owner, begin, size = [], [], []
    for i, (_, ids) in enumerate(documents):
        for at in range(0, len(ids), length):
            owner.append(i)
            begin.append(at)
            size.append(min(length, len(ids) - at))
    rows = best_fit(np.array(size, np.int64), length)
    matrix = np.full((len(rows), length), pad, "<u2")
    bounds, names, firsts = [], [], []
    for r, pieces in enumerate(rows):
        cuts = [0]
        for p in pieces:
            matrix[r, cuts[-1] : cuts[-1] + size[p]] = documents[owner[p]][1][begin[p] : begin[p] + size[p]]
            cuts.append(cuts[-1] + size[p])
        bounds.append(cuts)
        names.append([documents[owner[p]][0] for p in pieces])
        firsts.append([begin[p] for p in pieces])
    resets = [[c for c in cuts if c < length] for cuts in bounds]
    return pa.RecordBatch.from_arrays(
        [pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array(bounds, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
        names=["ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"],
    )


def _pack(batches: Iterator[pa.RecordBatch], path: str, length: int, pad: int) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(path)
    pool: list[tuple[object, np.ndarray]] = []
    held = 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid and (ids := np.array(encoding.encode_ordinary(text.as_py()), "<u2")).size:
                pool.append((name, ids))
                held += len(ids)
                if held >= POOL_TOKENS:
                    yield pack(pool, length, pad)
                    pool, held = [], 0
    if pool:
        yield pack(pool, length, pad)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """Rows (pack_id, ids, cu_seqlens, position_resets, doc_ids, doc_offsets)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
    out = texts.mapInArrow(lambda b: _pack(b, tokenizer, length, pad), schema)
    return out.select(F.monotonically_increasing_id().alias("pack_id"), "*")


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ``ids`` of consecutive rows side by side are the id matrix."""
    rows.write.parquet(path)


def positions(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions of a packed row, from 0 in every segment and in the padding."""
    cuts = sorted({*cu_seqlens, length})
    return np.concatenate([np.arange(b - a) for a, b in zip(cuts, cuts[1:], strict=False)])


def unpack(rows: DataFrame) -> DataFrame:
    """(doc_id, doc_offset, ids binary): the pieces of every document."""
    pieces = rows.select("ids", F.explode(F.arrays_zip("doc_ids", "doc_offsets", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("b"))).alias("p"))
    return pieces.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.doc_offsets").alias("doc_offset"), F.substring("ids", 2 * F.col("p.a") + 1, 2 * (F.col("p.b") - F.col("p.a"))).alias("ids"))


def op2_packing(spark, sf_dir):
    """All documents packed into rows of 2,048 ids."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_packing": op2_packing}
SQL = {}
