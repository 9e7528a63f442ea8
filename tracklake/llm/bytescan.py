"""Vectorised scans of text inside tasks: blocks of Arrow text, words, and hashes of byte runs.

All functions work on one block of rows, so memory follows the block and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


class Powers:
    """Powers of an odd step and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            for name, factor in (("up", _STEP), ("down", _INVERSE)):
                x = np.full(n, factor, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


_powers = Powers()


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the step, or of its inverse."""
    _powers.need(n + 1)
    return (_powers.down if inverse else _powers.up)[:n]


def byte_table(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z have the values of a-z."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
    if lower:
        table[65:91] = table[97:123]
    return table


def prefix(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix values of the polynomial hash of ``buf``; n + 1 of them."""
    _powers.need(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(table[buf] * _powers.up[: len(buf)], out=out[1:])
    return out


def run_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the byte runs [start, end)."""
    x = (pre[end] - pre[start]) * _powers.down[start]
    x += (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    return mix(x, seed)


@dataclass
class Block:
    """Consecutive rows of a batch: their bytes side by side, and where each text starts and ends."""

    first: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and null flags of a string or binary array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, buffers = len(column), column.buffers()
    null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
    if not n or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8), offsets, null


def blocks(column: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 256) -> Iterator[Block]:
    """Cut a column of texts into blocks; a text longer than ``most_bytes`` is a block of its own."""
    data, offsets, null = arrow_bytes(column)
    n, first = len(null), 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(last, first + 1), first + most_rows, n)
        base = offsets[first]
        start, end = offsets[first:last] - base, offsets[first + 1 : last + 1] - base
        yield Block(first, data[base : offsets[last]], start, np.where(null[first:last], start, end), null[first:last])
        first = last


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A flag for each byte that lies in one of the closed ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Word bytes: all but space and 9 to 13; and 0-9, a-z, A-Z (read as a-z) and all above 127.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


@dataclass
class Words:
    """Words of a block: byte runs, and for each row the range of its words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    count: np.ndarray
    row: np.ndarray


def words(block: Block, kind: np.ndarray) -> Words:
    inside = kind[block.buf]
    n = len(inside)
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[block.start[block.start < n]] = False
        after[block.end[block.end > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, block.start)
    count = np.searchsorted(start, block.end) - first
    return Words(start, end, first, count, np.repeat(np.arange(len(block)), count))


_MULTIPLIERS = mix(np.arange(1, 257, dtype=U64), 77) | U64(1)


def shingles(word_hash: np.ndarray, w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row, and their rows; a row of fewer words, but
    not none, has its whole sequence as one."""
    n = len(word_hash)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(w.first, w.count)
    full = np.flatnonzero(place + size <= np.repeat(w.count, w.count))
    total = np.zeros(len(full), U64)
    for j in range(size):
        total += word_hash[full + j] * _MULTIPLIERS[j]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    few = np.zeros(len(short), U64)
    for j in range(size - 1):
        has = w.count[short] > j
        few[has] += word_hash[w.first[short][has] + j] * _MULTIPLIERS[j]
    few += w.count[short].astype(U64) * U64(0x9FB21C651E98DF25)
    return mix(np.concatenate([total, few]), 3), np.concatenate([w.row[full], short])


#: Rows of a block at most, where a row number shares 64 bits with a hash.
KEY_ROWS, KEY_BITS = 256, 56


def row_sets(block: Block, table: np.ndarray, kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row: sorted keys (row << 56 | 56-bit hash), and the row of each."""
    w = words(block, kind)
    pre = prefix(block.buf, table)
    hashes, rows = shingles(run_hash(pre, w.start, w.end), w, size)
    keys = (rows.astype(U64) << U64(KEY_BITS)) | (hashes >> U64(64 - KEY_BITS))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, (keys >> U64(KEY_BITS)).astype(np.int64)
