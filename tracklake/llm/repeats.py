"""Removal of byte strings that occur more than once in a corpus, by suffix intervals.

A string of ``LENGTH`` bytes (a window) repeats if it starts at two places. One suffix array over the
whole corpus would not divide over tasks, so the windows are divided first, without losing any pair:

1. Every window has an anchor, its 32-byte string of least hash (the leftmost of equals). Equal
   windows have equal anchors at equal places. Consecutive windows with one anchor make a *run*, and
   its bytes a *context*; each window of the corpus lies in exactly one run. About one byte in 185
   starts a run, and only (anchor hash, context hash, place) of it are shuffled.
2. Anchors seen once are done. Contexts that are equal in whole repeat in whole; those that meet in one block of
   texts are known to at once, and one of them stands for all in the shuffles that follow.
3. Different contexts of one anchor are gathered, one copy of each, in batches of whole groups. In a
   task, a context stays if it shares an aligned string of at least 354 bytes with another. Over
   those, suffixes are sorted to depth ``LENGTH``; breadth-first backward extension of intervals on
   the Burrows-Wheeler transform sets the common prefixes of neighbours in increasing order and stops
   at ``LENGTH``: where none is set, neighbours share a window.
4. Groups of more than ``GROUP_CONTEXTS`` different contexts don't go to one task: their windows are
   counted by hash instead, which is exact too.

Strings of 400 bytes say nothing of shorter passages. :func:`repeated_passages` reports those by words beside the removal, without
removing anything: of each window of ``PASSAGE`` words the run of ``RUN`` words with the least hash is kept, which equal windows share, and the kept runs that
also stand elsewhere are counted. About two words in nineteen start a kept run.

Defined cases: a null text is empty; texts shorter than a window lose nothing; a row given twice repeats
all its windows, whatever its id, null included; very long texts are scanned in pieces that overlap by a window; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as bs
from .shared import drop_written, small_batches, written

LENGTH, ANCHOR = 400, 32
#: Words of a passage that is reported for sure, and of the runs by which passages find one another.
PASSAGE, RUN = 50, 32
#: Different contexts of an anchor that one task takes; bytes of contexts that it sorts at once.
GROUP_CONTEXTS, BATCH_BYTES = 4096, 1 << 20
#: Bytes of a text scanned at once.
PIECE = 1 << 22
_PLACE = bs.U64((1 << 24) - 1)
_TABLE = bs.byte_table(202, lower=False)


def runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts [start, end) of ``buf``: (row, first window, bytes, anchor's offset, anchor hash, context hash)."""
    count = np.maximum(end - start - length + 1, 0)
    if not count.any():
        return (np.zeros(0, np.int64),) * 6
    pre = bs.prefix(buf, _TABLE)
    place = np.arange(len(buf) - anchor + 1)
    hashes = bs.run_hash(pre, place, place + anchor)
    key = (hashes & ~_PLACE) | place.astype(bs.U64)
    width = length - anchor + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, bs.U64)
    padded[: len(key)] = key
    tiles = padded.reshape(-1, width)
    forward = np.minimum.accumulate(tiles, axis=1).ravel()
    backward = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    row = np.repeat(np.arange(len(start)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + start[row]
    least = np.minimum(backward[window], forward[window + width - 1])
    change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([change[1:], [len(row)]]) - 1
    low, high = window[change], window[last] + length
    at = (least[change] & _PLACE).astype(np.int64)
    return row[change], low, high - low, at - low, bs.mix(hashes[at], 21), bs.run_hash(pre, low, high, 22)


def _scan(batches: Iterator[pa.RecordBatch], length: int, anchor: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for block in bs.blocks(batch.column(1), most_rows=1 << 14):
            pieces = [(block.buf, block.start, block.end, 0)]
            if len(block) == 1 and len(block.buf) > most:
                cuts = range(0, len(block.buf) - length + 1, most)
                pieces = [(part := block.buf[c : c + most + length - 1], np.zeros(1, np.int64), np.array([len(part)]), c) for c in cuts]
            for buf, start, end, skip in pieces:
                row, low, size, at, a, c = runs(buf, start, end, length, anchor)
                if len(row):
                    _, head, count = np.unique(c, return_index=True, return_counts=True)
                    stands_for = np.zeros(len(row), np.int32)
                    stands_for[head] = count
                    columns = [keys[block.first + row], low - start[row] + skip, size.astype(np.int32), at.astype(np.int32), a.view(np.int64), c.view(np.int64), stands_for]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "low", "size", "at", "a", "c", "k"])


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (0 to 256), sorted by their first ``depth`` symbols."""
    n, have = len(symbols), min(7, depth)
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = symbols
    key = np.zeros(n, np.int64)
    for j in range(have):
        key = (key << 9) | wide[j : j + n]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        step = np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)]).cumsum()
        if have >= depth or step[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        ahead = min(have, depth - have)
        key = rank * (n + 1)
        key[: n - ahead] += rank[ahead:]
        have += ahead


def repeats_by_intervals(symbols: np.ndarray, depth: int) -> np.ndarray:
    """A flag for each place whose first ``depth`` symbols also start elsewhere; the last symbol is 0.

    Breadth-first over intervals of suffixes with a common prefix: extending all of one length to the
    left, by the transform's symbols, gives those of the next length. The end of a new interval bounds
    a common prefix; each bound is set once, so intervals in all are at most as many as symbols.
    """
    n = len(symbols)
    order = suffix_order(symbols, depth)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = order - 1
    transform, step = symbols[before].astype(np.int64), rank[before]
    transform[order == 0] = 257
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(depth):
        size = high - low + 1
        of = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]
        key = (of * 258 + transform[place]) * n + step[place]
        key.sort()
        group = key // n
        cut = np.flatnonzero(group[1:] != group[:-1])
        first, last = key[np.concatenate([[0], cut + 1])] % n, key[np.concatenate([cut, [len(key) - 1]])] % n
        fresh = open_[last + 1]
        low, high = first[fresh], last[fresh]
        if not len(low):
            break
        open_[high + 1] = False
    out = np.zeros(n, bool)
    out[order] = open_[:n] | open_[1:]
    return out


def _sharing(buf: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Contexts that agree with another of their group on the anchor and 7/8 of a window around it, split in any way."""
    pre = bs.prefix(buf, _TABLE)
    out = np.zeros(len(start), bool)
    part = (length - anchor) // 8
    for i in range(8):
        low, high = start + at - i * part, start + at + anchor + (7 - i) * part
        fits = np.flatnonzero((low >= start) & (high <= start + size))
        if len(fits):
            key = bs.mix(bs.run_hash(pre, low[fits], high[fits]) ^ group[fits].view(bs.U64))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            out[fits[count[inverse] > 1]] = True
    return out


def _intervals(table: pa.Table, length: int, anchor: int) -> pa.RecordBatch:
    """Repeated spans of contexts that occur once, over whole groups of contexts."""
    data, offsets, _ = bs.arrow_bytes(table.column("context"))
    start, size = offsets[:-1], np.diff(offsets)
    group, at, n = (table.column(k).to_numpy() for k in ("a", "at", "n"))
    stay = np.flatnonzero(_sharing(data[: offsets[-1]], start, size, at, group, length, anchor))
    keys, spans = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(stay):
        take = np.repeat(start[stay] - np.concatenate([[0], np.cumsum(size[stay] + 1)[:-1]]), size[stay] + 1) + np.arange((size[stay] + 1).sum())
        symbols = data[np.minimum(take, len(data) - 1)].astype(np.int64) + 1
        ends = np.cumsum(size[stay] + 1)
        symbols[ends - 1] = 0
        flag = repeats_by_intervals(symbols, length).astype(np.int8)
        begin = ends - size[stay] - 1
        owner = np.repeat(np.arange(len(stay)), size[stay] + 1)
        flag[np.arange(len(flag)) > (ends - 1 - length)[owner]] = 0
        edge = np.diff(np.concatenate([[0], flag, [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        own = owner[low]
        once = n[stay[own]] == 1
        low, high, own = low[once], high[once], own[once]
        base = table.column("low").to_numpy()[stay[own]] - begin[own]
        keys.append(table.column("key").to_numpy()[stay[own]])
        spans.append(((low + base) << 31) | (high - 1 + length - low))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(spans))], names=["key", "span"])


def _search(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are searched together once they make a batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            lengths = np.diff(bs.arrow_bytes(batch.column("context"))[1])[first:].cumsum()
            last = first + int(np.searchsorted(lengths, BATCH_BYTES)) + 1
            part = batch.slice(first, last - first)
            held.append(part)
            size += int(lengths[len(part) - 1])
            first += len(part)
            if size >= BATCH_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                a = table.column("a").to_numpy()
                keep = int(np.argmax(a == a[-1]))
                if keep:
                    yield _intervals(table.slice(0, keep).combine_chunks(), length, anchor)
                rest = table.slice(keep).combine_chunks()
                held = rest.to_batches()
                size = int(pc.sum(pc.binary_length(rest.column("context"))).as_py()) if keep else 0
    if held:
        yield _intervals(pa.Table.from_batches(held).combine_chunks(), length, anchor)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, wanted runs) to one row per run with its bytes."""
    for batch in batches:
        data, offsets, _ = bs.arrow_bytes(batch.column("text"))
        want = batch.column("want")
        row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(want)))
        flat = want.flatten()
        low, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("low", "size"))
        start = offsets[row] + low
        for first in range(0, len(row), 8192):
            some = slice(first, first + 8192)
            texts = pa.array([data[s : s + z].tobytes() for s, z in zip(start[some], size[some], strict=True)], pa.binary())
            part = flat.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([part.field("a"), part.field("n"), part.field("large"), batch.column("key").take(pa.array(row[some])), part.field("low"), part.field("at"), texts], names=["a", "n", "large", "key", "low", "at", "context"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All windows of contexts, by two hashes."""
    tables = [bs.byte_table(s, lower=False) for s in (203, 204)]
    for batch in batches:
        data, offsets, _ = bs.arrow_bytes(batch.column("context"))
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            place = np.arange(len(text) - length + 1)
            h1, h2 = (bs.run_hash(bs.prefix(text, t), place, place + length).view(np.int64) for t in tables)
            n, key, low = (batch.column(k)[i].as_py() for k in ("n", "key", "low"))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(place), key)), pa.array(((low + place) << 31) | length), pa.array(np.full(len(place), n))], names=["h1", "h2", "key", "span", "n"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of spans (start << 31 | length) as rows (start, end), in order."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = np.sort(spans)
    start = spans >> 31
    end = np.maximum.accumulate(start + (spans & ((1 << 31) - 1)))
    head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[head], end[np.concatenate([head[1:], [len(end)]]) - 1]], 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.encode(F.col(text_col).cast("string"), "utf-8"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("id", "text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (key, spans): for texts that hold repeated windows, the covered spans as start << 31 | length."""
    small_batches(docs.sparkSession)
    anchor = min(ANCHOR, length)
    texts = _keyed(docs, id_col, text_col).select("key", "text")
    most = PIECE
    every = texts.mapInArrow(lambda b: _scan(b, length, anchor, most), "key long, low long, size int, at int, a long, c long, k int")
    every = written(every, "runs")
    span = "shiftleft(low, 31) | size as span"
    known = every.where("k = 0").selectExpr("key", span)
    heads = every.where("k > 0")
    # aggregates are written before they are joined: the engine splits a hot key only between plain tables
    seen = heads.groupBy("a").agg(F.sum("k").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    seen = written(seen.selectExpr("a", "c0 != c1 as mixed"), "seen")
    found = written(heads.join(seen, "a"), "found")
    classes = found.groupBy("a", "c").agg(F.sum("k").alias("n"), F.min(F.struct("key", "low", "size", "at")).alias("one"), F.first("mixed").alias("mixed"))
    classes = written(classes, "contexts")
    whole = found.join(classes.where("n > 1").select("a", "c"), ["a", "c"]).selectExpr("key", span)
    mixed = classes.where("mixed")
    large = written(mixed.groupBy("a").count().where(F.col("count") > GROUP_CONTEXTS).select("a", F.lit(True).alias("large")), "large")
    wanted = mixed.join(large, "a", "left").fillna(False, ["large"])
    wanted = wanted.select(F.col("one.key").alias("key"), F.struct("a", "n", "large", "one.low", "one.size", "one.at").alias("w"))
    wanted = wanted.groupBy("key").agg(F.collect_list("w").alias("want"))
    gathered = texts.join(wanted, "key").mapInArrow(_contexts, "a long, n long, large boolean, key long, low long, at int, context binary")
    gathered = written(gathered, "gathered")
    small = gathered.where("not large").repartition("a").sortWithinPartitions("a", "key", "low")
    part = small.mapInArrow(lambda b: _search(b, length, anchor), "key long, span long")
    windows = gathered.where("large").mapInArrow(lambda b: _windows(b, length), "h1 long, h2 long, key long, span long, n long")
    again = written(windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "again")
    hit = windows.where("n = 1").join(again, ["h1", "h2"]).select("key", "span")
    # a set: rows that are equal share a key, and each brings the same spans
    spans = known.union(whole).union(part).union(hit).groupBy("key").agg(F.collect_set("span").alias("spans"))
    out = written(spans, "spans")
    drop_written(every, seen, found, classes, large, gathered, again)
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = bs.arrow_bytes(batch.column("text"))
        codes = batch.column("spans")
        lists = np.asarray(pc.fill_null(pc.list_value_length(codes), 0))
        flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lists)
        kept, starts, stops = [], [], []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            spans = merged(flat[ends[i] - lists[i] : ends[i]])
            if len(spans):
                bounds = np.concatenate([[0], spans.ravel(), [len(text)]]).reshape(-1, 2)
                kept.append(b"".join(text[a:b].tobytes() for a, b in bounds))
            else:
                kept.append(text.tobytes())
            starts.append(spans[:, 0])
            stops.append(spans[:, 1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64())), batch.column("n_passages")],
            names=["id", "n_bytes", "kept", "starts", "ends", "n_passages"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passages: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_bytes, kept binary, starts, ends), the bytes that stay and
    the spans [start, end) that were removed; n_passages, by the table of :func:`repeated_passages` where it is given."""
    spans = repeated_spans(docs, id_col, text_col, length)
    keyed = _keyed(docs, id_col, text_col).join(spans, "key", "left")
    beside = F.lit(0).cast("long") if passages is None else F.coalesce("n_passages", F.lit(0))
    if passages is not None:
        keyed = keyed.join(passages.hint("merge"), "key", "left")  # in the order of the join before
    kind = docs.schema[id_col].dataType
    out = keyed.select("id", "text", "spans", beside.alias("n_passages"))
    schema = T.StructType([T.StructField("id", kind)]).add("n_bytes", "long").add("kept", "binary").add("starts", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType())).add("n_passages", "long")
    return out.mapInArrow(_remove, schema).withColumnRenamed("id", id_col)


def _passages(batches: Iterator[pa.RecordBatch], words: int, run: int) -> Iterator[pa.RecordBatch]:
    """Of all runs of ``run`` words inside each window of ``words`` words, the one of least hash, the leftmost of equals; each place once."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for block in bs.blocks(batch.column("text"), most_rows=1 << 14):
            w = bs.words(block, bs.NOT_SPACE)
            h = bs.run_hash(bs.prefix(block.buf, _TABLE), w.start, w.end)
            n, width = len(h), words - run + 1
            full = np.flatnonzero(np.arange(n) - np.repeat(w.first, w.count) + words <= np.repeat(w.count, w.count))
            if not len(full):
                continue
            total = np.concatenate([[bs.U64(0)], np.cumsum(h * bs.powers(n), dtype=bs.U64)])
            runs = bs.mix((total[run:] - total[:-run]) * bs.powers(n - run + 1, inverse=True), 31)
            least, at = runs[full], full.copy()
            for step in range(1, width):
                other = runs[full + step]
                better = other < least
                least, at = np.where(better, other, least), np.where(better, full + step, at)
            at = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(keys[block.first + w.row[at]]), pa.array(runs[at].view(np.int64))], names=["key", "h"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE, run: int = RUN) -> DataFrame:
    """Rows (key, n_passages): how many runs of ``run`` words, chosen by their hashes, a text shares with another place.

    Every passage of at least ``words`` words (between blanks, as they are) that also stands elsewhere has one, as both places choose alike; texts that share no
    ``run`` words have none.
    """
    small_batches(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col).select("key", "text")
    every = written(texts.mapInArrow(lambda b: _passages(b, words, run), "key long, h long"), "passages")
    again = written(every.groupBy("h").count().where("count > 1").select("h"), "again")
    out = written(every.join(again, "h").groupBy("key").agg(F.count("*").alias("n_passages")), "passage-counts")
    drop_written(every, again)
    return out


def op10_suffix_dedup(spark, sf_dir):
    """What 400-byte repeats leave of every document, and its passages of 50 words that are also found elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, passages=repeated_passages(docs))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
SQL = {}
