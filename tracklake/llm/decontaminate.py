"""Benchmark decontamination as a prefix-filtered set join with exact windows.

A window is ``WINDOW`` consecutive words of an item (an item of fewer words, but not none, is one window).
A document contains a window if its words occur in it side by side. For containment in full, the prefix
that a join must look at is one token: each window is joined by its rarest two-word shingle, by
counts over all documents (a window of one word by that word). A match at word q of a document puts
the window at q - p for the shingle's place p; positional and length bounds drop what would not fit,
and the window's words are then compared one by one.

Counting and searching are passes over the texts without a shuffle of them, in which only the text goes to Python. The windows of at most ``BLOCK_BYTES``
of benchmark text go to the tasks at once; a larger benchmark is taken in more blocks of that size, each
an extra pass whose hits are added to those before, so that it never has to fit anywhere whole; long items are cut into
pieces that overlap by a window less a word, and repeated rows are taken once.

Defined cases: null or empty texts have no words; null, empty or wordless items and items without id have no window;
an item_id that repeats has the windows of all its rows; repeated documents are judged each; very long texts are scanned whole,
one at a time; of tokens equally rare in a window the first is joined; columns of documents, whatever their names, are kept in a struct and don't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import drop_written, small_batches, written

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: Words of a piece of an item, besides its overlap.
PIECE_WORDS = 4096
_TABLE = bs.byte_table(303, lower=True)
_ONE = bs.U64(0x51ED270B0A1F39C1)


@dataclass
class Windows:
    """Distinct windows of a block of items: words (padded with 0), sizes, and the items of each."""

    words: np.ndarray
    size: np.ndarray
    item_first: np.ndarray
    items: list[str]
    token: np.ndarray | None = None
    place: np.ndarray | None = None
    order: np.ndarray | None = None


def word_hashes(block: bs.Block) -> tuple[bs.Words, np.ndarray]:
    w = bs.words(block, bs.ALNUM)
    return w, bs.run_hash(bs.prefix(block.buf, _TABLE), w.start, w.end)


def tokens(hashes: np.ndarray) -> np.ndarray:
    """Two-word shingles by the place of their first word; the last place has none that is used."""
    out = np.zeros(len(hashes), bs.U64)
    out[:-1] = bs.mix(hashes[:-1] * bs.U64(0x9FB21C651E98DF25) + hashes[1:], 4)
    return out


def windows_of(items: list[tuple[str, str]], window: int) -> Windows:
    found: dict[tuple, set[str]] = {}
    for item, text in items:
        for block in bs.blocks(pa.array([text]), 1 << 62):
            _, h = word_hashes(block)
            n = min(window, len(h))
            for i in range(len(h) - n + 1 if n else 0):
                found.setdefault(tuple(h[i : i + n].tolist()), set()).add(item)
    keys = sorted(found)
    words = np.zeros((len(keys), window), bs.U64)
    for i, key in enumerate(keys):
        words[i, : len(key)] = key
    lists = [sorted(found[k]) for k in keys]
    return Windows(words, np.array([len(k) for k in keys], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), [x for y in lists for x in y])


def window_tokens(w: Windows) -> np.ndarray:
    """Tokens of each window (windows x places); a window of one word has that word, marked."""
    pair = bs.mix(w.words[:, :-1] * bs.U64(0x9FB21C651E98DF25) + w.words[:, 1:], 4) if w.words.shape[1] > 1 else np.zeros((len(w.words), 0), bs.U64)
    out = np.concatenate([pair, np.zeros((len(w.words), 1), bs.U64)], 1)
    one = w.size == 1
    out[one, 0] = w.words[one, 0] ^ _ONE
    return out


def _known(sorted_tokens: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x that are among the tokens, and which."""
    if not len(sorted_tokens) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.zeros(1 << 16, bool)
    bits[(sorted_tokens >> bs.U64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(x >> bs.U64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_tokens, x[maybe]), len(sorted_tokens) - 1)
    hit = sorted_tokens[at] == x[maybe]
    return maybe[hit], at[hit]


def _count(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, single: bool) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for block in bs.blocks(batch.column(0), most_rows=1 << 14):
            w, h = word_hashes(block)
            inner = np.ones(len(h), bool)
            inner[(w.first + w.count - 1)[w.count > 0]] = False
            total += np.bincount(_known(vocabulary, tokens(h)[inner])[1], minlength=len(total))
            if single:
                total += np.bincount(_known(vocabulary, h ^ _ONE)[1], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)), pa.array(total[some])], names=["token", "n"])


def choose_prefixes(docs: DataFrame, w: Windows, text_col: str) -> None:
    """Set the rarest token of each window, by its count over all documents."""
    every = window_tokens(w)
    used = np.arange(every.shape[1]) < np.maximum(w.size - 1, 1)[:, None]
    vocabulary = np.unique(every[used])
    single = bool((w.size == 1).any())
    counts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lambda b: _count(b, vocabulary, single), "token long, n long")
    n = np.zeros(len(vocabulary), np.int64)
    for row in counts.groupBy("token").agg(F.sum("n").alias("n")).collect():
        n[np.searchsorted(vocabulary, np.array(row.token).astype(np.int64).view(np.uint64))] = row.n
    if len(vocabulary):
        seen = np.where(used, n[np.minimum(np.searchsorted(vocabulary, every), len(vocabulary) - 1)], np.iinfo(np.int64).max)
        w.place = seen.argmin(axis=1)
        token = every[np.arange(len(every)), w.place]
    else:
        w.place, token = np.zeros(0, np.int64), np.zeros(0, bs.U64)
    w.order = np.argsort(token, kind="stable")
    w.token = token[w.order]


def _matches(w: Windows, words: bs.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in a block."""
    keys = [tokens(h)] + ([h ^ _ONE] if (w.size == 1).any() else [])
    starts, wins = [], []
    for key in keys:
        at, first = _known(w.token, key)
        count = np.searchsorted(w.token, key[at], "right") - first
        q = np.repeat(at, count)
        win = w.order[np.repeat(first, count) + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)]
        start = q - w.place[win]
        row = words.row[q]
        fits = (start >= words.first[row]) & (start + w.size[win] <= words.first[row] + words.count[row])
        start, win = start[fits], win[fits]
        same = np.ones(len(start), bool)
        for j in range(w.words.shape[1]):
            live = np.flatnonzero(same & (w.size[win] > j))
            same[live] = h[start[live] + j] == w.words[win[live], j]
        starts.append(start[same])
        wins.append(win[same])
    return np.concatenate(starts), np.concatenate(wins)


def covered(spans: list[int]) -> int:
    """Words in the union of spans."""
    total, reach = 0, 0
    for code in sorted(spans):
        start, size = code >> 32, code & 0xFFFFFFFF
        total += max(0, start + size - max(start, reach))
        reach = max(reach, start + size)
    return total


def _search(columns: Iterator[tuple[pa.Array, ...]], w: Windows, last: bool) -> Iterator[pa.Array]:
    """Of each text, with what earlier blocks found, the spans (start << 32 | words) and items of its windows; at ``last`` the
    words inside spans instead of the spans."""
    for text, before in columns:
        spans, items = ([x or [] for x in before.field(k).to_pylist()] for k in (0, 1))
        counts = np.zeros(len(text), np.int64)
        for block in bs.blocks(text, most_rows=1 << 14):
            words, h = word_hashes(block)
            counts[block.first : block.first + len(block)] = words.count
            start, win = _matches(w, words, h)
            row = words.row[start] if len(start) else np.zeros(0, np.int64)
            for r in np.unique(row):
                mine = row == r
                place = np.unique(((start[mine] - words.first[r]) << 32) | w.size[win[mine]])
                names = {w.items[i] for x in np.unique(win[mine]) for i in range(w.item_first[x], w.item_first[x + 1])}
                spans[block.first + r] = spans[block.first + r] + place.tolist()
                items[block.first + r] = sorted(names | set(items[block.first + r]))
        found = pa.array([covered(x) if x else 0 for x in spans], pa.int64()) if last else pa.array(spans, pa.list_(pa.int64()))
        yield pa.StructArray.from_arrays([found, pa.array(items, pa.list_(pa.string())), pa.array(counts)], names=["found", "items", "n_words"])


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Items, those of many words in pieces that overlap by a window less a word, so that no row is long."""
    for batch in batches:
        names, texts = [], []
        for block in bs.blocks(batch.column("text"), most_rows=1 << 14):
            w = bs.words(block, bs.ALNUM)
            for i in range(len(block)):
                first, count = int(w.first[i]), int(w.count[i])
                for at in range(0, max(count - window + 1, min(count, 1)), PIECE_WORDS):
                    end = min(at + PIECE_WORDS + window - 1, count)
                    texts.append(block.buf[w.start[first + at] : w.end[first + end - 1]].tobytes().decode())
                    names.append(batch.column("item")[block.first + i].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: (row struct of its columns, n_words, n_hit, items array of strings, sorted)."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    items = written(items.distinct().mapInArrow(lambda b: _pieces(b, window), "item string, text string").distinct(), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(F.array().cast("array<long>"), F.array().cast("array<string>")).alias("hits"))
    for k in range(blocks):
        some, last = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k), k == blocks - 1
        w = windows_of([(r["item"], r["text"]) for r in some.collect()], window)
        choose_prefixes(docs, w, text_col)
        shared = docs.sparkSession.sparkContext.broadcast(w)
        # not deterministic in name only: the optimizer must not copy the search into a filter on its result
        search = F.arrow_udf(lambda x, s=shared, z=last: _search(x, s.value, z), f"found {'long' if last else 'array<long>'}, items array<string>, n_words long", F.ArrowUDFType.SCALAR_ITER)
        out = out.withColumn("hits", search.asNondeterministic()("text", "hits"))
    drop_written(items)
    return out.select("row", "hits.n_words", F.col("hits.found").alias("n_hit"), "hits.items")


def op3_decontamination(spark, sf_dir):
    """Words of every document that are inside a benchmark window."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs.select("doc_id", "text"), items)
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op3_decontamination": op3_decontamination}
SQL = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[p : p + least({WINDOW}, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, iw.n, item_id FROM dw JOIN iw USING (n, s)),
spots AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN names USING (doc_id)"""
}
