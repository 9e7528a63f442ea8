"""Language of a text, by Bloom filters of n-grams that are sliced by bit: one look-up gives all languages that hold an n-gram.

A text is read as its letters: A-Z as a-z, bytes above 127 as they are, runs of all else as one space, with a space before and after. Its n-grams
are the runs of ``SIZES`` such bytes, known by a 64-bit hash. From a bounded sample of labelled texts (about ``MOST_TEXTS`` of each language, chosen by a hash of
id and length, so that no group of copies comes in or stays out as a whole) a language keeps the n-grams that stand in at least ``LEAST_TEXTS`` of its texts and whose share of its n-grams is at least ``LEAST_RATIO`` of the largest share
that any language gives them; of these the ``MOST_GRAMS`` most frequent.

The filters of all languages lie side by side: each slot has one bit for each language, and bit l of all slots is language l's own filter. What stands in the ``HASHES`` slots of an n-gram, taken
together by AND, is the mask of the languages that hold it. Per text, the set bits are counted for each language, what a filter of its fill says by mistake is
taken off, and the rest is divided by the share of held n-grams that the language's own sample has. The largest quotient decides; its part of the sum of all is the score.

Training is one pass that counts rows per language, one over the sample, and an aggregate; what comes to the driver is at most ``MOST_GRAMS`` hashes for each language and ``MOST_KEPT`` in all, and the broadcast
filters have at most ``MOST_BYTES``, with fewer slots where languages are many. Prediction reads whole texts, in pieces of ``PIECE`` bytes, in one pass without a shuffle.

Defined cases: a null text and one without a letter (of any script) are ``und`` with score 0; a text with letters of which no filter knows an n-gram gets the language of most labelled
rows, with score 0; ties go to the language of more labelled rows, then to the smaller name; rows without language teach nothing; equal rows are predicted each; without any language to
learn all is ``und``; an empty table stays empty; other columns are passed through, and a column of the name of a result is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import drop_written, small_batches, written

UNKNOWN = "und"
SIZES = (3, 5)
#: The sample of labelled rows, by language; what an n-gram needs to be kept; how many are.
MOST_TEXTS, LEAST_TEXTS, LEAST_RATIO, MOST_GRAMS, MOST_KEPT = 2000, 2, 0.5, 30_000, 4_000_000
#: Slots at most (a power of two, up to 2**21), slots that an n-gram sets, bytes of all slots at most.
SLOTS, HASHES, MOST_BYTES = 1 << 19, 3, 64 << 20
PIECE = 1 << 20
U64 = np.uint64
#: The bits of each byte value.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1

_LETTER = bs.byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_PLAIN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_PLAIN[65:91] += 32
_ASCII_LETTERS = bs.byte_class([(0x41, 0x5A), (0x61, 0x7A)])


def letters(data: np.ndarray) -> np.ndarray:
    """The letters of a text, other runs as one space, with a space at either end."""
    plain = np.concatenate([[32], _PLAIN[data], [32]]).astype(np.uint8)
    space = plain == 32
    return plain[~(space & np.concatenate([[False], space[:-1]]))]


def has_letter(data: np.ndarray) -> bool:
    if _ASCII_LETTERS[data].any():
        return True
    return bool((data > 127).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8", "replace")))


def grams(plain: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` bytes, which fit a word: an odd factor, and the upper bits folded down."""
    count = len(plain) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    code = plain[:count].astype(U64)
    for j in range(1, n):
        code <<= U64(8)
        code |= plain[j : j + count]
    code += U64(n) << U64(56)
    code *= U64(0x9E3779B97F4A7C15)
    code ^= code >> U64(32)
    code *= U64(0xD6E8FEB86659FD93)
    code ^= code >> U64(32)
    return code


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams of a text, a piece of its letters at a time; pieces overlap by what an n-gram needs, and one wholly in the overlap is the next piece's."""
    plain = letters(data)
    for at in range(0, len(plain), PIECE):
        yield np.concatenate([grams(plain[at : at + PIECE + n - 1], n) for n in SIZES])


@dataclass
class Filters:
    """The learned languages, their sliced filters (slots x bytes, a bit for each language) and what corrects their counts."""

    langs: list[str]
    slices: np.ndarray
    wrong: np.ndarray
    usual: np.ndarray

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """(n-grams x bytes): the languages that hold each n-gram."""
        out = None
        for at in slots_of(hashes, len(self.slices)):
            found = self.slices.take(at, axis=0)
            out = found if out is None else np.bitwise_and(out, found, out=out)
        return out

    def counts(self, masks: np.ndarray) -> np.ndarray:
        """Set bits of each language, from how often each byte value occurs."""
        found = [np.bincount(masks[:, i], minlength=256) @ _BITS for i in range(masks.shape[1])]
        return np.concatenate(found)[: len(self.langs)]

    def decide(self, held: np.ndarray, n: int) -> tuple[str, float]:
        right = np.maximum(held - n * self.wrong, 0) / (1 - self.wrong)
        share = right / max(n, 1) / self.usual
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum()) if share[best] > 0 else 0.0

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        if not self.langs or not has_letter(data):
            return UNKNOWN, 0.0
        held, n = np.zeros(len(self.langs), np.int64), 0
        for found in pieces(data):
            held += self.counts(self.masks(found))
            n += len(found)
        return self.decide(held, n)


def slots_of(hashes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The slots of n-grams: each of HASHES times 21 bits of the hash, cut to a power of two."""
    for k in range(HASHES):
        yield ((hashes >> U64(21 * k)) & U64(slots - 1)).view(np.int64)


def build(langs: list[str], kept: dict[str, np.ndarray], usual: list[float]) -> Filters:
    """Filters of n-gram hashes by language."""
    width = max(1, -(-len(langs) // 8))
    slots = min(SLOTS, 1 << max(10, (MOST_BYTES // width).bit_length() - 1))
    slices = np.zeros((slots, width), np.uint8)
    for i, lang in enumerate(langs):
        for at in slots_of(kept[lang], slots):
            slices[at, i // 8] |= 1 << i % 8
    fill = np.array([np.count_nonzero(slices[:, i // 8] & (1 << i % 8)) for i in range(len(langs))]) / slots
    return Filters(langs, slices, np.minimum(fill**HASHES, 0.999), np.maximum(np.array(usual), 1e-6))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, texts) of a batch."""
    for batch in batches:
        data, offsets, null = bs.arrow_bytes(batch.column("text"))
        n, texts = defaultdict(list), defaultdict(list)
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            if not null[i]:
                found = [np.unique(g, return_counts=True) for g in pieces(data[offsets[i] : offsets[i + 1]])]
                n[lang] += found
                texts[lang].append(np.unique(np.concatenate([g for g, _ in found])))
        for lang, found in n.items():
            every, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            count = np.bincount(at, np.concatenate([c for _, c in found]), len(every)).astype(np.int64)
            held = np.bincount(np.searchsorted(every, np.concatenate(texts[lang])), minlength=len(every)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(every), pa.string()), pa.array(every.view(np.int64)), pa.array(count), pa.array(held)], names=["lang", "gram", "n", "texts"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_texts: int = MOST_TEXTS, most_grams: int = MOST_GRAMS) -> Filters:
    """Filters of all languages that ``docs`` has; give only rows that may be learned from."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.length(F.col(f"`{text_col}`").cast("string"))).alias("key")).where("lang is not null")
    sizes = written(rows.groupBy("lang").count(), "languages")
    langs = [r.lang for r in sorted(sizes.collect(), key=lambda r: (-r["count"], r.lang.encode()))]
    most_grams = min(most_grams, MOST_KEPT // max(len(langs), 1))
    # by a share of the hash's range: about as many texts of each language, however many it has
    share = F.least(F.lit(1.0), most_texts / F.col("count"))
    sample = rows.where("text is not null").join(sizes, "lang").where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    counted = written(sample.mapInArrow(_learn, "lang string, gram long, n long, texts long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "grams")
    totals = written(counted.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    shares = counted.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    shares = shares.withColumn("largest", F.max("share").over(Window.partitionBy("gram")))
    some = shares.where((F.col("texts") >= LEAST_TEXTS) & (F.col("share") >= LEAST_RATIO * F.col("largest")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept: dict[str, list] = defaultdict(list)
    usual: dict[str, float] = defaultdict(float)
    for r in some.withColumn("rank", rank).where(F.col("rank") <= most_grams).select("lang", "gram", "share").toLocalIterator():
        kept[r.lang].append(r.gram)
        usual[r.lang] += r.share
    drop_written(sizes, counted, totals)
    return build(langs, {x: np.array(kept[x], np.int64).view(np.uint64) for x in langs}, [usual[x] for x in langs])


def _predict(texts: Iterator[pa.Array], filters: Filters) -> Iterator[pa.Array]:
    for column in texts:
        data, offsets, null = bs.arrow_bytes(column)
        found = [(UNKNOWN, 0.0) if null[i] else filters.predict(data[offsets[i] : offsets[i + 1]]) for i in range(len(column))]
        yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])


def predicted(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text goes to Python."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    # not deterministic in name only: else the optimizer would run it once for each field
    find = F.arrow_udf(lambda texts: _predict(texts, shared.value), "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*keep, find(F.col(f"`{text_col}`").cast("string")).alias("_found")).select(*keep, "_found.lang_pred", "_found.score")


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op13_language_id(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = train(docs.where(~held_out("doc_id")))
    return predicted(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), filters).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op13_language_id": op13_language_id}
SQL = {}
