"""Toxicity by compression distance: how much better a dictionary of toxic text compresses a window.

Two zstandard dictionaries are trained on labelled text. Both hold the same body of frequent ordinary
words; the toxic one ends in strings that documents marked toxic hold far more often than others, the
ordinary one in as many bytes that match nothing. So a window that has nothing toxic compresses to
equal lengths, and the difference of the two lengths measures what toxic text explains in it.

Every window of every text is compressed with both. Windows whose difference reaches ``QUICK`` are
compressed again by a slower, exact parser, and the differences of a text become features: the two
largest, and how many reach calibrated thresholds. A logistic fit on other labelled rows than those of
the dictionaries makes the score. All fitting is on a sample of at most ``MOST_TOXIC`` and
``MOST_ORDINARY`` labelled rows of at most ``LONGEST`` bytes, the first by a hash of their id; scoring
reads whole texts and is one pass without a shuffle.

Defined cases: null and empty texts have no window and get the score of a text without any toxic window;
a null id counts as empty text for the split; labels that are null or of unknown ids are ignored;
repeated rows are scored each; without labels of both kinds the score is 0 or, if all are toxic, 1;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import small_batches

MOST_TOXIC, MOST_ORDINARY, LONGEST = 2000, 3000, 1 << 15
WINDOW, STRIDE = 64, 48
BODY, TOXIC_PART = 4000, 400
#: Bytes of the strings by which toxic and ordinary text are contrasted; least share of toxic texts that hold one; how much more often.
GRAM, LEAST_SHARE, LEAST_RATIO = 6, 0.04, 10
#: Longer strings that toxic texts share are passages and copies, not what makes them toxic.
LONGEST_PIECE = 24
QUICK, MOST_GAIN = 1, 12
#: Share of ordinary texts at most that may have a window of the upper threshold.
RARE = 0.005

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    """Both dictionaries, the calibrated thresholds and the fitted weights; a few kilobytes."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    constant: float | None = None
    thresholds: tuple[int, int] = (2, 4)


def _compressor(dictionary: bytes, careful: bool) -> zstandard.ZstdCompressor:
    kind = {"strategy": zstandard.STRATEGY_BTOPT, "min_match": 3} if careful else {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4}
    settings = zstandard.ZstdCompressionParameters(window_log=14, hash_log=12, chain_log=12, search_log=4, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0, **kind)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def _lengths(data: bytes, segments: np.ndarray, compressor: zstandard.ZstdCompressor) -> np.ndarray:
    if not len(segments):
        return np.zeros(0, np.int64)
    found = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.astype(np.uint64).tobytes()), threads=1)
    return np.fromiter(map(len, found), np.int64, len(segments))


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.quick, self.careful = ([_compressor(d, c) for d in (model.ordinary, model.toxic)] for c in (False, True))

    def gains(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, gain of its windows, largest first, windows of each row): bytes that the toxic dictionary saves more than the ordinary one, at most 12."""
        size = end - start
        count = np.where(size > 0, np.maximum(-(-(size - WINDOW) // STRIDE), 0) + 1, 0)
        row = np.repeat(np.arange(len(size)), count)
        at = start[row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        segments = np.stack([at, np.minimum(WINDOW, end[row] - at)], 1)
        data = _LOWER[buf].tobytes()
        quick = _lengths(data, segments, self.quick[0]) - _lengths(data, segments, self.quick[1])
        some = np.flatnonzero(quick >= QUICK)
        gain = _lengths(data, segments[some], self.careful[0]) - _lengths(data, segments[some], self.careful[1])
        row = row[some]
        order = np.lexsort((-gain, row))
        return row[order], np.clip(gain[order], 0, MOST_GAIN), count

    def features(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        row, gain, count = self.gains(buf, start, end)
        out = np.zeros((len(start), 5))
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        out[row[head], 0] = gain[head]
        second = head[np.concatenate([np.diff(head), [len(row) - head[-1]]]) > 1] + 1 if len(head) else head
        out[row[second], 1] = gain[second]
        for k, least in zip((2, 3), self.model.thresholds, strict=True):
            out[:, k] = np.log1p(np.bincount(row[gain >= least], minlength=len(start)))
        out[:, 4] = np.log1p(count)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        m = self.model
        z = (features - m.mean) / m.scale @ m.weight[1:] + m.weight[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def of_block(self, block: bs.Block) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(block), self.model.constant)
        return self.scores(self.features(block.buf, block.start, block.end))


def _grams(text: bytes) -> np.ndarray:
    a = _LOWER[np.frombuffer(text, np.uint8)].astype(np.uint64)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = (out << np.uint64(8)) | a[j : j + n]
    return np.unique(out)


def _fill(strings: list[bytes], size: int) -> bytes:
    """The first strings that fit, the first ones last, where offsets are shortest."""
    out = b""
    for s in strings:
        if s not in out:
            if len(out) + len(s) > size:
                break
            out = s + out
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from texts of either kind."""
    grams, count = np.unique(np.concatenate([_grams(t) for t in toxic]), return_counts=True)
    some = count >= max(3, LEAST_SHARE * len(toxic))
    grams, count = grams[some], count[some]
    other = np.zeros(len(grams), np.int64)
    for text in ordinary:
        found = np.searchsorted(grams, g := _grams(text))
        found = np.minimum(found, max(len(grams) - 1, 0))
        np.add.at(other, found[grams[found] == g] if len(grams) else found[:0], 1)
    ratio = ((count + 0.5) / (len(toxic) + 1)) / ((other + 0.5) / (len(ordinary) + 1))
    chosen = grams[ratio >= LEAST_RATIO]
    pieces: Counter[bytes] = Counter()
    for text in toxic:
        low = _LOWER[np.frombuffer(text, np.uint8)]
        n = len(low) - GRAM + 1
        if n <= 0 or not len(chosen):
            continue
        key = np.zeros(n, np.uint64)
        for j in range(GRAM):
            key = (key << np.uint64(8)) | low[j : j + n].astype(np.uint64)
        place = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
        at = np.flatnonzero(chosen[place] == key)
        if len(at):
            found = set()
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                if run[-1] - run[0] + GRAM <= LONGEST_PIECE:
                    found.add(low[run[0] : run[-1] + GRAM].tobytes())
            pieces.update(found)
    strings: list[bytes] = []
    for piece, n in pieces.most_common():
        if n >= max(3, LEAST_SHARE / 2 * len(toxic)) and not any(piece in s or s.strip() in piece for s in strings):
            strings.append(piece)
    part = _fill(strings, TOXIC_PART)
    words: Counter[bytes] = Counter()
    for text in ordinary:
        words.update(set(re.findall(rb"[^ ]+ ", _LOWER[np.frombuffer(text, np.uint8)].tobytes())))
    body = _fill([w for w, _ in words.most_common(8 * BODY) if len(w) >= 5], BODY)
    blank = bytes(np.random.default_rng(4).integers(1, 9, len(part), dtype=np.uint8))
    return body + blank, body + part


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept first, by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(row: np.ndarray, gain: np.ndarray, toxic: np.ndarray) -> tuple[int, int]:
    """The threshold that parts toxic from ordinary texts best, by whether any window reaches it, and a higher one that few ordinary texts reach."""
    best = np.zeros(len(toxic), np.int64)
    np.maximum.at(best, row, gain)
    shares = [((best[toxic] >= t).mean(), (best[~toxic] >= t).mean()) for t in range(1, MOST_GAIN + 1)]
    low = 1 + int(np.argmax([a - b for a, b in shares[:-1]]))
    high = next((t for t in range(low + 1, MOST_GAIN) if shares[t - 1][1] <= RARE), MOST_GAIN)
    return low, high


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """A model of labelled texts: two of three make the dictionaries, the third the thresholds and weights."""
    none = np.zeros(5)
    part = np.arange(len(texts)) % 3 < 2
    counts = [[np.sum(part_ & (toxic == k)) for k in (0, 1)] for part_ in (part, ~part)]
    if min(map(min, counts)) < 1:
        return Model(b"", b"", none, none, none, float(len(toxic) > 0 and toxic.all()))
    pick = lambda k: [t for t, p, y in zip(texts, part, toxic, strict=True) if p and y == k]
    ordinary, bad = dictionaries(pick(1), pick(0))
    model = Model(ordinary, bad, none, np.ones(5), np.zeros(6))
    scorer = Scorer(model)
    rest = [t for t, p in zip(texts, part, strict=True) if not p]
    ends = np.cumsum([len(t) for t in rest])
    block = np.frombuffer(b"".join(rest), np.uint8), ends - [len(t) for t in rest], ends
    model.thresholds = calibrated(*scorer.gains(*block)[:2], toxic[~part] > 0)
    features = scorer.features(*block)
    mean, scale = features.mean(0), np.maximum(features.std(0), 1e-6)
    return Model(ordinary, bad, mean, scale, _logistic((features - mean) / scale, toxic[~part].astype(float)), None, model.thresholds)


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    short = F.octet_length(F.col(text_col).cast("string"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), short.alias("size"))
    rows = []
    for y, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY)):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        found = texts.where(f"size > 0 and size <= {LONGEST}").join(F.broadcast(some), "id")
        rows += found.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()  # one text of an id that repeats
    rows.sort(key=lambda r: (zlib.crc32(f"order {r.id}".encode()), r.text))
    return fit([r.text.encode() for r in rows], np.array([r.y for r in rows], int))


def _score(texts: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    scorer = Scorer(model)
    for column in texts:
        parts = [scorer.of_block(b) for b in bs.blocks(column, most_rows=1 << 12)]
        yield pa.array(np.concatenate(parts) if parts else np.zeros(0))


def score(text: F.Column, model: Model) -> F.Column:
    """The toxicity of a text, from 0 to 1; only the text goes to Python, and only the score comes back."""
    return F.arrow_udf(lambda texts: _score(texts, model), "double", F.ArrowUDFType.SCALAR_ITER)(text.cast("string"))


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity_score") -> DataFrame:
    """``docs`` with a column ``name``, from 0 to 1, in place of one that has this name."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, score(F.col(f"`{text_col}`"), model))


def op6_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
SQL = {}
