"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. Each text becomes its set of word shingles (64-bit hashes), a fingerprint of the set, a
   one-permutation signature (one hash, ``BINS`` bins, the least value of each bin) whose empty bins
   borrow from a bin chosen by a random probe order of their own (optimal densification), and
   ``BANDS`` band hashes. Equal sets are one class from here on: copies never meet in pairs.
2. Rows that share a band bucket get a star: one edge from the bucket's smallest id to each other
   member, so a bucket of n rows makes n - 1 candidates. Candidates pass a length bound, an estimate
   from the signatures (only where both sets are large, and far below the threshold) and an exact
   check on the full sets, made anew from the texts.
3. Verified edges make components. A bucket whose members are still in several components may hide
   links that its star did not try. While that leaves many comparisons it gets more stars, around
   other members and only to members of other components. Where several components still remain, the members outside the
   bucket's largest one are compared with all others by their sets, in blocks of bounded
   size, and the links that this finds are verified in the same way.

At similarity 0.8 a pair shares none of the 32 bands of 4 bins with probability 5e-8, if its bins are
independent. Those of sets that fill few bins are not: borrowed values repeat, and shares of equal bins
spread wider. So the estimate is not asked about pairs whose smaller set has under ``ESTIMATED`` shingles.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text of
fewer words than a shingle has its whole sequence as one shingle; a null id is kept, unlinked, with a
null component; repeated ids count as one document, with the links of all its rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import components, drop_written, small_batches, written

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
#: A pair of large sets is verified if at least this share of its signatures agrees: 4 standard deviations below 0.8.
LEAST_AGREEMENT = 0.66
#: Shingles of the smaller set from which on the estimate is asked.
ESTIMATED = 128
#: Stars, besides their first, that buckets of several components get around other members while more comparisons would be left
#: than COMPARED_PER_ROW for each row of the table.
TURNS, COMPARED_PER_ROW = 4, 4096
#: Rows of a bucket that one task compares with as many others.
BLOCK_ROWS = 2048

_TABLE = bs.byte_table(101, lower=True)
_VALUE_BITS = bs.KEY_BITS - 7
_PROBES = np.stack([np.random.default_rng(1000 + j).permutation(BINS) for j in range(BINS)])
_BAND_SALT = bs.mix(np.arange(BANDS, dtype=bs.U64), 5)
_EMPTY = np.iinfo(np.uint64).max


def signature(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Densified signatures (n x BINS) of sorted row sets; a row without shingles stays empty."""
    out = np.full((n, BINS), _EMPTY, bs.U64)
    if not len(keys):
        return out
    cell = keys >> bs.U64(_VALUE_BITS)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    bins = (cell[first] & bs.U64(BINS - 1)).astype(np.int64)
    out[rows[first], bins] = keys[first] & bs.U64((1 << bs.KEY_BITS) - 1)
    filled = out != _EMPTY
    row, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for attempt in range(BINS):
        if not len(row):
            break
        source = _PROBES[empty, attempt]
        hit = filled[row, source]
        out[row[hit], empty[hit]] = out[row[hit], source[hit]]
        row, empty = row[~hit], empty[~hit]
    return out


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in bs.blocks(batch.column(1), most_rows=bs.KEY_ROWS):
            n = len(block)
            keys, rows = bs.row_sets(block, _TABLE, bs.NOT_SPACE, size)
            bounds = np.searchsorted(rows, np.arange(n + 1))
            low = keys & bs.U64((1 << bs.KEY_BITS) - 1)
            fingerprint = []
            for seed in (11, 12):
                total = np.concatenate([[bs.U64(0)], np.cumsum(bs.mix(low, seed), dtype=bs.U64)])
                fingerprint.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            sig = signature(keys, rows, n)
            band = np.zeros((n, BANDS), bs.U64)
            for j in range(ROWS):
                band = bs.mix(band ^ sig[:, j::ROWS], j)
            band = bs.mix(band + _BAND_SALT, 9).view(np.int64)
            count = np.diff(bounds)
            full = count > 0
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(band[full].ravel()))
            packed = (sig & bs.U64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, n), pa.array(count.astype(np.int64)), pa.array(fingerprint[0]), pa.array(fingerprint[1]), flat, pa.array([packed[i].tobytes() for i in range(n)], pa.binary())],
                names=["id", "n", "f1", "f2", "bands", "sig"],
            )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """Rows (id, n, f1, f2, bands, sig): set size, set fingerprint, band hashes, packed signature."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda b: _sign(b, size), "id long, n long, f1 long, f2 long, bands array<long>, sig binary")


def agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Share of equal bins of packed signatures, pairwise."""
    left, right = (np.frombuffer(bs.arrow_bytes(x)[0], np.uint16) for x in (a, b))
    skip = [int(bs.arrow_bytes(x)[1][0]) // 2 for x in (a, b)]
    n = len(a) * BINS
    return (left[skip[0] : skip[0] + n].reshape(-1, BINS) == right[skip[1] : skip[1] + n].reshape(-1, BINS)).mean(axis=1)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = (agreement(batch.column(2), batch.column(3)) >= LEAST_AGREEMENT) | (batch.column(4).to_numpy() < ESTIMATED)
            yield batch.select([0, 1]).filter(pa.array(keep))


def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        (_, left, _), (_, right, _) = (bs.arrow_bytes(batch.column(k)) for k in (2, 3))
        weight = left - left[0] + right - right[0]
        while first < batch.num_rows:
            last = int(np.searchsorted(weight, weight[first] + (1 << 21), "right")) - 1
            last = min(max(last, first + 1), first + bs.KEY_ROWS, batch.num_rows)
            part = batch.slice(first, last - first)
            sets = [bs.row_sets(next(bs.blocks(part.column(k), 1 << 62)), _TABLE, bs.NOT_SPACE, size) for k in (2, 3)]
            sizes = [np.bincount(rows, minlength=part.num_rows) for _, rows in sets]
            both = np.sort(np.concatenate([sets[0][0], sets[1][0]]), kind="stable")
            same = both[1:][both[1:] == both[:-1]]
            shared = np.bincount((same >> bs.U64(bs.KEY_BITS)).astype(np.int64), minlength=part.num_rows)
            keep = (shared > 0) & (100 * shared >= percent * (sizes[0] + sizes[1] - shared))
            yield part.select([0, 1]).filter(pa.array(keep))
            first = last


def _verified(pairs: DataFrame, sig: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b): those whose full sets are similar."""
    side = lambda k: sig.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
    bound = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(bound).select("a", "b", "sa", "sb", F.least("na", "nb").alias("n"))
    near = written(near.mapInArrow(_agreeing, "a long, b long"), "pairs")
    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}"))
    links = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    out = written(links.mapInArrow(lambda x: _verify(x, size, percent), "a long, b long"), "links")
    drop_written(near)
    return out


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, hashes): each set as sorted 32-bit hashes."""
    for batch in batches:
        for block in bs.blocks(batch.column(1), most_rows=bs.KEY_ROWS):
            keys, rows = bs.row_sets(block, _TABLE, bs.NOT_SPACE, size)
            bounds = np.searchsorted(rows, np.arange(len(block) + 1))
            short = ((keys >> bs.U64(bs.KEY_BITS - 32)) & bs.U64(0xFFFFFFFF)).astype(np.uint32)
            sets = pa.array([short[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), sets], names=["id", "hashes"])


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Of one block of a bucket: pairs (outside, other) in different components that may be similar.

    Signatures choose pairs of large sets, and the 32-bit sets of these and of all smaller ones are compared in full. Pairs well above the threshold are told as a
    spanning forest; those within what a collision of 32-bit hashes could change are told unless the forest joins them.
    A pair that meets in several buckets is looked at in the least of them only."""
    left, outside = (table.column(k).to_numpy().astype(bool) for k in ("left", "outside"))
    ids, comp, size = (table.column(k).to_numpy() for k in ("id", "component", "n"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, BINS)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    sets = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    bucket = table.column("bucket")[0].as_py()
    found: list[tuple[float, int, int]] = []
    rest = np.flatnonzero(~left)
    for i in np.flatnonzero(left):
        other = rest[(comp[rest] != comp[i]) & ~(outside[rest] & (ids[rest] < ids[i]))]
        other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        small = np.minimum(size[other], size[i]) < ESTIMATED
        small[~small] = (sig[other[~small]] == sig[i]).mean(axis=1) >= LEAST_AGREEMENT
        other = other[small]
        least = np.where(bands[other] == bands[i], bands[i], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        other = other[least == bucket]
        if len(other):
            joined = np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)
            ends = np.cumsum([len(sets[j]) for j in other])
            shared = np.diff(np.concatenate([[0], np.cumsum(sets[i][at] == joined)[ends - 1]]))
            alike = 100 * (shared + 2) / (size[i] + size[other] - shared - 2).clip(1)
            found += [(a, int(i), int(j)) for a, j in zip(alike[alike >= percent], other[alike >= percent], strict=True)]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = []
    for alike, i, j in sorted(found, reverse=True):
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a != b:
            pairs.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
            shared_by_four = 100 * 4 / max(1, min(size[i], size[j]))
            if alike >= percent + 2 * shared_by_four:
                parent[a] = b
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _open(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (bucket, id, component, top, inside, all) of the buckets whose members lie in several components:
    the largest of them, its members there, and all members."""
    rows = buckets.join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("all"))
    largest = largest.where("all > 2 and top.k < all").selectExpr("bucket", "top.component as top", "top.k as inside", "all")
    return written(rows.join(largest, "bucket"), "open")


def _residual(rows: DataFrame, sig: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidate pairs between components that share a bucket, compared in bounded blocks."""
    rows = rows.withColumn("outside", F.expr("component != top"))
    wanted = rows.select("id").distinct()
    hashes = texts.join(wanted, "id", "left_semi").mapInArrow(lambda b: _sets(b, size), "id long, hashes binary")
    rows = rows.join(sig.join(wanted, "id", "left_semi").join(hashes, "id").select("id", "n", "sig", "bands", "hashes"), "id")
    us = F.ceil((F.col("all") - F.col("inside")) / BLOCK_ROWS).cast("int")
    ss = F.ceil(F.col("all") / BLOCK_ROWS).cast("int")
    spot = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    columns = ["bucket", "id", "n", "component", "outside", "sig", "bands", "hashes"]
    left = rows.where("outside").select(*columns, F.lit(True).alias("left"), spot(us, 1).alias("u"), F.explode(F.sequence(F.lit(0), ss - 1)).alias("s"))
    right = rows.select(*columns, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), us - 1)).alias("u"), spot(ss, 2).alias("s"))
    return left.union(right).groupBy("bucket", "u", "s").applyInArrow(lambda t: _compare(t, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, component_id, kept).

    Texts are linked if 100 * |A & B| >= ``percent`` * |A | B| for their sets of ``size``-word
    shingles; component_id is the smallest id reachable, and kept marks that row.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = written(signatures(docs, "id", "text", size), "signatures")
    some = every.where("n > 0 and id is not null")
    first = F.min_by(F.struct("bands", "sig"), "id").alias("s")
    classes = some.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.max("id").alias("other"), first)
    sig = written(classes.select("id", "other", "n", "f1", "f2", "s.bands", "s.sig"), "sets")
    copies = some.join(sig.where("other > id").select("f1", "f2", "n", F.col("id").alias("b")), ["f1", "f2", "n"])
    copies = written(copies.where("id != b").select(F.col("id").alias("a"), "b"), "copies")
    spread = sig.select("id", F.explode("bands").alias("bucket"))
    centres = spread.groupBy("bucket").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("last > b").select("bucket", "b")
    buckets = written(spread.join(centres, "bucket"), "buckets")
    stars = written(buckets.where("id != b").select(F.col("id").alias("a"), "b").distinct(), "stars")
    texts = written(docs.join(buckets.select("id").distinct(), "id", "left_semi"), "texts")
    links = _verified(stars, sig, texts, size, percent)
    label = components(links.union(copies))
    rows = _open(buckets.select("bucket", "id"), label)
    most = COMPARED_PER_ROW * every.count()
    for turn in range(TURNS):
        if (rows.agg(F.sum(F.col("all") - F.col("inside"))).first()[0] or 0) <= most:
            break  # few enough comparisons to make them all
        centre = rows.groupBy("bucket").agg(F.max_by(F.struct("id", "component"), F.xxhash64("id", F.lit(turn))).alias("c"))
        star = rows.join(centre, "bucket").where("component != c.component")
        star = star.select(F.greatest("id", "c.id").alias("a"), F.least("id", "c.id").alias("b")).distinct()
        links = links.union(_verified(star, sig, texts, size, percent))
        label = components(links.union(copies))
        last, rows = rows, _open(rows.select("bucket", "id"), label)
        drop_written(last)
    residual = written(_residual(rows, sig, texts, size, percent), "residual")
    if not residual.isEmpty():
        label = components(links.union(copies).union(_verified(residual, sig, texts, size, percent)))
    drop_written(buckets, stars, sig, texts, rows, residual)
    out = every.select("id", "n").join(label, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def op1_minhash(spark, sf_dir):
    """Near-duplicate classes of documents on two-word shingles at 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


QUERIES = {"op1_minhash": op1_minhash}
SQL = {}
