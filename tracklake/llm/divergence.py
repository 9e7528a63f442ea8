"""Source divergence: how differently the sources of a language use its terms.

Terms are letters and bytes above 127, A-Z read as a-z. A language keeps the terms that stand in at least ``LEAST_DOCS`` of its
documents, and each of its sources, and the language as a whole, gives each kept term a smoothed share in parts of ``SCALE``. Two sources diverge by the sum of
the differences of their shares; a source stands out by the terms that it uses more than its language does.

Counts are made in tasks (the terms of a group of documents in two counters, emptied at ``MOST_TERMS`` entries) and meet in one shuffle by
language and term, after which a window over one row per source knows how many documents hold a term. Kept terms are dealt by
hash into blocks of about ``BLOCK_TERMS``, sources into blocks of about ``BLOCK_GROUPS``, and each block of terms with a pair of blocks of sources is one
dense int64 tile, groups by terms. A tile gives one partial sum for each pair of its sources, by broadcasting their rows against each other, and the
``MOST_RANKS`` largest terms of each source; partial sums are added and the partial lists merged. So no task holds more than a tile, whatever
the size of a language or the share of a source. Pairs of sources are the result itself: one row for each.

Shares are exact: quotients are taken three digits at a time, for which counts of a group may have up to ``MOST_COUNT``; more is refused.

Defined cases: null text, language and source are ''; texts without terms and empty texts still make their group occur; texts of any length are counted in pieces
of about ``PIECE`` bytes cut between terms, and count once for the documents of a term; equal rows are documents each; ties go to the smaller item by UTF-8 bytes;
a language without kept terms gives its pairs the value 0; a language of one source has no pairs; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .shared import drop_written, small_batches, written

LEAST_DOCS, MOST_RANKS, ADDED, SCALE = 30, 50, 5, 1_000_000_000
BLOCK_TERMS, BLOCK_GROUPS = 512, 256
#: Entries of a task's counters, bytes of a text counted at once, pairs of a tile broadcast at once (each as wide as the tile).
MOST_TERMS, PIECE, PAIRS_AT_ONCE = 200_000, 1 << 20, 2048
MOST_COUNT = 9 * 10**15

_LETTERS = bs.byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_TRANSLATE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _LETTERS[b] else 32 for b in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces cut between terms."""
    plain, at = text.translate(_TRANSLATE), 0
    while at < len(plain):
        end = plain.find(b" ", at + size) if at + size < len(plain) else len(plain)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _rows(counts: dict, docs: dict) -> pa.RecordBatch:
    """Rows of the counters, and for each group one with a null term, which says that it occurs."""
    lang, source, term, n, held = [], [], [], [], []
    for key, found in counts.items():
        lang += [key[0]] * (len(found) + 1)
        source += [key[1]] * (len(found) + 1)
        term += [None, *found]
        n += [0, *found.values()]
        held += [0, *map(docs[key].__getitem__, found)]
    text = pa.array(term, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), text, pa.array(n, pa.int64()), pa.array(held, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs), combined within a task as far as its counters reach."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for batch in batches:
        data, offsets, null = bs.arrow_bytes(batch.column("text"))
        for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            found, own = counts[key], set()
            for terms in pieces(b"" if null[i] else data[offsets[i] : offsets[i + 1]].tobytes()):
                found.update(terms)
                own.update(terms)
            docs[key].update(own)
        if len(counts) + sum(map(len, counts.values())) >= MOST_TERMS:
            yield _rows(counts, docs)
            counts, docs = defaultdict(Counter), defaultdict(Counter)
    if counts:
        yield _rows(counts, docs)


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exactly."""
    under = total + ADDED * terms
    if len(under) and under.max() > MOST_COUNT:
        raise ValueError(f"a group of more than {MOST_COUNT} counted terms")
    out, rest = np.divmod(count + ADDED, under)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, under)
        out = out * 1000 + digits
    return 1 + out


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of |a's row - b's row| for all pairs of rows, by broadcasting as many pairs at once as PAIRS_AT_ONCE says."""
    out, step = np.zeros((len(a), len(b)), np.int64), max(1, PAIRS_AT_ONCE // max(len(b), 1))
    for i in range(0, len(a), step):
        out[i : i + step] = np.abs(a[i : i + step, None, :] - b[None, :, :]).sum(2)
    return out


_TILE = "lang string, source string, part string, item string, value long"


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of the pairs of a tile's sources, and on the diagonal the sources' largest terms of this block."""
    a, b = key[2].as_py(), key[3].as_py()
    head = table.filter(pc.is_null(table["term"]))
    rows = table.filter(pc.is_valid(table["term"]))
    lang, kept = head["lang"][0], head["kept"][0].as_py()
    names = head["source"].combine_chunks()
    order = pc.sort_indices(names)
    names, total, side = names.take(order), head["n"].combine_chunks().take(order).to_numpy(), head["part"].combine_chunks().take(order).to_numpy()
    terms = rows["term"].combine_chunks().dictionary_encode()
    count = np.zeros((len(names), len(terms.dictionary)), np.int64)
    at, column = pc.index_in(rows["source"].combine_chunks(), names).to_numpy(), terms.indices.to_numpy()
    count[at, column] = rows["n"].to_numpy()
    share = shares(count, total[:, None], kept) if kept else count
    one, other = np.flatnonzero(side == a), np.flatnonzero(side == b)
    sums = differences(share[one], share[other])
    i, j = np.nonzero(one[:, None] < other[None, :]) if a == b else map(np.ravel, np.indices(sums.shape))
    out = [(names.take(pa.array(one[i])), "pair", names.take(pa.array(other[j])), sums[i, j])]
    if a == b and len(rows):
        whole = np.zeros(len(terms.dictionary), np.int64)
        whole[column] = rows["n_lang"].to_numpy()
        above = share - shares(whole, np.full(1, head["total"][0].as_py()), kept)
        above[count == 0] = 0
        by_name = np.empty(len(terms.dictionary), np.int64)
        by_name[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(by_name))
        for g in range(len(names)):
            some = np.flatnonzero(above[g] > 0)
            some = some[np.lexsort((by_name[some], -above[g, some]))][:MOST_RANKS]
            out.append((pa.repeat(names[g], len(some)), "term", terms.dictionary.take(pa.array(some)), above[g, some]))
    parts = [pa.table([pa.repeat(lang, len(v)), s, pa.repeat(pa.scalar(p), len(v)), item, pa.array(v)], names=["lang", "source", "part", "item", "value"]) for s, p, item, v in out]
    return pa.concat_tables(parts)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, ranks: int = MOST_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has all other sources by their difference, part 'term' the ``ranks`` terms that stand out most (at most 50)."""
    if ranks > MOST_RANKS:
        raise ValueError(f"tiles keep {MOST_RANKS} terms")
    small_batches(docs.sparkSession)
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source")))
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), lang, source)
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # tasks have combined their rows; one exchange serves the sums per source and the window over the sources of a term
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    known = summed.withColumns({"held": F.sum("docs").over(by_term), "n_lang": F.sum("n").over(by_term)})
    # a null term's rows are the groups that occur
    known = written(known.where(F.col("term").isNull() | (F.col("held") >= least)).select("lang", "source", "term", "n", "n_lang"), "terms")
    sizes = known.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("n").alias("total"), F.count(F.when(F.col("term").isNull(), 1)).alias("groups"))
    blocks = lambda of, size: F.ceil(F.greatest(F.lit(1), F.col(of)) / size).cast("int")
    sizes = written(sizes.withColumns({"term_blocks": blocks("kept", BLOCK_TERMS), "group_blocks": blocks("groups", BLOCK_GROUPS)}), "languages")
    part = F.pmod(F.xxhash64("source"), F.col("group_blocks").cast("long")).cast("int")
    heads = known.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(sizes, "lang").withColumns({"term": F.lit(None).cast("string"), "n_lang": F.lit(None).cast("long"), "part": part, "block": F.explode(F.expr("sequence(0, term_blocks - 1)"))})
    cells = known.where("term is not null").join(sizes, "lang").withColumns({"part": part, "block": F.pmod(F.xxhash64("term"), F.col("term_blocks").cast("long")).cast("int")})
    columns = ["lang", "block", "source", "term", "n", "n_lang", "part", "kept", "total", "group_blocks"]
    rows = heads.select(columns).unionByName(cells.select(columns)).withColumn("with", F.explode(F.expr("sequence(0, group_blocks - 1)")))
    rows = rows.withColumns({"a": F.least("part", "with"), "b": F.greatest("part", "with")}).drop("with", "group_blocks")
    tiles = written(rows.groupBy("lang", "block", "a", "b").applyInArrow(_tile, _TILE), "tiles")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("_"), "part", "value").select("lang", "_.source", "part", "_.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    # ranked apart: the limit on terms is taken in each task before they are shuffled
    terms = tiles.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= ranks)
    out = written(pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank"), "divergence")
    drop_written(known, sizes, tiles)
    return out


def op11_source_divergence(spark, sf_dir):
    """All pairs of sources of each language by their divergence, and each source's 50 terms that stand out most."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
SQL = {
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {ADDED})::HUGEINT // (coalesce(total.n, 0) + {ADDED} * v)::HUGEINT AS p,
             1 + {SCALE}::HUGEINT * (kept.n + {ADDED})::HUGEINT // (size.n + {ADDED} * v)::HUGEINT AS q
      FROM g JOIN kept ON g.lang = kept.lang JOIN size ON g.lang = size.lang LEFT JOIN total ON g.lang = total.lang AND g.source = total.source
      LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND kept.term = c.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {MOST_RANKS}"""
}
