import math
from collections import Counter

import numpy as np
import pytest

from tracklake.llm import codes as c


def plain(rows, parts, entries, rounds):
    """The same by loops over Python numbers."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most = min(Counter(len(v) for _, v, _ in rows).items(), key=lambda x: (-x[1], x[0]))[0]
    rows = sorted(((i, v, label) for i, v, label in rows if len(v) == most), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    at = [most * p // parts for p in range(parts + 1)]
    cut = [[[math.floor(4096 * x) for x in v[a:b]] for a, b in zip(at[:-1], at[1:])] for _, v, _ in rows]
    books = [[cut[r][p] for r in range(min(entries, len(rows)))] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [near(x[p], book)[1] for x in cut]
            new.append([[sum(x[p][j] for x, o in zip(cut, own) if o == k) // own.count(k) for j in range(len(e))] if k in own else e for k, e in enumerate(book)])
        books = new
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    return sorted((repr((i, label, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f))) for (i, _, label), f in zip(rows, found))), books


@pytest.mark.parametrize(("size", "entries", "unit"), [(64, 16, 4096), (13, 5, 4096), (3, 7, 4096), (16, 16, 4096)])
def test_equals_plain(spark, size, entries, unit):
    rng = np.random.default_rng(size)
    x = (rng.standard_normal((150, size)) if size != 16 else rng.integers(-2, 3, (150, size)) / 4096).astype(np.float32).astype(float)  # the last has many ties
    rows = [(int(i), v.tolist(), None if i % 5 == 0 else int(i % 3)) for i, v in zip(rng.permutation(500), x, strict=False)]
    rows += [rows[0], (rows[1][0], x[9].tolist(), 1), (None, x[3].tolist(), 2), (-7, None, 1), (-8, [None] * size, 1), (-9, [math.nan] * size, 1), (-10, [math.inf] * size, 1), (-11, [0.5], 1), (-12, [], 1)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, code string, `a.b` int").repartition(3)
    got, books = c.compress(docs, entries=entries)
    expected, wanted = plain(rows, 8, entries, 6)
    assert [b.tolist() for b in books] == wanted
    assert sorted(repr((r.id, r.label, r.code, r.error)) for r in got.collect()) == expected


def test_tree_finds_the_lowest_index():
    rng = np.random.default_rng(5)
    for size in (1, 2, 8):
        book, x = rng.integers(-3, 4, (16, size)), rng.integers(-4, 5, (500, size))
        far = ((x[:, None] - book) ** 2).sum(2)
        who, best = c.Tree(book).nearest(x)
        assert (who == far.argmin(1)).all() and (best == far.min(1)).all()


def test_tree_leaves_branches_out(monkeypatch):
    """Far boxes are not searched."""
    book = np.array([[10_000 * i, 0] for i in range(16)])
    seen = []
    visit = c.Tree._visit
    monkeypatch.setattr(c.Tree, "_visit", lambda self, x, rows, *a: (seen.append(len(rows)) if self.children is None else None, visit(self, x, rows, *a))[1])
    c.Tree(book).nearest(np.array([[10_000 * i, 1] for i in range(16)]))
    assert sum(seen) == 16


def test_labels_digest_and_empty(spark, tmp_path):
    rows = [(1, [0.5, 1.0], None), (2, [0.25, 1.0], None), (3, [9.0, 1.0], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in c.op12_vector_codes(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and got[1].label_error == got[2].label_error == 0 and got[3].label_error == 0
    assert len({r.codebooks_sha256 for r in got.values()}) == 1
    none, books = c.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.count() == 0
    none, _ = c.compress(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>").withColumn("label", c.F.lit(1)))
    assert [(r.code, r.error) for r in none.collect()] == [("00" * 8, 0)]


def test_large_components(spark):
    got, _ = c.compress(spark.createDataFrame([(1, [3e38, -3e38]), (2, [-3e38, 3e38])], "vec_id long, embedding array<float>").withColumn("label", c.F.lit(1)), entries=1, rounds=1)
    assert all(r.error > 0 for r in got.collect())
