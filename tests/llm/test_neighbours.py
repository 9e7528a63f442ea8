import numpy as np
import pytest

from tracklake.llm import neighbours as n


def brute(ids, x, queries, k=10):
    out = {}
    for i in queries:
        far = np.sqrt(((x - x[ids.index(i)]) ** 2).sum(1))
        out[i] = [(int(ids[j]), far[j]) for j in sorted(range(len(ids)), key=lambda j: (far[j], ids[j])) if ids[j] != i][:k]
    return out


@pytest.mark.parametrize("size", [64, 5, 100])
def test_equals_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(n, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(size)
    x = rng.standard_normal((600, size)).astype(np.float32).astype(float)
    x[50:90] = x[49]  # ties
    ids = [int(i) for i in rng.permutation(2000)[:600]]
    rows = [(i, v.tolist(), 0.0) for i, v in zip(ids, x, strict=True)]
    rows += [(10_000, None, 0.0), (10_100, [0.0] * size, 0.0), (10_200, [float("nan")] * size, 0.0), (10_300, [1.0], 0.0), (10_400, [None] * size, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(3)
    got = n.nearest(df, "id % 100 = 0").collect()
    queries = [i for i in ids if i % 100 == 0]
    expected = brute(ids, x, queries)
    found = {q: [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in queries}
    assert {r.query_id for r in got} == set(queries)
    hits = sum(len({a for a, _ in found[q]} & {a for a, _ in expected[q]}) for q in queries)
    assert hits >= 0.99 * sum(map(len, expected.values()))
    for q in queries:
        assert np.allclose([s for _, s in found[q]], [s for _, s in expected[q]], rtol=0.05)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert n.nearest(spark.createDataFrame([], schema), "id % 100 = 0").count() == 0
    got = n.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema), "id % 100 = 0").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]
    assert got[0].score in (0.0, np.sqrt(2))


def test_bounds_hold():
    """The least distances from codes are below the exact ones."""
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    centre, turn = x.mean(0), n.rotation(64)
    search = n.Search(np.arange(20), q, centre, turn, 10)
    least = search.least(*n.encode(x, centre, turn))
    exact = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (least <= exact + 1e-9).mean() > 0.999
    assert np.corrcoef(least.ravel(), exact.ravel())[0, 1] > 0.5


def test_repeated_ids_have_lists_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 5.0]), (7, [1.0, 1.0]), (8, [0.0, 4.0]), (None, [1.0, 0.0])]
    got = n.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "id % 100 = 0").collect()
    assert sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in got) == [(1, 7, 1.0), (1, 8, 1.0), (2, 7, round(17**0.5, 6)), (2, 8, round(17**0.5, 6)), (3, 100, round(26**0.5, 6)), (3, 100, round(26**0.5, 6))]


def test_many_queries_in_parts(spark, monkeypatch):
    monkeypatch.setattr(n, "COMPARED", 2)
    x = np.random.default_rng(2).standard_normal((300, 8))
    got = n.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2), "id % 30 = 0").collect()
    expected = brute(list(range(300)), x, range(0, 300, 30))
    hits = sum(r.vec_id in {a for a, _ in expected[r.query_id]} for r in got)
    assert len(got) == 100 and hits >= 95
