import random
import re

import pyarrow as pa

from tracklake.llm import minhash as m

LOWER = {c: c + 32 for c in range(65, 91)}


def sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(ids, texts, size, percent=80):
    """Smallest id reachable over all pairs."""
    s = sets(texts, size)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}, {i: len(x) for i, x in zip(ids, s, strict=True)}


def near_copies(seed, n, words, most):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, most)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def run(spark, rows, size):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string").repartition(3)
    return m.near_duplicates(docs, size=size).collect()


def test_equals_brute_force(spark):
    """Groups of copies around the threshold: most pairs of a bucket are near 0.8, on either side."""
    texts = near_copies(1, 50, 60, 9) + near_copies(2, 30, 8, 2) + near_copies(3, 20, 300, 30)
    texts += ["", None, "one", "ONE", "one two", "one  two\n", "é à", "a b c", "a b c d", " \t"]
    ids = random.Random(4).sample(range(1000), len(texts))
    for size in (2,):
        expected, counts = brute(ids, texts, size)
        got = run(spark, [(i, t, "clash") for i, t in zip(ids, texts, strict=True)], size)
        assert {r.doc_id: r.component_id for r in got} == expected
        assert {r.doc_id: r.n_shingles for r in got} == counts
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_residual_without_more_stars(spark, monkeypatch):
    """The comparison of open buckets in blocks finds what stars leave."""
    monkeypatch.setattr(m, "TURNS", 0)
    monkeypatch.setattr(m, "BLOCK_ROWS", 7)
    texts = near_copies(7, 40, 50, 8)
    expected, _ = brute(list(range(len(texts))), texts, 2)
    got = run(spark, [(i, t, None) for i, t in enumerate(texts)], 2)
    assert {r.doc_id: r.component_id for r in got} == expected


def test_null_ids_repeats_and_empty(spark):
    got = run(spark, [(None, "a b c", ""), (5, "a b c", ""), (5, "a b c", ""), (3, "a b c", "")], 2)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (3, 3), (5, 3), (5, 3)]
    assert run(spark, [], 2) == []


#: Pairs of exactly 0.8 whose signatures agree in less than LEAST_AGREEMENT of their bins.
UNLIKE_SIGNATURES = [
    ("w908125 w939424 w648206 w260600 w319271 w771911", 5),
    ("w592384 w56259 w960765 w393266 w974634 w841318 w91011 w675342 w616788 w424870 w350778", 9),
    ("w218748 w912895 w965583 w402602 w206368 w334777 w193436 w834272 w187500 w520415 w690062 w158488 w641455 w620140 w530195 w427492", 13),
]


def test_small_sets_skip_the_estimate(spark):
    texts = [t for whole, n in UNLIKE_SIGNATURES for t in (whole, " ".join(whole.split()[:n]))]
    rows = pa.Table.from_batches(list(m._sign(iter([pa.record_batch([pa.array(range(6)), pa.array(texts)], names=["id", "text"])]), 2)))
    packed = rows["sig"].combine_chunks()
    assert (m.agreement(packed.take(pa.array([0, 2, 4])), packed.take(pa.array([1, 3, 5]))) < m.LEAST_AGREEMENT).all()
    got = run(spark, [(i, t, None) for i, t in enumerate(texts)], 2)
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_small_sets_of_a_block_skip_the_estimate():
    for whole, n in UNLIKE_SIGNATURES:
        batch = pa.record_batch([pa.array([0, 1]), pa.array([whole, " ".join(whole.split()[:n])])], names=["id", "text"])
        rows = pa.Table.from_batches(list(m._sign(iter([batch]), 2)))
        hashes = pa.Table.from_batches(list(m._sets(iter([batch]), 2)))["hashes"]
        bands = rows["bands"].to_pylist()
        bucket = min(set(bands[0]) & set(bands[1]))
        table = pa.table({"bucket": [bucket] * 2, "id": [0, 1], "n": rows["n"], "component": [0, 1], "outside": [True, False], "left": [True, False], "sig": rows["sig"], "bands": rows["bands"], "hashes": hashes})
        assert m._compare(table, 80).to_pylist() == [{"a": 1, "b": 0}]
