import hashlib
import random

import numpy as np
import pytest

from tracklake.llm import repeats as r


def brute(texts, length):
    """Spans that repeats cover, by counting every window."""
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                cover[i][p : p + length] = b"\1" * length
    return cover


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(n)]
    common = " ".join(word() for _ in range(40))
    for _ in range(n // 2):
        i, j = rng.randrange(n), rng.randrange(n)
        a = rng.randrange(len(texts[i]) + 1)
        piece = texts[i][a : a + rng.randint(20, 300)]
        at = rng.randrange(len(texts[j]) + 1)
        texts[j] = texts[j][:at] + piece + texts[j][at:]
        texts[i] += common * rng.choice((0, 0, 1, 3))
    return [*texts, "", "x" * 700, "ab" * 300, "x" * 300, texts[0], texts[0][1:], None]


def check(spark, texts, length, **rows):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = {x.doc_id: x for x in r.remove_repeats(docs, length=length).collect()}
    data = [(t or "").encode() for t in texts]
    cover = brute(data, length)
    assert len(got) == len(texts)
    for i, t in enumerate(data):
        assert bytes(got[i].kept) == bytes(b for b, c in zip(t, cover[i], strict=True) if not c), i
        flags = np.frombuffer(bytes(cover[i]), np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])) == 1)
        assert got[i].starts == edge.tolist()


@pytest.mark.parametrize("length", [100, 64])
def test_equals_brute_force(spark, length):
    check(spark, corpus(length), length)


def test_large_groups_by_window_hash(spark, monkeypatch):
    """The way for groups beyond GROUP_CONTEXTS gives the same."""
    monkeypatch.setattr(r, "GROUP_CONTEXTS", 1)
    check(spark, corpus(3), 80)


def test_intervals_alone():
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab") for _ in range(400)) + bytes(rng.choice(b"ab") for _ in range(30)) * 3
    flags = r.repeats_by_intervals(np.frombuffer(text + b"\xff", np.uint8).astype(np.int64) + 1 & 0xFF, 20)
    for p in range(len(text) - 20):
        assert flags[p] == (sum(text[q : q + 20] == text[p : p + 20] for q in range(len(text) - 19)) > 1)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(r, "PIECE", 256)
    text = "".join(random.Random(9).choice("abc") for _ in range(900))
    check(spark, [text + text[100:400], text[500:]], 64)


def test_empty_table_and_query(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert r.remove_repeats(empty).count() == 0
    text = "word " * 200
    spark.createDataFrame([(1, text), (1, text), (None, text), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = r.op10_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted((x.n_bytes, x.n_removed, x.n_spans) for x in rows) == [(0, 0, 0)] + [(1000, 1000, 1)] * 3
    assert {x.kept_sha256 for x in rows} == {hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize(("words", "run"), [(12, 7), (9, 9)])
def test_passages_are_found(spark, words, run):
    """All texts that share a window of words have some, texts that share no run have none."""
    rng = random.Random(words)
    one = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    texts = [[one() for _ in range(rng.randint(0, 60))] for _ in range(40)]
    for _ in range(25):
        i, j = rng.randrange(40), rng.randrange(40)
        at = rng.randrange(len(texts[j]) + 1)
        texts[j][at:at] = texts[i][: rng.randint(5, 30)]
    texts += [["x"] * 40, ["ab", "c"] * 30, texts[3], [], [one() for _ in range(300)]]
    rows = [(i, rng.choice((" ", "\n ")).join(t), 7) for i, t in enumerate(texts)] + [(90, None, 7), (91, " ", 7), (None, " ".join(texts[5]), 7), (None, " ".join(texts[5]), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_passages int").repartition(3)
    got = r.remove_repeats(docs, passages=r.repeated_passages(docs, words=words, run=run)).collect()
    split = [(i, (t or "").split()) for i, t, _ in rows]

    def shared(size):
        seen = {}
        for _, w in split:
            for p in range(len(w) - size + 1):
                seen[tuple(w[p : p + size])] = seen.get(tuple(w[p : p + size]), 0) + 1
        return {i: sum(seen[tuple(w[p : p + size])] > 1 for p in range(len(w) - size + 1)) for i, w in split if i is not None}

    known, surely, maybe = {x.doc_id: x.n_passages for x in got if x.doc_id is not None}, shared(words), shared(run)
    assert len(got) == len(rows) and any(surely.values()) and not all(maybe.values())
    for i in known:
        assert known[i] > 0 or not surely[i]
        assert known[i] <= maybe[i]
        assert words > run or known[i] == surely[i]
