import zlib

import numpy as np
import pytest

from tracklake.llm import langid as li

VOICES = {"en": "the and of that with from have this will would there their what about which".split(), "de": "der die und nicht mit für über können größe straße schön eine einer haben".split(),
          "ru": "и в не на что быть как он это весь который мочь свой".split(), "": "zzq zqz qzz zqq".split()}


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    for i in range(n):
        lang = list(VOICES)[i % len(VOICES)]
        yield i, " ".join(rng.choice(VOICES[lang], rng.integers(1, 40))), lang


def test_learned_languages_are_found(spark):
    docs = spark.createDataFrame(list(texts(400)), "doc_id long, text string, lang string").repartition(3)
    filters = li.train(docs.where("doc_id < 300"))
    assert set(filters.langs) == set(VOICES)
    got = li.predicted(docs.where("doc_id >= 300"), filters).collect()
    assert len(got) == 100 and all(r.lang_pred == r.lang for r in got) and all(0 < r.score <= 1 for r in got)


def test_predictions_equal_plain_counts(spark):
    """Masks against sets: what a filter adds by mistake is known, nothing that is held is missed."""
    docs = spark.createDataFrame(list(texts(60)), "doc_id long, text string, lang string")
    filters = li.train(docs)
    for _, text, lang in texts(40, seed=3):
        every = np.concatenate([g for g in li.pieces(np.frombuffer(text.encode(), np.uint8))])
        low = b" " + " ".join(text.split()).encode() + b" "
        assert len(every) == sum(max(len(low) - n + 1, 0) for n in li.SIZES)
        masks = filters.masks(every)
        one_by_one = [sum(all(filters.slices[int(at[0]), i // 8] >> i % 8 & 1 for at in li.slots_of(every[j : j + 1], len(filters.slices))) for j in range(len(every))) for i in range(len(filters.langs))]
        assert filters.counts(masks).tolist() == one_by_one
        assert filters.predict(np.frombuffer(text.encode(), np.uint8))[0] == lang


def test_more_languages_than_a_byte_holds():
    rng = np.random.default_rng(4)
    langs = [f"l{i}" for i in range(70)]
    kept = {x: rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64) for x in langs}
    filters = li.build(langs, kept, [1.0] * 70)
    for i in (0, 7, 8, 69):
        counts = filters.counts(filters.masks(kept[f"l{i}"]))
        assert counts[i] == 500 and counts.argmax() == i and np.delete(counts, i).max() < 20
    assert filters.slices.size <= li.MOST_BYTES


def test_pieces_lose_nothing(monkeypatch):
    data = np.frombuffer(("wort, " * 1000).encode(), np.uint8)
    whole = np.concatenate(list(li.pieces(data)))
    monkeypatch.setattr(li, "PIECE", 7)
    assert sorted(np.concatenate(list(li.pieces(data))).tolist()) == sorted(whole.tolist())


def test_unknown_and_edges(spark):
    docs = spark.createDataFrame(list(texts(200)), "doc_id long, text string, lang string")
    filters = li.train(docs)
    rows = [(1, None, 0.5, 1), (2, "", 0.5, 1), (3, "12 34 !?", 0.5, 1), (4, "№ ± 漢", 0.5, 1), (5, "… — ±", 0.5, 1), (6, "der und " * 400_000, 0.5, 1), (None, "der und nicht", 0.5, 1), (7, "漢字", 0.5, 1)]
    got = li.predicted(spark.createDataFrame(rows, "doc_id long, text string, score double, `a.b` int"), filters)
    assert got.columns == ["doc_id", "text", "a.b", "lang_pred", "score"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert [found[k] for k in (1, 2, 3, 5)] == [("und", 0.0)] * 4
    assert found[4] == found[7] == (filters.langs[0], 0.0) or found[7][0] in VOICES
    assert found[6][0] == found[None][0] == "de"
    none = li.train(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    assert li.predicted(docs.limit(3), none).select("lang_pred").distinct().collect() == [("und",)]
    assert li.predicted(docs.limit(0), filters).count() == 0


def test_query_learns_only_from_rows_not_held_out(spark, tmp_path):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "wrong") for i, t, lang in texts(200)]
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in li.op13_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 200 and "wrong" not in {r.lang_pred for r in got.values()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    truth = {i: lang for i, _, lang in texts(200)}
    assert np.mean([got[i].lang_pred == truth[i] for i in got if got[i].held_out]) > 0.95


@pytest.mark.parametrize("most", [5, 1000])
def test_sample_is_bounded(spark, monkeypatch, most):
    docs = spark.createDataFrame(list(texts(400)), "doc_id long, text string, lang string")
    filters = li.train(docs, most_texts=most, most_grams=50)
    assert len(filters.langs) == 4 and np.count_nonzero(filters.slices) <= 4 * 50 * li.HASHES
