"""The pipeline against plain versions of its stages on a small corpus."""

import random
from collections import Counter

import corpus_pipeline as p
from tracklake.llm import mixing

from .test_decontaminate import brute as brute_windows
from .test_minhash import brute as brute_groups


def corpus(tmp_path, spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    for i in range(240):
        text = [word() for _ in range(rng.randint(30, 120))]
        if i % 5 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["zuxotty", "qwivvle"]))
        if i % 17 == 1:
            text += items[i % 5][1].split()[3:15]
        if i % 6 == 3:
            text = rows[-1][1].split()
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), f"src{rng.randrange(4)}", 0))
        labels.append((i, 0, int("zuxotty" in text or "qwivvle" in text)))
    rows += [(None, "null id", None, None, None), (900, None, "en", "src1", 0), (901, "", "en", "src1", 0), rows[7], rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items, {i: bool(t) for i, _, t in labels}


def test_stages(spark, tmp_path):
    rows, items, toxic = corpus(tmp_path, spark)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns

    kept = p.drop_toxic(spark, docs, d).cache()
    assert kept.columns == columns
    ids = [r.doc_id for r in kept.collect()]
    wrong = sum((r[0] in ids) == toxic.get(r[0], False) for r in rows[:240])
    assert wrong <= 12 and None in ids and 900 in ids and 901 in ids

    some = [tuple(r) for r in kept.collect() if r.doc_id is not None]
    once = {r[0]: r for r in some}
    groups, _ = brute_groups(list(once), [r[1] for r in once.values()], 5)
    single = p.drop_near_duplicates(spark, kept, d).cache()
    assert single.columns == columns
    assert sorted((r.doc_id for r in single.collect()), key=repr) == sorted([None, *{g for g in groups.values()}], key=repr)

    clean = p.drop_contaminated(spark, single, d).cache()
    data = [tuple(r) for r in single.collect()]
    hits = brute_windows([r[1] for r in data], items, 10)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r, h in zip(data, hits, strict=True) if not h[1])

    mixed = p.mix_sources(spark, clean, d).cache()
    tokens = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert mixed.columns == columns and tokens(clean.collect()) * 0.85 < tokens(mixed.collect()) <= tokens(clean.collect())
    assert not set(mixed.collect()) - set(clean.collect())

    shards = p.write_shards(spark, mixed, d).collect()
    assert sorted((tuple(r)[:5] for r in shards), key=repr) == sorted((tuple(r) for r in mixed.collect()), key=repr)
    assert {r.shard for r in shards} <= set(range(16))
    assert all(w >= 0 for w in mixing.WEIGHTS.values())


def test_run_and_names(spark, tmp_path):
    corpus(tmp_path, spark)
    out = p.run(spark, str(tmp_path))
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 50
    assert [name for name, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_columns_with_odd_names(spark, tmp_path):
    """Blanks, hyphens, points and the names that stages use inside don't clash, and come through."""
    corpus(tmp_path, spark)
    d = str(tmp_path)
    extra = ["a b", "a-b", "a.b", "_id", "row", "toxicity_score", "shard", "hits", "kept"]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(40)
    docs = docs.select("*", *[docs["n_chars"].alias(c) for c in extra]).cache()
    for stage in (p.drop_toxic, p.drop_near_duplicates, p.drop_contaminated, p.mix_sources):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= 40
    shards = p.write_shards(spark, docs, d)
    assert shards.columns == [*docs.columns, "new_shard", "slot"] and shards.count() == 40


def test_no_documents(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 0")
    for _, stage in p.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
