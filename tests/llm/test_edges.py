"""Empty tables, repeated rows, null ids, clashing names and very long texts of operators whose other tests have none."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.llm import archives, minhash, packing, resharding, toxicity
from tracklake.llm.shared import new_path

from .test_others import text


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near, half = list(words), list(words)
    for at in range(0, len(near), 100):
        near[at] = "x"
    half[: len(half) // 2] = [f"v{rng.randrange(10**6)}" for _ in range(len(half) // 2)]
    rows = [(4, " ".join(words)), (2, " ".join(near)), (1, " ".join(half)), (9, " ".join(words).upper()), (7, "short")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got.collect()) == [(1, 1, True), (2, 2, True), (4, 2, False), (7, 7, True), (9, 2, False)]


def test_packing_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "one two three")] * 3 + [(None, "four five"), (None, None), (2, "")]
    got = packing.unpack(packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), length=32)).collect()
    encoding = packing._encoding(packing.TOKENIZER)
    expected = sorted((str(i), encoding.encode_ordinary(t)) for i, t in rows if t)
    assert sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), "<u2").tolist()) for r in got) == expected


def test_packing_of_a_document_longer_than_many_rows(spark):
    long = text(random.Random(4), 3_000)
    got = packing.unpack(packing.packed(spark.createDataFrame([(1, long)], "doc_id long, text string"), length=64)).orderBy("doc_offset").collect()
    assert np.concatenate([np.frombuffer(bytes(r.ids), "<u2") for r in got]).tolist() == packing._encoding(packing.TOKENIZER).encode_ordinary(long)


@pytest.mark.parametrize("rows", [[], [(3, "u", "é" * 600)] * 3 + [(None, None, None)] * 2])
def test_archives_of_empty_tables_and_repeated_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = archives.op4_warc(spark, str(tmp_path)).collect()
    digest = lambda html: hashlib.sha1((html or "").encode()).hexdigest()
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted((str(i), digest(html)) for i, _, html in rows)
    # one record of equal payloads is the response
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id) == ([("response", None), ("revisit", 3), ("revisit", 3)] if rows else [])


def test_toxicity_with_clashing_names(spark):
    model = toxicity.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    docs = spark.createDataFrame([(1, "a", 0.5, "q", 7)], "doc_id long, text string, score double, `odd.name` string, toxic int")
    got = toxicity.scored(docs, model, name="toxicity").first()
    assert got.asDict() == {**docs.first().asDict(), "toxicity": 0.0}


def test_shards_without_transfers_stay_where_they_are(spark):
    """Shard 2 holds more than its part and shard 3 less; 0 and 1 are only read from the folder before."""
    sizes = {0: 30, 1: 30, 2: 45, 3: 15}
    rows = [(100 * shard + i, "abc", shard) for shard, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    before, after = new_path(spark, "before"), new_path(spark, "after")
    kept = docs.select("doc_id", "text")
    slot = (F.col("doc_id") % 100).cast("long").alias("slot")
    docs.select(F.struct("doc_id", "text", "at").alias("row"), slot, F.col("at").alias("shard")).write.partitionBy("shard").parquet(before)
    got = resharding.reshard(docs, F.col("at"), after, shards=4, old_path=before)
    found = got.select("row.doc_id", "row.text", "shard", F.col("slot").cast("long").alias("slot"), F.input_file_name().alias("file")).collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted(tuple(r) for r in kept.collect())
    for shard in range(4):
        here = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in here) == list(range(30))
        assert all((before if shard < 2 else after) in r.file for r in here)
    # what stays is untouched, and of the rest as few rows move as must
    assert all(r.slot == r.doc_id % 100 for r in found if r.shard < 2)
    assert sum(r.shard != r.doc_id // 100 for r in found) == 15
    assert sorted(p.name for p in Path(after.removeprefix("file:")).glob("shard=*")) == ["shard=2", "shard=3"]
