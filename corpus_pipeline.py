"""The corpus pipeline: each stage reads what the stage before kept, written as Parquet.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark windows go, sources are
mixed to target weights, and the rest is dealt into shards of near equal bytes.

Extra columns pass through the stages; null ids and texts are rows like others, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import decontaminate, minhash, mixing, resharding, toxicity
from tracklake.llm.shared import new_path, written

#: The mix takes this share of all tokens, at most once each.
MIX_SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; learned from the labels that are not held out."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(docs["text"], model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles at 0.8: the one of the smallest id."""
    found = minhash.near_duplicates(docs, size=5)
    # written, so that the join to them is chosen by their real size
    gone = written(found.where("not kept").select("doc_id").distinct(), "gone")
    twice = written(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    columns = [F.col(f"`{c}`") for c in docs.columns]  # names may hold points
    once = docs.join(gone.union(twice), "doc_id", "left_anti").select(*columns)
    return once.unionByName(docs.join(twice, "doc_id", "left_semi").select(*columns).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each once."""
    levels = {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, mixing.WEIGHTS, MIX_SHARE, epochs=1, seed=5).select("row.*")


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in 16 shard files of near equal bytes, read again, with their shard and slot."""
    out = resharding.reshard(docs, resharding.old_layout(), new_path(spark, "pipeline-shards"))
    names = {c.lower() for c in docs.columns}
    place = [F.col(c).alias(c if c not in names else f"new_{c}") for c in ("shard", "slot")]
    return out.select("row.*", *place)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
