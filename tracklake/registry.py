"""The registry of queries, and the driver's tables as samples: what the catalogs share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The samples that ``ev`` makes, for DuckDB.
EV = """ev AS (SELECT user_id AS track_id, event_id AS idx, epoch_us(ts) AS pts, event_type = 'signup' AS is_key, event_type = 'purchase' AS is_target,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'P' ELSE 'B' END AS pic, floor(value * 100 + 0.5)::BIGINT AS size FROM events)"""
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINE = ", ".join(LINE_ORDER)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events")
    if stream:
        events = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern: streams read folders or patterns
    return events.select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("index"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("pts_us"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("dts_us"),
        F.lit(None).cast("long").alias("duration_us"),
        (kind == "signup").alias("is_key"),
        (kind == "purchase").alias("is_target"),
        F.when(kind == "signup", "I").when(kind == "purchase", "P").otherwise("B").alias("picture_type"),
        F.lit(None).cast("boolean").alias("is_idr"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("size"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def plain(df: DataFrame, *more: str) -> DataFrame:
    return df.select("track_id", F.col("index").alias("idx"), F.col("pts_us").alias("pts"), *more)
