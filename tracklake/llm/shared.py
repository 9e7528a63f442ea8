"""Session helpers: the shared working folder, written intermediate tables, prefix sums, components."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of the Arrow batches in which texts go to Python: a batch, its copy on the other side and what is made of
#: it stay a few times this large for each task, outside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH``, but for settings that the user has made."""
    own = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in own:
            spark.conf.set(key, value)


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tracklake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary folder; a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors,
    and gives the optimizer the table's real size, by which it decides what to broadcast."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def prefix_sums(df: DataFrame, group: list[str], bucket: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Exclusive running sums of columns within ``group``, in the order ``bucket`` then ``order``.

    ``bucket`` columns must follow from the order and cut every group into pieces of bounded size.
    Sums per bucket are made first, so no task ever holds more than one bucket of rows; the
    bucket table (groups x buckets rows) gets its running sums by a window per group.
    ``values`` maps a new column to the summed column.
    """
    keys = [*group, *bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    over = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{k}").over(over), F.lit(0)).alias(f"_s_{k}") for k in values])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(starts, keys)
    sums = {k: F.col(f"_s_{k}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in values.items()}
    return out.withColumns(sums).drop(*[f"_s_{k}" for k in values])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b) as rows (id, component): the smallest id reachable.

    Alternating large and small stars until nothing changes. Edges point from the larger id to the smaller. The large star joins each
    edge's smaller end to that end's smallest neighbour: an aggregate with map-side combining, and a join whose hot keys (an id with
    many larger neighbours) the engine can split. The small star works per larger end, which has few edges, in one exchange.
    Only ids that have an edge appear, and the smallest of each component does not.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), name)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if state == seen or state["n"] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = state
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))  # a neighbour smaller than the id itself
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).repartition("a").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, now = now, written(small.distinct(), name)
        drop_written(last)
