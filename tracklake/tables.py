"""The folder that driver and executors share, for files, streams and written tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a task where each row takes long.
ROWS_A_TASK = 10_000


def spread(df: DataFrame, per: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt over tasks by its number of rows, for work that is long for each row: a table of few bytes is read by few tasks, however many rows it has."""
    tasks = -(-df.count() // per)
    return df.repartition(tasks) if tasks > 1 else df


#: Rows that one task sorts for a window or a join.
ROWS_A_SORT = 250_000


def dealt(df: DataFrame, *keys: str, per: int = ROWS_A_SORT) -> DataFrame:
    """``df`` dealt by keys over as many tasks as its rows need, where the session's shuffles have fewer; windows and joins by these keys take it as it is."""
    tasks = -(-df.count() // per)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tracklake-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name below ``spark.checkpoint.dir``; where that is unset a local session gets a temporary folder, and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written below the shared folder and read again, which cuts its lineage and survives lost executors; and where it is."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
