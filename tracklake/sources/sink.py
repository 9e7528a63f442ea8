"""Files as a sink: pieces that follow one another are streamed into files, which appear together when the job commits.

``df.write.format("pieces").option("path", folder)`` takes rows (name, data), those of a file side by side and in order, as :func:`write_files` brings them. A task
appends piece after piece to files of its own in a hidden folder; only the commit of the whole job moves them to their names. So a file is never in
one cell, a task that fails or runs twice leaves nothing, and a failed job removes what others have written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where they lie, and their names."""

    files: list[tuple[str, str]]


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.hidden = f"{self.path}/_pieces-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, hidden = filesystem(self.hidden)
        own = f"{hidden}/{uuid.uuid4().hex}"  # of this attempt
        store.create_dir(own, recursive=True)
        files: list[tuple[str, str]] = []
        out, now = None, None
        try:
            for batch in iterator:
                for name, data in zip(batch.column("name").to_pylist(), batch.column("data"), strict=True):
                    if out is None or name != now:
                        if out:
                            out.close()
                        now = name
                        files.append((f"{own}/{len(files)}", quote(name, safe="-_.~ ")))
                        out = store.open_output_stream(files[-1][0])
                    if data.is_valid:
                        out.write(data.as_buffer())
        except BaseException:
            if out:
                out.close()
            store.delete_dir(own)
            raise
        if out:
            out.close()
        if len({name for _, name in files}) < len(files):
            store.delete_dir(own)
            raise ValueError("the pieces of a file do not stand side by side")
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = filesystem(self.path)
        for at, name in (f for m in messages if m for f in m.files):
            store.move(at, f"{path}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, hidden = filesystem(self.hidden)
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)


class Pieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pieces"

    def writer(self, schema: StructType, overwrite: bool) -> PieceWriter:
        if not {"name", "data"} <= set(schema.fieldNames()):
            raise ValueError("pieces have a name and data")
        return PieceWriter(self.options["path"])


def write_files(pieces: DataFrame, path: str, name: str = "name", data: str = "data", order: list[str] | None = None) -> None:
    """Write one file for each name below ``path``: its pieces in order. One exchange brings the pieces of a file together; a task holds a batch of them."""
    spark: SparkSession = pieces.sparkSession
    spark.dataSource.register(Pieces)
    rows = pieces.select(F.col(name).cast("string").alias("_name"), F.col(data).alias("_data"), *order or []).repartition("_name").sortWithinPartitions("_name", *[F.asc_nulls_first(o) for o in order or []])
    rows.select(F.col("_name").alias("name"), F.col("_data").alias("data")).write.format("pieces").option("path", path).mode("append").save()
