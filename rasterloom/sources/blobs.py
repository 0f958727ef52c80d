"""Blobs in a shared folder: reading them whole, and a sink that writes one file for each row."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql import functions as F


def read_blobs(spark: SparkSession, directory: str) -> DataFrame:
    """(path, length, modificationTime, content); contents are read only if they are used."""
    return spark.read.format("binaryFile").load(directory)


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it: tasks reach every store that pyarrow does."""
    if ":/" in path:
        scheme, rest = path.split(":", 1)
        return pafs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


class _Writer(DataSourceWriter):
    def __init__(self, directory: str):
        self.directory = directory

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, directory = _at(self.directory)
        store.create_dir(directory, recursive=True)
        for row in iterator:
            name = row["name"]
            if os.path.basename(name) != name or name in ("", ".", ".."):
                raise ValueError(f"{name!r} isn't a plain file name")
            part = f"{directory}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(bytes(row["content"]))
            store.move(part, f"{directory}/{name}")  # a task that runs again leaves the same file
        return WriterCommitMessage()


class BlobSink(DataSource):
    """`df.write.format("blobs")` for rows (name string, content binary); path is a folder that all machines share."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"])


def write_blobs(rows: DataFrame, directory: str) -> None:
    """Writes rows (name, content); of rows with one name, one stays."""
    rows.sparkSession.dataSource.register(BlobSink)
    rows.groupBy("name").agg(F.first("content").alias("content")).write.format("blobs").mode("append").option("path", directory).save()


def delete_blobs(spark: SparkSession, paths: DataFrame) -> int:
    """Deletes the files of a column `path`, as far as they are there, in tasks; how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = 0
        for batch in batches:
            for path in filter(None, batch.column(0).to_pylist()):
                store, at = _at(path)
                if store.get_file_info(at).is_file:
                    store.delete_file(at)
                    gone += 1
        yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], ["gone"])

    # dealt first, so that a path's task deletes it however the rows came about
    dealt = paths.select("path").distinct().repartition("path")
    return dealt.mapInArrow(run, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0)).alias("n")).first()["n"]
