"""A log of socket frames as a replayable streaming source.

A socket can't be read twice, so what comes from it is appended to a log: a folder of numbered segments, each written
by one Spark job and visible once it is complete. `format("frames")` streams the log. Its offset is the number of
segments read, so a batch that runs again, or a query that goes on from its checkpoint, reads the same frames. Tasks
read row groups; the driver lists segments and reads footers alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from rasterloom.sources.blobs import _at

FRAME = "channel string, ts timestamp, value string"
_KINDS = pa.schema([("channel", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("value", pa.string())])


def _segments(directory: str) -> list[tuple[int, str]]:
    """Numbers and paths of complete segments, in order, up to the first that isn't there."""
    store, at = _at(directory)
    found = {}
    for f in store.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if f.type == pafs.FileType.Directory and f.base_name.isdigit() and store.get_file_info(f"{f.path}/_SUCCESS").is_file:
            found[int(f.base_name)] = f.path
    first = min(found, default=0)
    out = []
    while first + len(out) in found:
        out.append((first + len(out), found[first + len(out)]))
    return out


def append_frames(frames: DataFrame, directory: str) -> int:
    """Appends rows (FRAME) as the next segment; its number. One writer at a time; what a writer left incomplete is
    written over by the next."""
    known = _segments(directory)
    number = known[-1][0] + 1 if known else 0
    frames.selectExpr("cast(channel AS string) AS channel", "cast(ts AS timestamp) AS ts", "cast(value AS string) AS value").write.mode("overwrite").parquet(f"{directory}/{number:010d}")
    return number


@dataclass
class RowGroups(InputPartition):
    path: str
    first: int
    last: int


class _Log:
    """What reading once and streaming share."""

    def __init__(self, options: dict):
        self.directory = options["path"]
        self.groups = int(options.get("rowGroupsPerTask", 4))
        self.drop = str(options.get("dropCommitted", "false")).lower() == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        known = _segments(self.directory)
        return {"segments": known[0][0] if known else 0}

    def latestOffset(self) -> dict:  # noqa: N802
        known = _segments(self.directory)
        return {"segments": known[-1][0] + 1 if known else 0}

    def between(self, start: dict, end: dict) -> list[RowGroups]:
        store, out = _at(self.directory)[0], []
        there = dict(_segments(self.directory))
        for k in range(start["segments"], end["segments"]):
            if k not in there:
                raise FileNotFoundError(f"segment {k} of {self.directory} is gone")
            for f in sorted(store.get_file_info(pafs.FileSelector(there[k])), key=lambda f: f.path):
                if f.base_name.endswith(".parquet"):
                    with store.open_input_file(f.path) as file:
                        n = pq.ParquetFile(file).num_row_groups
                    out += [RowGroups(f.path, i, min(n, i + self.groups)) for i in range(0, n, self.groups)]
        return out

    def read(self, partition: RowGroups | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty log, read once
            return
        store, _ = _at(self.directory)
        with store.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(8192, list(range(partition.first, partition.last)), _KINDS.names):
                yield pa.Table.from_batches([batch]).cast(_KINDS).combine_chunks().to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], _KINDS)


class _Reader(_Log, DataSourceReader):
    def partitions(self) -> list[RowGroups]:
        return self.between(self.initialOffset(), self.latestOffset())


class _StreamReader(_Log, DataSourceStreamReader):
    def partitions(self, start: dict, end: dict) -> list[RowGroups]:
        return self.between(start, end)

    def commit(self, end: dict) -> None:
        """With dropCommitted, segments that no later batch can ask for go."""
        if self.drop:
            store, _ = _at(self.directory)
            for k, path in _segments(self.directory)[:-1]:  # the last one keeps the count
                if k < end["segments"]:
                    store.delete_dir(path)


class FrameSource(DataSource):
    """`spark.read` or `spark.readStream.format("frames").load(directory)`; options rowGroupsPerTask, dropCommitted."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:  # noqa: ANN001, N802
        return _StreamReader(self.options)


def read_frames(spark: SparkSession, directory: str, **options: str) -> DataFrame:
    """The log as a stream."""
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("frames").options(**options).load(directory)
