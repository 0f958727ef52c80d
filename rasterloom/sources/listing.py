"""A folder's entries as a table: every one of them, dotted names and folders too, without a look at contents."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

from rasterloom.sources.blobs import _at

ENTRY = "source_id string, name string, path string, length long, modified timestamp, is_folder boolean"
_KINDS = pa.schema([("source_id", pa.string()), ("name", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())])
#: Without this setting Spark keeps filters to itself.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Entries(InputPartition):
    rows: list


def _test(f: Filter) -> object:
    """A test of (source_id, name) for a filter that a listing can answer; None for others."""
    column = getattr(f, "attribute", ())
    if column not in (("source_id",), ("name",)):
        return None
    at = ("source_id", "name").index(column[0])
    if isinstance(f, IsNotNull):
        return lambda row: True
    if isinstance(f, EqualTo):
        return lambda row: row[at] == f.value
    if isinstance(f, In):
        return lambda row: row[at] in f.value
    if isinstance(f, StringStartsWith):
        return lambda row: row[at].startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda row: row[at].endswith(f.value)
    return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory, self.glob, self.each = options["path"], options.get("glob", "*"), int(options.get("entriesPerTask", 10_000))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if (test := _test(f)) is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Entries]:
        store, at = _at(self.directory)
        rows = []
        for f in store.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            row = (os.path.splitext(f.base_name)[0], f.base_name, f.path, f.size, f.mtime, f.type == pafs.FileType.Directory)
            if fnmatch.fnmatchcase(f.base_name, self.glob) and all(test(row) for test in self.tests):
                rows.append(row)
        return [Entries(rows[k : k + self.each]) for k in range(0, len(rows), self.each)] or [Entries([])]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*partition.rows, strict=True)) or [[]] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.types, strict=True)], schema=_KINDS)


class FolderListing(DataSource):
    """`spark.read.format("listing").load(directory)`; options glob, entriesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def list_folder(spark: SparkSession, directory: str, **options: str) -> DataFrame:
    """The entries of a folder (ENTRY); a folder that isn't there has none. source_id is the name without its last
    extension. The driver lists names, as Spark's own file sources do; filters on names are applied there."""
    spark.dataSource.register(FolderListing)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("listing").options(**options).load(directory)


def index(entries: DataFrame) -> DataFrame:
    """(source_id, path, length, last_access): of entries with one stem that which was modified last, folders too."""
    picked = F.max_by(F.struct("path", "length"), F.struct("modified", "path")).alias("p")
    return entries.groupBy("source_id").agg(picked, F.max("modified").alias("last_access")).select("source_id", "p.path", "p.length", "last_access")
