"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.scratch import drop_written, forget, written  # noqa: F401  used throughout this subpackage

#: Bytes of text that a task handles together; keeps working sets small whatever Arrow sends at once.
GROUP_BYTES = 2_000_000


#: Rows that Arrow hands to Python at once in the queries here; long texts make large batches of its default of 10,000.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Lets batches of whole texts stay small in this session; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % k).cast("int")


def hash_sample(rows: DataFrame, size: int, key: str, *ties: Column | str) -> DataFrame:
    """The `size` rows whose key's hashes are lowest. Rows that can't be among them are filtered where they are read,
    so about twice as many are moved, however many there are; where keys repeat or are null so often that too few rows
    pass, all take part."""
    n = rows.count()
    if n > 4 * size:
        low = rows.where(F.xxhash64(key) < (2 * size * (1 << 64)) // n - (1 << 63))
        if low.count() >= size:
            rows = low
    return rows.orderBy(F.xxhash64(key), key, *ties).limit(size)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def grouped(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, list]]:
    """A binary array in parts (start, values) of about `limit` bytes, so that Python holds few of them at once."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit)) + 1
        yield start, texts[start:end].to_pylist()
        start = end


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (numbers or strings without nulls)."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *starts.tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:], strict=False):
            part = pa.Table.from_batches([batch.slice(start, end - start)])
            if held and any(held[0][c][0] != part[c][0] for c in keys):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def each_run(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """A function of Arrow batches, dealt and in order of the keys, that works on each run of equal keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            found = work(group)
            if found.num_rows:
                yield found

    return run
