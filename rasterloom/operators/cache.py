"""A bounded source cache as relations: index, lookups, evictions and replays.

A cache is a serial machine, so a full replay orders the operations of each cache and folds over them, one group for
each cache. Where only hits and misses are asked of an access log (a miss is followed by an upload, and only the number
of files is bounded) the state at any time is the most recent distinct keys, and `replay_accesses` replays slices of
one log in parallel from such states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.text import stem
from rasterloom.operators.lru import LruState
from rasterloom.schemas import CACHE_EVENT
from rasterloom.scratch import written

#: Accesses to a slice of a log that a task replays.
SLICE = 200_000
#: Slices whose first states a task works out together.
GROUP = 1000


def blob_index(spark: SparkSession, directory: str) -> DataFrame:
    """(source_id, path, length, last_access, position_at) of a folder: of entries with one stem, the one modified last;
    position_at is when the stem's first file was modified, by which a restarted cache orders its entries. A folder in
    it, as a table of several files is one, is an entry with the length and the times of its files; empty ones aren't
    seen. Contents are not read; names that start with a dot or an underscore are skipped."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    inside = F.substring_index(F.substr("path", F.lit(len(root) + 1)), "/", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "length", "modificationTime")
    # a pattern of folders has no common root: its files are the entries
    entry = F.when(F.col("path").startswith(root), F.concat(F.lit(root), inside)).otherwise(F.col("path"))
    entries = files.groupBy(entry.alias("path")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"), F.min("modificationTime").alias("first"))
    entries = entries.withColumn("source_id", stem(F.col("path")))
    first = entries.groupBy("source_id").agg(F.min("first").alias("position_at"))
    return latest(entries, "source_id", "modificationTime", ["path", "length"]).join(first, "source_id")


def latest(rows: DataFrame, key: str, at: str, values: list[str], as_at: str = "last_access") -> DataFrame:
    """For each key, the values of its last row."""
    picked = F.max_by(F.struct(*values), F.struct(at, *values)).alias("p")
    return rows.groupBy(key).agg(picked, F.max(at).alias(as_at)).select(key, *[F.col(f"p.{v}").alias(v) for v in values], as_at)


def live(requests: DataFrame, index: DataFrame, key: str = "source_id") -> DataFrame:
    return requests.join(index, key, "left_semi")


def stale(requests: DataFrame, index: DataFrame, key: str = "source_id") -> DataFrame:
    return requests.join(index, key, "left_anti")


def kept_after_limits(entries: DataFrame, recency: list, size: str, max_files: int, max_bytes: int, orphan_bytes: int = 0) -> DataFrame:
    """The entries that stay when limits are enforced before an insert: the most recent max_files - 1, and of those as
    many of the most recent as fit into max_bytes. recency: order, the most recent first. At most max_files - 1 rows
    take part in the running sum, however many entries there are."""
    recent = entries.orderBy(*recency).limit(max(0, max_files - 1))
    running = Window.orderBy(*recency).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return recent.withColumn("running", F.sum(size).over(running) + orphan_bytes).where(F.col("running") <= max_bytes).drop("running")


def replay(operations: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Outcomes of every cache's operations (schemas.CACHE_OPERATION) in order of seq, as schemas.CACHE_EVENT."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, cache = LruState(max_files, max_bytes), None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.cache_id != cache:
                    state, cache = LruState(max_files, max_bytes), r.cache_id
                done = state.apply(r.op, r.source_id, r.extension or "", int(r.length or 0) if r.length == r.length else 0)
                out += [(r.cache_id, r.seq, r.op, *x) for x in done]
            yield pd.DataFrame(out, columns=["cache_id", "seq", "op", "source_id", "outcome", "path"])

    ordered = operations.select("cache_id", "seq", "op", "source_id", "extension", "length").repartition("cache_id").sortWithinPartitions("cache_id", "seq")
    return ordered.mapInPandas(fold, CACHE_EVENT)  # rows stream by; a task holds the state of one cache


def _after(state: list, keys: list, max_files: int) -> list:
    """The most recent distinct keys, the latest last, after these (distinct, in order) were used."""
    used = set(keys)
    return ([k for k in state if k not in used] + keys)[-max_files:]


def _starts(recent: DataFrame, key: str, max_files: int) -> DataFrame:
    """(__slice, start): the cache at the start of each slice, from the last keys of each (__slice, key, last). Slices
    are taken in groups: the driver sees max_files keys for each GROUP of them, and a task goes through one group."""
    spark, kind = recent.sparkSession, recent.schema[key].dataType.simpleString()
    grouped = recent.withColumn("__group", F.expr(f"__slice div {GROUP}"))
    ends = grouped.groupBy("__group", key).agg(F.max("last").alias("last"))
    rank = F.row_number().over(Window.partitionBy("__group").orderBy(F.desc("last")))
    ends = ends.withColumn("rank", rank).where(F.col("rank") <= max_files).groupBy("__group").agg(F.sort_array(F.collect_list(F.struct("last", key))).alias("keys"))
    states, state = [], []
    for r in ends.orderBy("__group").collect():
        states.append((r["__group"], state))
        state = _after(state, [k[key] for k in r["keys"]], max_files)
    before = spark.createDataFrame(states, f"__group long, start array<{kind}>")

    def through(_: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        held, out = list(start.start.iloc[0]), []
        for number, part in pdf.sort_values(["__slice", "order"]).groupby("__slice"):
            out.append((number, held))
            held = _after(held, part[key].tolist(), max_files)
        return pd.DataFrame(out, columns=["__slice", "start"])

    ordered = grouped.withColumn("order", -F.col("rank")).select("__group", "__slice", key, "order")
    return ordered.groupBy("__group").cogroup(before.groupBy("__group")).applyInPandas(through, f"__slice int, start array<{kind}>")


def replay_accesses(log: DataFrame, key: str, at: str, tie: str, max_files: int, slice_rows: int = SLICE) -> DataFrame:
    """The log's columns and hit: whether the key was in a cache of max_files keys that holds what was used last.

    The log is cut into slices by time and tie together, so many accesses at one time are many slices; what a slice
    leaves behind is its last max_files distinct keys, so the state at the start of each follows from short summaries
    of those before it."""
    timed = log.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))
    slices = max(1, log.count() // slice_rows)
    # the slice of a row is settled where it is written
    rows = written(timed.repartitionByRange(slices, "__at", tie).withColumn("__slice", F.spark_partition_id()))
    last = rows.groupBy("__slice", key).agg(F.max(F.struct("__at", tie)).alias("last"))
    recent = last.withColumn("rank", F.row_number().over(Window.partitionBy("__slice").orderBy(F.desc("last")))).where(F.col("rank") <= max_files)
    starts = _starts(recent, key, max_files)

    def run(group: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__at", tie])
        held = dict.fromkeys(start.start.iloc[0]) if len(start) else {}
        hits = []
        for k in pdf[key]:
            hits.append(k in held)
            held.pop(k, None)
            held[k] = None
            if len(held) > max_files:
                del held[next(iter(held))]
        return pdf.drop(columns=["__at", "__slice"]).assign(hit=hits)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    return rows.groupBy("__slice").cogroup(starts.groupBy("__slice")).applyInPandas(run, f"{kinds}, hit boolean")
