"""Importance resampling towards a target distribution.

Distinct words of a group of texts get integer ids, runs of words are tuples of ids, and every distinct tuple's bytes
are put together and hashed once, to one of a fixed number of buckets; the buckets are joined back to the runs by
the tuples' positions. The buckets of every document are kept, two bytes each, so that its words are read once: a pass
over them adds up both collections, of which only one count a bucket leaves the executors, and with the gains that
follow, which are broadcast, another weighs every document. Those that take part are
ranked by their weight with Gumbel noise, which draws without replacement in proportion to the weights: they are dealt
by ranges of the score, and a row's rank is its place in its range after the rows of all ranges before it.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import GROUP_BYTES, forget, free_name, grouped, written

#: How a bucket is kept.
KIND = np.dtype("<u2")
#: What is part of a word: digits, letters and all bytes of other characters; A-Z in lower case.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _of(hashes: list[int], buckets: int, tuples: np.ndarray) -> np.ndarray:
    """The bucket of each tuple, by the hashes of distinct ones."""
    return (np.array(hashes, np.int64) % buckets)[tuples]


def _features(texts: list[bytes | None], buckets: int, longest: int) -> tuple[np.ndarray, list[bytes]]:
    """The number of words of each text, and the buckets of its runs, of one word first, packed as KIND."""
    number: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next id
    lists = [t.translate(_WORD).split() if t else [] for t in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, int(lengths.sum()))
    del lists
    words = list(number)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at, tuples, hashes = np.arange(len(ids)), ids, list(map(zlib.crc32, words))
    runs = [_of(hashes, buckets, tuples)]
    for n in range(2, longest + 1):
        inside = at + n - 1 < ends[at]
        at, before = at[inside], tuples[inside]
        # a tuple is that without its last word, and the last word; it keeps the hash of its bytes so far
        pairs, tuples = np.unique(before * len(words) + ids[at + n - 1], return_inverse=True)
        heads, tails = np.divmod(pairs, max(1, len(words)))
        spaced = list(map(zlib.crc32, repeat(b" "), hashes))
        hashes = list(map(zlib.crc32, map(words.__getitem__, tails.tolist()), map(spaced.__getitem__, heads.tolist())))
        runs.append(_of(hashes, buckets, tuples))
    parts = []
    for n, found in enumerate(runs):
        to = np.cumsum(np.maximum(0, lengths - n)).tolist()
        parts.append([found[i:j].tobytes() for i, j in zip([0, *to], to, strict=False)])
    return lengths, list(map(b"".join, zip(*parts, strict=True)))


def _of(hashes: list[int], buckets: int, tuples: np.ndarray) -> np.ndarray:
    """The bucket of each tuple, by the hashes of distinct ones."""
    return (np.array(hashes, np.int64) % buckets).astype(KIND)[tuples]


def feature_buckets(docs: DataFrame, buckets: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """(id, words, features): the number of words of each text and its runs' buckets, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in grouped(batch.column(1), GROUP_BYTES):
                words, features = _features(some, buckets, longest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(words), pa.array(features, pa.binary())], ["id", "words", "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, words long, features binary")


def bucket_counts(found: DataFrame, buckets: int) -> list[int]:
    """How many features fall in each bucket. Each task sends a row for each bucket that it met, the driver gets one
    for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), KIND), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    out = [0] * buckets
    for r in found.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, with one more in every bucket, floored."""
    s_all, t_all = float(sum(source) + len(source)), float(sum(target) + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target, strict=True)], np.int64)


def importance_draw(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, seed: str = "7", buckets: int = 10_000, longest: int = 2,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """A row for each row of docs: the id, n_features, weight, score, and rank (from 1) of those that are drawn.

    Of the rows with least_words words or more, the share (numerator, denominator), rounded down, of highest scores is
    drawn; ties go to the smaller id, null ids last, and rows that are equal in both get ranks next to each other. The
    noise is that of the id's text, of an empty one for null ids, so repeated rows have equal scores. A null text has
    no words, no features and weight 0. Whole texts count, however long; other columns are not carried; an empty table
    gives no rows, an empty target makes rare buckets gain.
    """
    if buckets > 1 << 16:
        raise ValueError("a bucket has two bytes")
    found = written(feature_buckets(docs, buckets, longest, id_col, text_col))
    aim = feature_buckets(target.withColumn(free_name(target, "id"), F.lit(None)), buckets, longest, free_name(target, "id"), target_text)
    value = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(found, buckets), bucket_counts(aim, buckets)))  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, noise = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                b = np.frombuffer(x.as_buffer(), KIND)
                sums.append((len(b), int(value.value[b].sum()) // max(1, len(b))))
                h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
                noise.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            features, weight = np.array(sums, np.int64).reshape(-1, 2).T
            score = weight + np.array(noise, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, (features, weight, score))], ["id", "words", "n_features", "weight", "score"])

    weighed = found.mapInArrow(run, "id long, words long, n_features long, weight long, score long")
    # numbers for the rows spread ties of one id over ranges; they stay as they are once the table is written
    weighed = written(weighed.withColumn("row", F.monotonically_increasing_id()))
    forget(found)
    part_in = F.col("words") >= least_words
    drawn = share[0] * weighed.where(part_in).count() // share[1]
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    # the number of a row holds its partition and, in the lower 33 bits, its place there
    ranges = written(weighed.where(part_in).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    inside = ranges.select(F.shiftright("at", 33).alias("part"), (F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("place"), "id", "n_features", "weight", "score")
    before, first = 0, []
    for r in inside.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        first.append((r["part"], before))
        before += r["n"]
    offsets = docs.sparkSession.createDataFrame(first, "part long, before long")
    rank = F.col("before") + F.col("place")
    ranked = inside.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return ranked.select(*columns, "rank").union(weighed.where(~part_in).select(*columns, F.lit(None).cast("long").alias("rank")))
