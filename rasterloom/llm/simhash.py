"""SimHash near-duplicates by Golay codes.

Fingerprints of 64 bits are cut into three segments of 22, 21 and 21 bits. If two differ in at most four bits, the
segment with the most errors holds a third of them at least, so some two segments together have two errors at most,
and some word lies within one bit of both fingerprints there. The binary Golay code of length 23 is perfect: every
word is within three bits of exactly one codeword. A fingerprint's keys for a pair of segments are therefore the
codeword indices of the pair itself and of the pair with one bit turned, about ten distinct ones, and linked
fingerprints share one. Distinct fingerprints are dealt by their keys and compared there; a key with many of them is
cut into blocks, and pairs of blocks are compared by different tasks. A task emits for each fingerprint it could link
the centre of what it is connected with there, never all pairs. Components follow from those edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import written
from rasterloom.llm.components import connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b101011100011
#: Fingerprints of one key that a task compares with each other at once.
BLOCK = 2048
SEED = 42
STRIDE = 255 * 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bits set in over half of the XXH64 values of the shingles of a text's words, A-Z in lower case; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) >= shingle else [b" ".join(words)]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), STRIDE):
        part = shingles[at : at + STRIDE]
        values = np.zeros(-(-len(part) // 255) * 255, "<u8")
        values[: len(part)] = np.fromiter([digest(s, SEED) for s in part], np.uint64, len(part))
        bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, 255, 64)
        counts += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id and fp (the fingerprint as a signed long); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, fp long")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the upper 11 and the lower 12 bits of a word, and the error pattern of each syndrome."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    syndromes = np.array([[remainder(i << 12) for i in range(2048)] * 2, [remainder(i) for i in range(4096)]], np.int64)
    errors = np.zeros(2048, np.int64)
    for a in range(-1, 23):
        for b in range(a, 23) if a >= 0 else [-1]:
            for c in range(b, 23) if b >= 0 else [-1]:
                e = 0
                for bit in {a, b, c} - {-1}:
                    e |= 1 << bit
                errors[remainder(e)] = e
    return syndromes, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index, of 12 bits, of the codeword within three bits of each word of 23 bits."""
    syndromes, errors = _tables()
    return (words ^ errors[syndromes[0][words >> 12] ^ syndromes[1][words & 4095]]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For uint64 fingerprints: (row, key) of their distinct keys."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay_index(p[:, None] ^ np.array([0, *(1 << i for i in range(n))], np.int64)) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    rows, keys = [], []
    for k, (i, j) in enumerate(PAIRS):
        own = np.hstack([near[i] << 12 | near[j][:, :1], near[i][:, :1] << 12 | near[j][:, 1:]]) | k << 24
        own.sort(axis=1)
        new = np.ones(own.shape, bool)
        new[:, 1:] = own[:, 1:] != own[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(own[r, c])
    return np.concatenate(rows), np.concatenate(keys)


#: Bits of a key, and of the number of the kind of fingerprint that stands above it.
KEY_BITS, KIND_BITS = 26, 6


def _key_rows(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, all_fps = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            for at in range(0, len(all_fps), 4096):
                part = all_fps[at : at + 4096]
                rows, keys = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys | kinds[at : at + 4096][rows] << KEY_BITS), pa.array(part[rows])], ["key", "fp"])

    return fps.select("kind", "fp").mapInArrow(run, "key long, fp long")


def _linked(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(fingerprint, centre of what links connect it with), for distinct uint64 fingerprints in order. A centre is the
    one nearest to the majority of its group's bits, so tasks that see parts of a dense group mostly agree on it."""
    out, left = [], fps
    while len(left) > 1:
        group, front, left = [left[0]], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= bits
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                group.extend(found)
        if len(group) > 1:
            members = np.sort(np.array(group, np.uint64))
            counts = np.unpackbits(members.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
            most = np.packbits(counts * 2 > len(members), bitorder="little").view("<u8")[0]
            centre = members[np.bitwise_count(members ^ most).argmin()]
            out.extend((x, centre) for x in members if x != centre)
    return out


def _compare(rows: DataFrame, bits: int) -> DataFrame:
    """Edges (kind, u, v) among rows (group, fp), which are dealt by group and in order of it."""

    def edges(group: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
        groups, us, vs = list(group[near]), list(fp[near + 1]), list(fp[near])
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            for u, v in _linked(np.unique(fp[at : at + n]), bits):
                groups.append(group[at])
                us.append(u)
                vs.append(v)
        if us:
            kinds = (np.array(groups, np.int64) >> KEY_BITS & (1 << KIND_BITS) - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs))], ["kind", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            group = np.concatenate([held_group, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            last = np.searchsorted(group, group[-1]) if len(group) else 0
            if last:
                yield from edges(group[:last], fp[:last])
            held_group, held_fp = group[last:], fp[last:]
        if len(held_group):
            yield from edges(held_group, held_fp)

    return rows.select("group", "fp").mapInArrow(run, "kind int, u long, v long")


def fingerprint_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (kind, u, v) that connect all fingerprints of a kind (columns kind, from 0 to 63, and fp, distinct) which
    differ in at most `bits` (4 or fewer) bits."""
    # each fingerprint becomes thirty rows: small partitions of them are worth a task
    keys = _key_rows(fps.repartition(fps.sparkSession.sparkContext.defaultParallelism, "fp"))
    # a written table has a size that Spark knows: usually so small that the keys needn't be moved for this join
    crowded = written(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK))
    dealt = keys.join(crowded, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.filter(other, lambda b: b != own), lambda b: (F.least(b, own) * F.col("blocks") + F.greatest(b, own)).cast("long"))
    )
    # the pair of blocks stands above the key
    rows = dealt.select(F.explode(pairs).alias("pair"), "key", "fp").select((F.call_function("shiftleft", F.col("pair"), F.lit(KEY_BITS + KIND_BITS)) + F.col("key")).alias("group"), "fp")
    return _compare(rows.repartition("group").sortWithinPartitions("group"), bits).distinct()


def simhash_components(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Rows with
    equal ids or texts are kept, each in its component; null ids are never a component_id unless a component has no
    other. Whole texts count, however long. Other columns are not carried; an empty table gives no rows.

    There are three times 2 ** 24 keys, of which a fingerprint has about thirty: from some 10 ** 8 distinct
    fingerprints on, strangers fill them, and comparing a key's blocks with each other takes most of the time.
    """
    found = written(fingerprints(docs, shingle, id_col, text_col))
    distinct = found.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(fingerprint_links(distinct.select(F.lit(0).alias("kind"), "fp"), bits))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only fingerprints with links need their group's smallest id looked up
    groups = labelled.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    components = labelled.join(groups, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return found.join(components, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
