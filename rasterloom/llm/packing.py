"""Best-fit packing by length patterns and non-negative least squares.

Documents are encoded once and cut into pieces of at most the capacity. Only the histogram of piece lengths, of at
most `capacity` entries whatever the corpus, reaches the driver. There, patterns of one to four lengths that fill a
sequence exactly are enumerated, repeat counts are fitted to the histogram by non-negative least squares (coordinate
descent, of a bounded number of sweeps) and rounded within what is there, and best fit decreasing, over lengths with
their counts, packs the rest; of some ways to choose and round, that with the fewest sequences is taken. The plan's size
depends on the capacity alone, so it may be broadcast; each piece finds its place from its length and its rank among
the pieces of that length, and ranks are counted in salted parts, since one length can hold a third of all pieces.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm.chunks import ChunkTable, shared_table
from rasterloom.llm.common import grouped, written

#: Shares of what the first document leaves, for the second of three, and for the second and third of four.
SHARES = (0.5, 0.6, 0.7, 0.8, 0.9)
SWEEPS = 12
#: How repeat counts become whole numbers. Small counts say little about a pattern, so leaving more to best fit can be
#: better; so can keeping short pieces for long ones, by patterns of two lengths at most. Of the plans made with each,
#: the one that needs the fewest sequences is taken, the first of several.
ROUNDINGS = (round, math.floor, lambda x: math.floor(x / 2))
#: Pieces of one length to a salted part of the ranking.
PART = 65_536


def _word_table(path: str) -> ChunkTable:
    """Words between ASCII white space, which the tokenizer drops and no token crosses, to their ids as bytes."""

    def make() -> ChunkTable:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        model = Tokenizer.from_file(path)
        if model.encode("a b\nc", add_special_tokens=False).ids != [i for w in "abc" for i in model.encode(w, add_special_tokens=False).ids]:
            raise ValueError("tokens of this model depend on white space")

        tokenize = model.model.tokenize

        def of_letters(word: bytes) -> bytes:
            """a-z are what normalising and splitting leave as they are, so the model's merges are all there is to do."""
            return array("I", [t.id for t in tokenize(word.decode())]).tobytes()

        marks = {m: np.array(model.encode(m.decode(), add_special_tokens=False).ids, "<u4").tobytes() for m in (b".", b",")}

        def work(words: list[bytes]) -> list[tuple]:
            found: dict[bytes, bytes] = {}
            for w in words:
                if w.isalpha() and w.islower():
                    found[w] = of_letters(w)
                elif w[-1:] in marks and (stem := w[:-1]).isalpha() and stem.islower():
                    found[w] = (found.get(stem) or of_letters(stem)) + marks[w[-1:]]  # tokens end where letters do
            rest = [w for w in words if w not in found]
            for w, e in zip(rest, model.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
                found[w] = array("I", e.ids).tobytes()
            return [(found[w],) for w in words]

        return ChunkTable(work, 1)

    return shared_table(("words", path), make)


def _words(text: bytes) -> list[bytes]:
    """The model folds case itself; folding A-Z before only lets words share entries, and is left out where a special token's string may stand."""
    return (text if b"<|" in text else text.lower()).split()


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32; full adds ids (little-endian 32-bit, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = _word_table(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for start, texts in grouped(batch.column(1)):
                lists = [_words(x) if x else [] for x in texts]
                table.learn(lists)
                out, ids_of = [], table.column(0)
                for name, words in zip(names[start : start + len(texts)], lists, strict=True):
                    ids = memoryview(b"".join(map(ids_of, words)) + end)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((name, k, at // 4, len(part) // 4, zlib.crc32(part), *([bytes(part)] if full else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if full else ""))


def patterns(capacity: int) -> list[tuple[int, ...]]:
    """Exact fills of one to four lengths; the later lengths take shares of what the earlier ones leave."""
    found = {(capacity,)}
    for a in range(1, capacity):
        rest = capacity - a
        found.add(tuple(sorted((a, rest))))
        for s in SHARES:
            b = round(s * rest)
            if 0 < b < rest:
                found.add(tuple(sorted((a, b, rest - b))))
                for t in SHARES:
                    c = round(t * (rest - b))
                    if 0 < c < rest - b:
                        found.add(tuple(sorted((a, b, c, rest - b - c))))
    return sorted(found, key=lambda p: (len(p), p))


def fit(histogram: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares by coordinate descent: how often to repeat each pattern so that together they use the histogram."""
    left = histogram.astype(float).tolist()
    usable = [(j, p, {x: p.count(x) for x in p}) for j, p in enumerate(columns) if all(histogram[x] for x in p)]
    times = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for j, p, need in usable:
            step = sum([left[x] for x in p]) / sum([n * n for n in need.values()])
            if step < -times[j]:
                step = -times[j]
            if step:
                times[j] += step
                moved += abs(step)
                for x, n in need.items():
                    left[x] -= n * step
        if moved < 0.001 * max(1, sum(times)):
            break
    return times


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing over lengths with counts: ((length, times) of a sequence, number of such sequences)."""
    room: dict[int, list] = {}  # by what is left: open groups of like sequences
    has = np.zeros(capacity + 1, bool)
    done = []

    def put(left: int, lengths: tuple, n: int) -> None:
        if left:
            room.setdefault(left, []).append((lengths, n))
            has[left] = True
        else:
            done.append((lengths, n))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = length + int(np.argmax(has[length:])) if has[length:].any() else 0
            if at:
                lengths, count = room[at].pop()
                has[at] = bool(room[at])
                times = min(at // length, n)
                k = min(count, n // times)
                if k < count:
                    put(at, lengths, count - k)
                put(at - times * length, (*lengths, (length, times)), k)
            else:
                times = min(capacity // length, n)
                k = n // times
                put(capacity - times * length, ((length, times),), k)
            n -= k * times
    return done + [x for groups in room.values() for x in groups]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Slots, sorted by length and rank: length, first rank, ranks, times in a sequence, first sequence, offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    columns, tried = patterns(capacity), []
    for some in (columns, [p for p in columns if len(p) < 3]):
        fitted = [(p, x) for p, x in zip(some, fit(counts, some), strict=True) if x >= 0.5]
        for whole in ROUNDINGS:
            chosen, left = [], counts.copy()
            for p, x in fitted:
                need = {v: p.count(v) for v in p}
                if (n := min([whole(x), *(int(left[v]) // k for v, k in need.items())])) > 0:
                    chosen.append((tuple(need.items()), n))
                    for v, k in need.items():
                        left[v] -= n * k
            chosen += best_fit({int(v): int(left[v]) for v in np.flatnonzero(left)}, capacity)
            tried.append(chosen)
    chosen = min(tried, key=lambda c: sum(n for _, n in c))
    slots, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, n in chosen:
        offset = 0
        for length, times in lengths:
            slots.append((length, int(used[length]), n * times, times, sequence, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    return np.array(sorted(slots), np.int64).reshape(-1, 6)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and has the end id alone. Equal texts, equal ids and null ids are all packed, each
    row for itself; full adds the pieces' ids. Whole texts count, however long. An empty table gives no rows. Other
    columns are not carried.
    """
    pieces = written(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, full))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    # rows for the lengths that need several parts alone, of which there are as many as lengths at most
    many = [(length, -(-n // PART)) for length, n in histogram.items() if n > PART]
    parts = docs.sparkSession.createDataFrame(many, "length long, parts long")
    salt = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.coalesce("parts", F.lit(1)))
    salted = pieces.join(F.broadcast(parts), "length", "left").withColumn("part", salt).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(inside)).join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("row") - 1)
    held = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        key = s[:, 0] * (1 << 50) + s[:, 1]
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
                at = s[np.searchsorted(key, length * (1 << 50) + rank, "right") - 1]
                k, inside = np.divmod(rank - at[:, 1], at[:, 3])
                kept = [batch.column(batch.schema.names.index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(at[:, 4] + k), pa.array(at[:, 5] + inside * length)], [*columns, "sequence_id", "offset"])

    columns = pieces.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*columns, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long").withColumnRenamed("id", id_col)
