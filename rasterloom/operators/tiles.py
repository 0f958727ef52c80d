"""Rasters as tables of tiles, for images that are too large for a row.

A tile is a row (id, ty, tx, v): SIZE x SIZE grey values in order of rows, a byte each, zero where the image has none.
What asks for a region reads the tiles that touch it alone; what looks at neighbours gets a halo, which each tile hands
to the tiles around it. So no row is larger than a tile with its halo, whatever the image's size. Joins, grouping and
shuffles are Spark's; numpy works on a few hundred tiles at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.raster import PAD

SIZE = 64
#: Tiles that numpy works on at once.
ROWS = 500
_TILE = ("ty long, tx long, v binary", [pa.int64(), pa.int64(), pa.binary()])
_DOTS = ("x long, y long, v int", [pa.int64(), pa.int64(), pa.int32()])
_DOT = np.dtype([("at", "<i4"), ("v", "u1")])
_EDGE = ("a long, b long, c long, d long", [pa.int64()] * 4)


def _each(rows: DataFrame, work: Callable[..., Iterable[tuple]], out: tuple[str, list]) -> DataFrame:
    """Rows (id, and others) to any number of rows (id, and `out`): work takes a row's values after the id."""
    names = [c.split()[0] for c in out[0].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, found = [], []
            for k, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                some = list(work(*values))
                source += [k] * len(some)
                found += some
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, out[1], strict=True))], ["id", *names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {out[0]}")


def _batches(rows: DataFrame, work: Callable[..., tuple], out: tuple[str, list]) -> DataFrame:
    """As _each, for work on ROWS rows at once: from Arrow columns to the numbers of the rows that the results come
    from, and the columns of `out`, as numpy arrays or Arrow ones."""
    names = [c.split()[0] for c in out[0].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                source, *columns = work(*part.columns[1:])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(source)), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, out[1], strict=True))], ["id", *names])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {out[0]}")


def _stacked(v: pa.Array) -> np.ndarray:
    """Tiles of one size, a row each, without a copy."""
    if not len(v):
        return np.zeros((0, 1), np.uint8)
    ends = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
    return np.frombuffer(v.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(v), -1)


def _packed(tiles: np.ndarray) -> pa.Array:
    n, size = tiles.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(tiles))])


def _numbers(*columns: pa.Array) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def _merged(parts: DataFrame) -> DataFrame:
    """Parts of tiles, of which a few meet in one, as one tile each: the larger value of each place."""
    met = parts.groupBy("id", "ty", "tx").agg(F.collect_list("v").alias("vs"))

    def largest(ty: pa.Array, tx: pa.Array, vs: pa.Array) -> tuple:
        n = pc.list_value_length(vs).to_numpy()
        return np.arange(len(n)), ty, tx, _packed(np.maximum.reduceat(_stacked(vs.flatten()), np.cumsum(n) - n))

    return _batches(met, largest, _TILE)


def to_tiles(pixels: DataFrame, size: int = SIZE) -> DataFrame:
    """Pixels (id, x, y, v from 0 to 255) as tiles; of several values of a pixel the largest counts, those at negative
    places are left out. Tiles without a pixel have no row."""
    one = pixels.where("x >= 0 and y >= 0").groupBy("id", "x", "y").agg(F.max(F.col("v").cast("int")).alias("v"))
    at = ((F.col("y") % size) * size + F.col("x") % size).cast("int")
    listed = one.groupBy("id", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx")).agg(F.collect_list(at).alias("at"), F.collect_list("v").alias("v"))

    def tile(ty: pa.Array, tx: pa.Array, places: pa.Array, values: pa.Array) -> tuple:
        out = np.zeros((len(ty), size * size), np.uint8)
        out[np.repeat(np.arange(len(ty)), pc.list_value_length(places).to_numpy()), places.flatten().to_numpy()] = values.flatten().to_numpy()
        return np.arange(len(ty)), ty, tx, _packed(out)

    return _batches(listed, tile, _TILE)


def to_pixels(tiles: DataFrame, size: int = SIZE, least: int = 0) -> DataFrame:
    """The pixels of tiles whose value is over `least`."""
    def dots(ty: pa.Array, tx: pa.Array, v: pa.Array) -> tuple:
        tiles_, (ty, tx) = _stacked(v), _numbers(ty, tx)
        k, at = np.nonzero(tiles_ > least)
        return k, tx[k] * size + at % size, ty[k] * size + at // size, tiles_[k, at]

    return _batches(tiles.select("id", "ty", "tx", "v"), dots, _DOTS)


def tile_boxes(tiles: DataFrame, width: int, height: int, pad: int = PAD, least: int = 0, size: int = SIZE) -> DataFrame:
    """As raster.mask_boxes: a summary of every tile, then the least and the greatest of an image's tiles."""
    def edge(ty: pa.Array, tx: pa.Array, v: pa.Array) -> tuple:
        ty, tx = _numbers(ty, tx)
        k, at = np.nonzero(_stacked(v) > least)
        first = np.flatnonzero(np.diff(k, prepend=-1))
        if not len(k):
            return k, k, k, k, k
        x, y = tx[k] * size + at % size, ty[k] * size + at // size
        return k[first], *(f.reduceat(c, first) for f in (np.minimum, np.maximum) for c in (x, y))

    found = _batches(tiles.select("id", "ty", "tx", "v"), edge, _EDGE).groupBy("id").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("c").alias("c"), F.max("d").alias("d"))
    return found.select(
        "id", F.greatest(F.lit(0), F.col("a") - pad).cast("int").alias("x0"), F.greatest(F.lit(0), F.col("b") - pad).cast("int").alias("y0"),
        F.least(F.lit(width), F.col("c") + pad + 1).cast("int").alias("x1"), F.least(F.lit(height), F.col("d") + pad + 1).cast("int").alias("y1"),
    )


def touching(tiles: DataFrame, boxes: DataFrame, size: int = SIZE) -> DataFrame:
    """The tiles that their image's box touches, with the box. Boxes name their tiles, so it is an equi-join on the
    tile, and a table of tiles that is partitioned by ty and tx is pruned. The boxes' side is hashed: a merge join
    would sort whole tiles, which are large and mostly zeros that only a shuffle packs."""
    lines = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size)))
    named = boxes.where("x1 > x0 and y1 > y0").withColumn("ty", lines("y0", "y1")).withColumn("tx", lines("x0", "x1"))
    return tiles.join(named.hint("shuffle_hash"), ["id", "ty", "tx"])


def crop(tiles: DataFrame, boxes: DataFrame, size: int = SIZE) -> DataFrame:
    """What lies in each image's box, as tiles from its corner: a tile hands its parts to the four at most that they
    come to lie in."""
    def parts(ty: pa.Array, tx: pa.Array, v: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> tuple:
        stacked, (ty, tx, x0, y0, x1, y1) = _stacked(v), _numbers(ty, tx, x0, y0, x1, y1)
        k, at = np.nonzero(stacked)
        x, y = tx[k] * size + at % size, ty[k] * size + at // size
        inside = (x >= x0[k]) & (x < x1[k]) & (y >= y0[k]) & (y < y1[k])
        k, at = k[inside], at[inside]
        x, y = x[inside] - x0[k], y[inside] - y0[k]
        # a row's tile comes to lie in two tiles of either axis at most: of which of them each place is
        low_x, low_y = (tx * size - x0) // size, (ty * size - y0) // size
        code = k * 4 + (y // size - low_y[k]) * 2 + x // size - low_x[k]
        order = np.argsort(code, kind="stable")
        dots = np.zeros(len(order), _DOT)
        dots["at"], dots["v"] = (y % size * size + x % size)[order], stacked[k, at][order]
        which, first = np.unique(code[order], return_index=True)
        ends = np.append(first, len(order)).astype(np.int32) * _DOT.itemsize
        listed = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(dots)])
        row = which // 4
        return row, low_y[row] + which // 2 % 2, low_x[row] + which % 2, listed

    def tile(ty: pa.Array, tx: pa.Array, vs: pa.Array) -> tuple:
        out, listed = np.zeros((len(ty), size * size), np.uint8), vs.flatten()
        n = pc.binary_length(listed).to_numpy() // _DOT.itemsize
        dots = np.frombuffer(b"".join(listed.to_pylist()), _DOT)
        row = np.repeat(np.repeat(np.arange(len(ty)), pc.list_value_length(vs).to_numpy()), n)
        out[row, dots["at"]] = dots["v"]  # an image's tiles hold each place once
        return np.arange(len(ty)), ty, tx, _packed(out)

    # of parts only what isn't zero is moved and sorted: a few bytes for most of a sparse mask's tiles
    moved = _batches(touching(tiles, boxes, size).select("id", "ty", "tx", "v", "x0", "y0", "x1", "y1"), parts, _TILE)
    return _batches(moved.groupBy("id", "ty", "tx").agg(F.collect_list("v").alias("vs")), tile, _TILE)


def dilate(tiles: DataFrame, width: int, height: int, by: int, size: int = SIZE) -> DataFrame:
    """Masks grown by `by` pixels (at most a tile) in all eight directions, inside the image: each value is the largest
    of the square around it. A tile hands what grows over its edges to the neighbours there; tiles that had no row come
    to be where a neighbour's pixels reach."""
    if by > size:
        raise ValueError("a halo reaches no farther than the next tile")

    def grown(ty: int, tx: int, v: bytes) -> Iterable[tuple]:
        wide = np.zeros((3 * size, 3 * size), np.uint8)
        wide[size : 2 * size, size : 2 * size] = np.frombuffer(v, np.uint8).reshape(size, size)
        for axis in (0, 1):
            wide = np.max([np.roll(wide, s, axis) for s in range(-by, by + 1)], axis=0)  # by <= size: nothing comes round
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                part = wide[(1 + dy) * size : (2 + dy) * size, (1 + dx) * size : (2 + dx) * size].copy()
                y, x = (ty + dy) * size, (tx + dx) * size
                part[max(0, height - y) :], part[:, max(0, width - x) :] = 0, 0
                if y >= 0 and x >= 0 and part.any():
                    yield ty + dy, tx + dx, part.tobytes()

    return _merged(_each(tiles.select("id", "ty", "tx", "v"), grown, _TILE))  # nine parts at most meet
