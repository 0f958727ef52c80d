"""Context, area resampling, stitching and tiles against plain loops on small odd rasters."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.operators import raster, tiles

WIDTH, HEIGHT = 50, 37


def dots(spark, seed=1, n=400):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(WIDTH), rnd.randrange(HEIGHT), rnd.randrange(1, 256)) for i in (1, 2) for _ in range(n)]
    kept = {}
    for i, x, y, v in rows:
        kept[i, x, y] = max(v, kept.get((i, x, y), 0))
    return spark.createDataFrame([*rows, (3, 49, 36, 9)], "id int, x int, y int, v int"), kept | {(3, 49, 36): 9}


def test_tiles_are_the_pixels(spark):
    pixels, kept = dots(spark)
    made = tiles.to_tiles(pixels, 16)
    assert {(r["id"], r["x"], r["y"]): r["v"] for r in tiles.to_pixels(made, 16).collect()} == kept
    assert all(len(r["v"]) == 256 for r in made.collect())
    want = {r["id"]: tuple(r)[1:] for r in raster.mask_boxes(pixels, WIDTH, HEIGHT, 5, 100).collect()}
    assert {r["id"]: tuple(r)[1:] for r in tiles.tile_boxes(made, WIDTH, HEIGHT, 5, 100, 16).collect()} == want and 3 not in want
    assert tiles.to_tiles(pixels.limit(0), 16).collect() == []


def test_tiles_of_a_batch_are_one_array():
    """Many tiles at once, without a Python object for each: slices of Arrow columns are views of the same bytes."""
    v = np.arange(7 * 9, dtype=np.uint8).reshape(7, 9)
    packed = tiles._packed(v)
    assert packed.to_pylist() == [row.tobytes() for row in v]
    for a, b in ((0, 7), (2, 5), (6, 7), (3, 3)):
        some = tiles._stacked(packed.slice(a, b - a))
        assert len(some) == b - a and (not len(some) or ((some == v[a:b]).all() and not some.flags.owndata))
    lists = pa.ListArray.from_arrays(pa.array([0, 2, 3, 7], pa.int32()), packed)
    assert (tiles._stacked(lists.slice(1).flatten()) == v[2:]).all()


@pytest.mark.parametrize("box", [(0, 0, 50, 37), (3, 5, 4, 6), (15, 16, 33, 37), (7, 1, 40, 30)])
def test_crop(spark, box):
    pixels, kept = dots(spark)
    boxes = spark.createDataFrame([(1, *box), (2, 10, 10, 10, 20)], "id int, x0 int, y0 int, x1 int, y1 int")
    found = {(r["id"], r["x"], r["y"]): r["v"] for r in tiles.to_pixels(tiles.crop(tiles.to_tiles(pixels, 16), boxes, 16), 16).collect()}
    x0, y0, x1, y1 = box
    assert found == {(1, x - x0, y - y0): v for (i, x, y), v in kept.items() if i == 1 and x0 <= x < x1 and y0 <= y < y1}
    plan = tiles.touching(tiles.to_tiles(pixels, 16), boxes, 16)
    assert plan.where("id = 1").count() == len({(y // 16, x // 16) for (i, x, y) in kept if i == 1 and x0 // 16 <= x // 16 <= (x1 - 1) // 16 and y0 // 16 <= y // 16 <= (y1 - 1) // 16})


@pytest.mark.parametrize("by", [0, 1, 5, 16])
def test_dilation_crosses_tiles(spark, by):
    pixels, kept = dots(spark, n=6)
    found = {(r["id"], r["x"], r["y"]): r["v"] for r in tiles.to_pixels(tiles.dilate(tiles.to_tiles(pixels, 16), WIDTH, HEIGHT, by, 16), 16).collect()}
    want = {}
    for (i, x, y), v in kept.items():
        for a in range(max(0, x - by), min(WIDTH, x + by + 1)):
            for b in range(max(0, y - by), min(HEIGHT, y + by + 1)):
                want[i, a, b] = max(v, want.get((i, a, b), 0))
    assert found == want
    with pytest.raises(ValueError):
        tiles.dilate(tiles.to_tiles(pixels, 16), WIDTH, HEIGHT, 17, 16)


@pytest.mark.parametrize("most", [1, 3, 12])
def test_distances(spark, most):
    rnd = random.Random(3)
    on = {(x, y) for x in range(20) for y in range(15) if rnd.random() < 0.9}
    found = {(r["x"], r["y"]): r["square"] for r in raster.edge_distances(spark.createDataFrame([(1, *p) for p in on], "id int, x int, y int"), most).collect()}
    near = lambda x, y: min((a - x) ** 2 + (b - y) ** 2 for a in range(-1, 21) for b in range(-1, 16) if (a, b) not in on)
    assert found == {p: min(most * most, near(*p)) for p in on}


def test_stitch_fades(spark):
    image = raster.blank(spark.createDataFrame([(1,), (2,)], "id int"), 20, 12, 100)
    patch = spark.createDataFrame([(1, x, y, 200) for x in range(10) for y in range(8)], "id int, x int, y int, v int")
    mask = spark.createDataFrame([(1, x, y) for x in range(5, 14) for y in range(3, 10)], "id int, x int, y int")
    offsets = spark.createDataFrame([(1, 4, 2)], "id int, x0 int, y0 int")
    found = {(r["id"], r["x"], r["y"]): r["v"] for r in raster.stitch(image, patch, offsets, mask, 3).collect()}
    assert len(found) == 480 and all(found[2, x, y] == 100 for x in range(20) for y in range(12))
    for x in range(20):
        for y in range(12):
            inside = 5 <= x < 14 and 3 <= y < 10
            d = min(x - 4, 14 - x, y - 2, 10 - y)
            assert found[1, x, y] == (math.floor(min(1, d / 3) * 200 + (1 - min(1, d / 3)) * 100 + 0.5) if inside and x < 14 and y < 10 else 100)


@pytest.mark.parametrize("target", [(4, 3), (7, 9), (1, 1), (60, 45), (10, 10)])
def test_area(spark, target):
    pixels, kept = dots(spark)
    sized = pixels.groupBy("id", "x", "y").agg({"v": "max"}).toDF("id", "x", "y", "v").selectExpr("*", f"{WIDTH} AS width", f"{HEIGHT} AS height")
    found = {(r["id"], r["x"], r["y"]): (r["total"], r["v"]) for r in raster.resize_area(sized, target).collect()}
    want = {}
    for (i, x, y), v in kept.items():
        for a in range(target[0]):
            for b in range(target[1]):
                across = min((a + 1) * WIDTH, (x + 1) * target[0]) - max(a * WIDTH, x * target[0])
                down = min((b + 1) * HEIGHT, (y + 1) * target[1]) - max(b * HEIGHT, y * target[1])
                if across > 0 and down > 0:
                    want[i, a, b] = want.get((i, a, b), 0) + v * across * down
    area = WIDTH * HEIGHT
    assert found == {k: (t, (2 * t + area) // (2 * area)) for k, t in want.items()}


def test_area_is_one_aggregate(spark):
    """A task holds one map of target pixels, on either side of the only shuffle."""
    pixels, _ = dots(spark)
    plan = raster.resize_area(pixels.selectExpr("*", f"{WIDTH} AS width", f"{HEIGHT} AS height"), (4, 3))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2


def test_boxes_are_hashed(spark):
    """Whole tiles aren't sorted to meet their boxes."""
    pixels, _ = dots(spark)
    boxes = spark.createDataFrame([(1, 3, 5, 40, 30)], "id int, x0 int, y0 int, x1 int, y1 int")
    plan = tiles.touching(tiles.to_tiles(pixels, 16), boxes, 16)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_context(spark):
    boxes = spark.createDataFrame([(1, 10, 10, 20, 14), (2, 0, 0, 4, 30), (3, 90, 90, 100, 100), (4, 0, 0, 100, 5)], "id int, x0 int, y0 int, x1 int, y1 int")
    found = {r["id"]: tuple(r)[1:] for r in raster.context_boxes(boxes, 1.5, (1, 1), 100, 100).collect()}
    assert found == {1: (8, 5, 22, 19), 2: (0, 0, 37, 37), 3: (88, 88, 100, 100), 4: (0, 0, 100, 100)}
