import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import png
from rasterloom.operators import raster
from rasterloom.operators.patches import alpha_masks, alpha_png, cut_patch, nearest, patches


def pixels(spark, image, name=1):
    h, w = image.shape
    return spark.createDataFrame([(name, x, y, int(image[y, x])) for y in range(h) for x in range(w)], "id int, x int, y int, v int")


def box(mask, width, height):
    ys, xs = np.nonzero(mask)
    return max(0, xs.min() - 16), max(0, ys.min() - 16), min(width, xs.max() + 17), min(height, ys.max() + 17)


def test_boxes(spark):
    masks = {}
    for i, (x, y) in enumerate([(0, 0), (59, 0), (0, 39), (59, 39), (30, 20)]):
        masks[i] = np.zeros((40, 60), int)
        masks[i][y, x] = 1
    masks[5] = np.ones((40, 60), int)
    masks[6] = np.zeros((40, 60), int)
    rows = pixels(spark, masks[0], 0)
    for i in range(1, 7):
        rows = rows.union(pixels(spark, masks[i], i))
    found = {r["id"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in raster.mask_boxes(rows, 60, 40).collect()}
    assert found == {i: box(masks[i], 60, 40) for i in range(6)}
    every = raster.boxes_or_default(rows.select("id").distinct(), raster.mask_boxes(rows, 60, 40))
    assert {r["id"]: tuple(r)[1:] for r in every.collect()}[6] == (0, 0, 1, 1)


def test_resize_crop_composite(spark):
    image = np.arange(48).reshape(6, 8)
    small = raster.resize_nearest(pixels(spark, image), (8, 6), (5, 9)).collect()
    want = nearest(image, 9, 5)
    assert {(r["x"], r["y"]): r["v"] for r in small} == {(x, y): want[y, x] for y in range(9) for x in range(5)}
    cut = raster.crop(pixels(spark, image), spark.createDataFrame([(1, 2, 1, 5, 4)], "id int, x0 int, y0 int, x1 int, y1 int"))
    assert {(r["x"], r["y"]): r["v"] for r in cut.collect()} == {(x, y): image[y + 1, x + 2] for y in range(3) for x in range(3)}
    blank = raster.blank(spark.createDataFrame([(1,)], "id int"), 8, 6, 200)
    mask = raster.threshold(raster.invert(pixels(spark, image), 47), 0.5, 47).withColumn("v", F.when(F.col("v") > 0, 255).otherwise(0))
    mixed = raster.composite(pixels(spark, image), blank, mask)
    assert {(r["x"], r["y"]): r["v"] for r in mixed.collect()} == {(x, y): 200 if (47 - image[y, x]) / 47 > 0.5 else image[y, x] for y in range(6) for x in range(8)}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.sampled_from([1, 3, 4]), st.integers(0, 9))
def test_png_round_trip(h, w, n, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w) if n == 1 else (h, w, n), dtype=np.uint8)
    back = png.decode(png.encode(image))
    assert (back[..., :n] == image.reshape(h, w, n)).all() if n > 1 else (back[..., 0] == image).all()


def test_png_kinds_and_spark(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(image))
    row = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    assert (np.frombuffer(row["data"], np.uint8).reshape(9, 7, 3)[..., ::-1] == image).all()
    dots = raster.to_pixels(spark.read.format("image").load(str(tmp_path)).withColumn("id", F.lit(1))).collect()
    assert {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in dots} == {(x, y): (*map(int, image[y, x]), 255) for y in range(9) for x in range(7)}
    # grey of one bit, with every kind of row filter
    import struct
    import zlib

    for kind, depth, samples in ((0, 1, 1), (0, 16, 1), (3, 4, 1), (4, 8, 2), (6, 8, 4), (2, 16, 3)):
        width, height = 11, 10
        bytes_ = -(-width * samples * depth // 8)
        raw = rng.integers(0, 256, (height, bytes_), dtype=np.uint8)
        step, above, body = max(1, samples * depth // 8), np.zeros(bytes_, int), b""
        for y in range(height):
            row, f = raw[y].astype(int), y % 5
            left = np.concatenate([np.zeros(step, int), row])[:bytes_]
            corner = np.concatenate([np.zeros(step, int), above])[:bytes_]
            p = left + above - corner
            paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
            guess = [0, left, above, (left + above) // 2, paeth][f]
            body += bytes([f]) + ((row - guess) % 256).astype(np.uint8).tobytes()
            above = row
        head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)
        palette = rng.integers(0, 256, (16, 3), dtype=np.uint8)
        data = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"PLTE", palette.tobytes()) * (kind == 3) + png._chunk(b"IDAT", zlib.compress(body)) + png._chunk(b"IEND", b"")
        got = png.decode(data)
        if kind == 3:
            bits = np.unpackbits(raw, axis=1)[:, : width * 4].reshape(height, width, 4) @ [8, 4, 2, 1]
            assert (got[..., :3] == palette[bits]).all()
        elif depth == 1:
            assert (got[..., 0] == np.unpackbits(raw, axis=1)[:, :width] * 255).all()
        else:
            v = raw.reshape(height, width, samples, depth // 8)[..., 0]
            assert (got[..., 0] == v[..., 0]).all() and (samples in (1, 3) or (got[..., 3] == v[..., -1]).all())
    for broken in (b"", b"GIF89a", png.encode(image)[:40]):
        with pytest.raises(ValueError):
            png.decode(broken)


def test_patches(spark):
    rng = np.random.default_rng(1)
    image, mask = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8), np.zeros((40, 60), np.uint8)
    mask[10:21, 30:36] = 1
    empty, half = np.zeros((40, 60), np.uint8), np.zeros((20, 30), np.uint8)
    half[5, 15] = 9
    rows = [(0, png.encode(image), png.encode(mask)), (1, png.encode(image), png.encode(empty)), (2, png.encode(image), png.encode(half)), (3, b"x", png.encode(mask)), (4, png.encode(image), None)]
    df = spark.createDataFrame([(i, bytearray(a), bytearray(b) if b else None) for i, a, b in rows], "i int, image binary, mask binary")
    got = [r["p"] for r in df.select("i", patches(F.col("image"), F.col("mask")).alias("p")).orderBy("i").collect()]
    import base64

    assert (got[0]["x"], got[0]["y"], got[0]["width"], got[0]["height"]) == (14, 0, 38, 37)
    assert (png.decode(base64.b64decode(got[0]["color"]))[..., :3] == image[0:37, 14:52]).all()
    assert (png.grey(png.decode(base64.b64decode(got[0]["mask"]))) == mask[0:37, 14:52]).all()
    assert (got[1]["x"], got[1]["y"], got[1]["width"], got[1]["height"]) == (0, 0, 1, 1) and got[1]["color"] == got[1]["mask"]
    big = nearest(half, 40, 60)
    x0, y0, x1, y1 = box(big, 60, 40)
    assert (got[2]["x"], got[2]["y"], got[2]["width"], got[2]["height"]) == (x0, y0, x1 - x0, y1 - y0)
    assert got[3]["error"] and got[4]["error"] == "no mask"
    sent = df.select("i", alpha_masks(F.col("mask")).alias("s")).orderBy("i").collect()
    assert (png.decode(bytes(sent[0]["s"]["content"])) == np.dstack([np.zeros((40, 60, 3), np.uint8), mask])).all()
    assert sent[4]["s"]["error"] == "no mask" and alpha_png(png.encode(mask)) == bytes(sent[0]["s"]["content"])
    assert cut_patch(png.encode(image), png.encode(mask))["width"] == 38


def test_repeated_bytes_are_drawn_once(monkeypatch):
    """Of rows of one batch with the same bytes, each mask is drawn and each patch cut once."""
    from rasterloom.operators import patches as module

    drawn, cut = [], []
    monkeypatch.setattr(module, "alpha_png", lambda m: drawn.append(m) or b"png" + m)
    monkeypatch.setattr(module, "cut_patch", lambda i, m, pad: cut.append((i, m)) or dict.fromkeys(["x", "y", "width", "height"], len(cut)) | {"color": "c", "mask": "m"})
    made = {}
    monkeypatch.setattr(module, "pandas_udf", lambda kind: lambda run: made.setdefault(kind, run) and (lambda *columns: None))
    alpha_masks(None), patches(None, None)
    alpha, patch = made.values()
    masks = pd.Series([b"a", None, b"b", b"a", None, b"a"])
    assert alpha(masks)["content"].tolist() == [b"pnga", None, b"pngb", b"pnga", None, b"pnga"] and drawn == [b"a", b"b"]
    found = patch(pd.Series([b"i", b"i", None, b"j", b"i", b"i"]), masks)
    assert cut == [(b"i", b"a"), (b"j", b"a")] and found["x"].fillna(0).tolist() == [1, 0, 0, 2, 0, 1] and found["error"].tolist() == [None, "no mask", "no image", None, "no mask", None]
