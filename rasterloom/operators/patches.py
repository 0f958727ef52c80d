"""Image patches: masks for the backend, and what a mask covers of an image, as Arrow-batched functions of bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rasterloom.functions import png
from rasterloom.schemas import PATCH

PAD = 16


def alpha_png(mask: bytes) -> bytes:
    """A black image of the mask's size whose alpha is the mask's grey value."""
    v = png.grey(png.decode(mask))
    out = np.zeros((*v.shape, 4), np.uint8)
    out[..., 3] = v
    return png.encode(out)


def nearest(v: np.ndarray, height: int, width: int) -> np.ndarray:
    pick = lambda n, m: np.minimum(m - 1, np.floor((np.arange(n) + 0.5) * m / n).astype(int))
    return v[np.ix_(pick(height, v.shape[0]), pick(width, v.shape[1]))]


def cut_patch(image: bytes, mask: bytes, pad: int = PAD) -> dict:
    """The patch of an image under the padded box of its mask, with both cut out; one clear pixel for an empty mask.
    A mask of another size is resized to the image's."""
    rgba, v = png.decode(image), png.grey(png.decode(mask))
    height, width = rgba.shape[:2]
    if v.shape != (height, width):
        v = nearest(v, height, width)
    ys, xs = np.flatnonzero(v.any(axis=1)), np.flatnonzero(v.any(axis=0))
    if len(ys):
        box = slice(max(0, int(ys[0]) - pad), min(height, int(ys[-1]) + pad + 1)), slice(max(0, int(xs[0]) - pad), min(width, int(xs[-1]) + pad + 1))
        colour, cut = rgba[box], v[box]
        x, y = box[1].start, box[0].start
    else:
        colour = cut = np.zeros((1, 1, 4), np.uint8)
        x = y = 0
    one = lambda a: base64.b64encode(png.encode(a)).decode()
    return {"x": x, "y": y, "width": colour.shape[1], "height": colour.shape[0], "color": one(colour), "mask": one(cut)}


def alpha_masks(mask: Column) -> Column:
    """Struct (content, error) of a binary mask column: `alpha_png`, or why it can't be made. Of masks that occur several
    times in a batch each is drawn once."""

    @pandas_udf("content binary, error string")
    def run(masks: pd.Series) -> pd.DataFrame:
        out, made = [], {}
        for m in masks:
            if m not in made:
                try:
                    made[m] = (alpha_png(bytes(m)) if m is not None else None, None if m is not None else "no mask")
                except ValueError as e:
                    made[m] = (None, str(e))
            out.append(made[m])
        return pd.DataFrame(out, columns=["content", "error"])

    return run(mask)


def patches(image: Column, mask: Column, pad: int = PAD) -> Column:
    """Struct of a patch and error (null, or why there is none) of binary columns. Of images and masks that occur
    together several times in a batch each patch is cut once."""

    @pandas_udf(f"{PATCH}, error string")
    def run(images: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out, made = [], {}
        for pair in zip(images, masks, strict=True):
            if pair not in made:
                i, m = pair
                try:
                    if i is None or m is None:
                        raise ValueError("no image" if i is None else "no mask")
                    made[pair] = cut_patch(bytes(i), bytes(m), pad) | {"error": None}
                except ValueError as e:
                    made[pair] = dict.fromkeys(["x", "y", "width", "height", "color", "mask"]) | {"error": str(e)}
            out.append(made[pair])
        frame = pd.DataFrame(out, columns=["x", "y", "width", "height", "color", "mask", "error"])
        return frame.astype(dict.fromkeys(["x", "y", "width", "height"], "Int32"))

    return run(image, mask)


def to_images(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(id, content): grey PNG images of pixels (id, x, y, v), 0 where there is none and the largest where there are
    several. An image's pixels meet in one row, of width * height numbers at most."""

    @pandas_udf("binary")
    def draw(places: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for at, v in zip(places, values, strict=True):
            image = np.zeros(width * height, np.uint8)
            image[at] = v
            out.append(png.encode(image.reshape(height, width)))
        return pd.Series(out)

    inside = pixels.where(f"x between 0 and {width - 1} and y between 0 and {height - 1}")
    single = inside.groupBy("id", (F.col("y") * width + F.col("x")).cast("long").alias("at")).agg(F.max("v").cast("int").alias("v"))
    listed = single.groupBy("id").agg(F.collect_list(F.struct("at", "v")).alias("p"))
    return listed.select("id", draw(F.col("p.at"), F.col("p.v")).alias("content"))


def image_pixels(images: DataFrame, content: str = "content") -> DataFrame:
    """Pixels (id, x, y, r, g, b, a) of images (id, PNG bytes); bytes that can't be decoded have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(1)):
                try:
                    rgba = png.decode(data.as_py() or b"")
                except ValueError:
                    continue
                y, x = np.divmod(np.arange(rgba.shape[0] * rgba.shape[1]), rgba.shape[1])
                ids = batch.column(0).take(pa.array(np.full(len(x), k)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int32()) for c in (x, y, *rgba.reshape(-1, 4).T))], ["id", "x", "y", "r", "g", "b", "a"])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", content).mapInArrow(run, f"id {kind}, x int, y int, r int, g int, b int, a int")
