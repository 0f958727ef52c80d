"""Rasters as relations of pixels: columns id, x, y and a value v, or r, g, b and a.

Everything is an expression, a grouped aggregate or an equi-join on the image's id, so images spread over tasks by
pixel and large ones need no task of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD = 16


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey value by the 16-bit fixed-point weights of ITU-R 601."""
    return F.floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536).cast("int")


def inverted_alpha(v: Column) -> Column:
    """What a loader makes of alpha v: 1 - v / 255, in hundredths."""
    return (F.lit(255) - v) * F.lit(100).cast("double") / 255


def above(pixels: DataFrame, least: int = 0) -> DataFrame:
    return pixels.where(F.col("v") > least)


def alpha_mask(pixels: DataFrame) -> DataFrame:
    """Grey values as the alpha of black pixels."""
    zero = F.lit(0)
    return pixels.select("id", "x", "y", zero.alias("r"), zero.alias("g"), zero.alias("b"), F.col("v").alias("a"))


def mask_boxes(pixels: DataFrame, width: Column | int, height: Column | int, pad: int = PAD, least: int = 0) -> DataFrame:
    """(id, x0, y0, x1, y1): the box of the pixels above `least`, padded and clamped to the image; the ends are exclusive.

    Masks without such a pixel have no row; see `boxes_or_default`."""
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    found = above(pixels, least).groupBy("id").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - pad)
    return found.select(
        "id", low("a").cast("int").alias("x0"), low("b").cast("int").alias("y0"),
        F.least(w, F.col("c") + pad + 1).cast("int").alias("x1"), F.least(h, F.col("d") + pad + 1).cast("int").alias("y1"),
    )


def boxes_or_default(ids: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, x, y, width, height) for every id; an empty mask stands for one pixel at the origin."""
    part = lambda a, default, name: F.coalesce(a, F.lit(default)).cast("int").alias(name)
    return ids.join(boxes, "id", "left").select(
        "id", part(F.col("x0"), 0, "x"), part(F.col("y0"), 0, "y"), part(F.col("x1") - F.col("x0"), 1, "width"), part(F.col("y1") - F.col("y0"), 1, "height")
    )


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels inside their image's box, moved to its origin."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    moved = pixels.join(boxes, "id").where(inside)
    return moved.withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).drop("x0", "y0", "x1", "y1")


def nearest_source(target: Column, source_size: int, target_size: int) -> Column:
    """Which source row or column nearest-neighbour resizing takes for a target one: the one under its centre."""
    return F.least(F.lit(source_size - 1), F.floor((target + 0.5) * source_size / target_size)).cast("int")


def resize_nearest(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Pixels (id, x, y, v) of images of one size, resized; target pixels whose source pixel is missing are missing."""
    spark = pixels.sparkSession
    for axis, s, t in zip("xy", source, target, strict=True):
        grid = spark.range(t).select(F.col("id").cast("int").alias("to"), nearest_source(F.col("id"), s, t).alias(axis))
        pixels = pixels.join(grid, axis).drop(axis).withColumnRenamed("to", axis)
    return pixels.select("id", "x", "y", "v")


def blank(ids: DataFrame, width: int, height: int, value: int = 0) -> DataFrame:
    """Every pixel of a constant image for each id."""
    cells = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return cells.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"), F.lit(value).alias("v"))


def invert(pixels: DataFrame, top: int = 255) -> DataFrame:
    return pixels.withColumn("v", F.lit(top) - F.col("v"))


def threshold(pixels: DataFrame, share: float = 0.5, top: int = 255) -> DataFrame:
    """0 or `top`, by whether the value is over a share of it."""
    return pixels.withColumn("v", F.when(F.col("v") / top > share, top).otherwise(0))


def composite(destination: DataFrame, source: DataFrame, mask: DataFrame, top: int = 255) -> DataFrame:
    """mask * source + (1 - mask) * destination, where all three have a pixel; elsewhere the destination."""
    at = ["id", "x", "y"]
    joined = destination.join(source.withColumnRenamed("v", "s"), at, "left").join(mask.withColumnRenamed("v", "m"), at, "left")
    m = F.col("m") / top
    return joined.select(*at, F.coalesce(F.round(m * F.col("s") + (1 - m) * F.col("v")), F.col("v")).cast("int").alias("v"))


def to_pixels(images: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of Spark's image source (struct `image`, bytes in BGR order) as pixels (id, x, y, r, g, b, a)."""
    n, w = F.col("image.nChannels"), F.col("image.width")
    at = F.explode(F.sequence(F.lit(0), F.col("image.width") * F.col("image.height") - 1))
    one = lambda k: F.conv(F.hex(F.substring(F.col("image.data"), F.col("i") * n + k + 1, F.lit(1))), 16, 10).cast("int")
    cells = images.where("image.width > 0").select(F.col(id_col).alias("id"), "image", at.alias("i"))
    grey = n == 1
    return cells.select(
        "id", (F.col("i") % w).alias("x"), F.floor(F.col("i") / w).cast("int").alias("y"),
        F.when(grey, one(F.lit(0))).otherwise(one(F.lit(2))).alias("r"), F.when(grey, one(F.lit(0))).otherwise(one(F.lit(1))).alias("g"), one(F.lit(0)).alias("b"),
        F.when(n == 4, one(F.lit(3))).otherwise(255).alias("a"),
    )


def context_boxes(boxes: DataFrame, factor: float, target: tuple[int, int], width: int, height: int) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1) with context: grown by the factor about their middle, then in one direction to the
    target's aspect, and moved inside the image. Where the image is too small for the aspect, the box ends with it."""
    def grown(low: str, high: str, size: int) -> tuple[Column, Column]:
        more = F.floor((F.col(high) - F.col(low)) * (factor - 1) / 2)
        return F.greatest(F.lit(0), F.col(low) - more), F.least(F.lit(size), F.col(high) + more)

    def widened(low: Column, high: Column, need: Column, size: int) -> tuple[Column, Column]:
        need = F.least(F.lit(size), F.greatest(high - low, need))
        start = F.greatest(F.lit(0), F.least(low - F.floor((need - (high - low)) / 2), size - need))
        return start, start + need

    (x0, x1), (y0, y1) = grown("x0", "x1", width), grown("y0", "y1", height)

    def box(g: Column) -> Column:
        w, h = g["x1"] - g["x0"], g["y1"] - g["y0"]
        a, b = widened(g["x0"], g["x1"], F.ceil(h * target[0] / target[1]), width)
        c, d = widened(g["y0"], g["y1"], F.ceil(w * target[1] / target[0]), height)
        return F.struct(*[v.cast("int").alias(n) for v, n in ((a, "x0"), (c, "y0"), (b, "x1"), (d, "y1"))])

    # as a function of one element: filters on a box aren't spelt out over all that it is made of
    grown_box = F.array(F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
    return boxes.select("id", F.explode(F.transform(grown_box, box)).alias("b")).select("id", "b.x0", "b.y0", "b.x1", "b.y1")


def resize_area(pixels: DataFrame, target: tuple[int, int]) -> DataFrame:
    """Pixels (id, x, y, v, width, height: the image's size) by area: (id, x, y, total, v) of the target's pixels that
    any of the image's touch. total is the sum of values times shares of width * height parts; v is the mean, rounded.
    Pixels that are missing count as zero.

    A source pixel meets one target column or two, or several in a row where the image grows, and rows alike; both
    are projections, and one sum in whole numbers follows, so a task holds the target's pixels in one aggregate."""
    def shared(at: str, size: str, to: int) -> Column:
        i, n = F.col(at), F.col(size)
        columns = F.sequence(F.floor(i * to / n), F.floor(((i + 1) * to - 1) / n))
        return F.explode(F.transform(columns, lambda t: F.struct(t.alias("t"), (F.least((t + 1) * n, (i + 1) * to) - F.greatest(t * n, i * to)).alias("share"))))

    across = pixels.select("id", "y", "width", "height", "v", shared("x", "width", target[0]).alias("a"))
    both = across.select("id", "width", "height", F.col("a.t").alias("x"), (F.col("v") * F.col("a.share")).alias("v"), shared("y", "height", target[1]).alias("b"))
    found = both.groupBy("id", "width", "height", "x", F.col("b.t").alias("y")).agg(F.sum(F.col("v") * F.col("b.share")).alias("total"))
    area = F.col("width") * F.col("height")
    return found.select("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "total", F.floor((2 * F.col("total") + area) / (2 * area)).cast("int").alias("v"))


def edge_distances(mask: DataFrame, most: int) -> DataFrame:
    """(id, x, y, square) of a mask's pixels (id, x, y): the squared distance to the nearest place that isn't one,
    most * most at most; places outside of the image aren't.

    Two passes: runs of pixels in a row give the distance within it, and from there a column's pixels pass on what is
    near enough to matter, at most 2 * most - 1 rows each."""
    def run(along: str, across: str) -> tuple[Column, Column]:
        order = Window.partitionBy("id", across).orderBy(along)
        number = F.col(along) - F.row_number().over(order)
        return number, order

    on = mask.select("id", "x", "y").distinct()
    in_row = on.withColumn("r", run("x", "y")[0])
    whole = Window.partitionBy("id", "y", "r")
    near = F.least(F.col("x") - F.min("x").over(whole), F.max("x").over(whole) - F.col("x")) + 1
    flat = in_row.select("id", "x", "y", F.least(near, F.lit(most)).alias("g")).withColumn("r", run("y", "x")[0])
    whole = Window.partitionBy("id", "x", "r")
    low, high = F.min("y").over(whole), F.max("y").over(whole)
    # beyond the end of its run in the column a pixel has nothing to pass on
    placed = flat.select("id", "x", "y", "g", low.alias("low"), high.alias("high"), (F.least(F.col("y") - low, high - F.col("y")) + 1).alias("v"))
    reach = F.sequence(F.greatest(F.col("low"), F.col("y") - most + 1), F.least(F.col("high"), F.col("y") + most - 1))
    passed = F.transform(reach, lambda y: F.struct(y.alias("y"), (F.col("g") * F.col("g") + (y - F.col("y")) * (y - F.col("y"))).alias("square")))
    useful = F.filter(passed, lambda p: (p["square"] < most * most) | (p["y"] == F.col("y")))
    ends = F.least(F.col("v"), F.lit(most))
    rows = placed.select("id", "x", F.explode(F.concat(useful, F.array(F.struct(F.col("y").alias("y"), (ends * ends).alias("square"))))).alias("p"))
    return rows.groupBy("id", "x", F.col("p.y").alias("y")).agg(F.min("p.square").cast("int").alias("square"))


def stitch(image: DataFrame, patch: DataFrame, offsets: DataFrame, mask: DataFrame, blend: int) -> DataFrame:
    """The image (id, x, y, v) with a patch (id, x, y, v, from its own origin) placed at its offset (id, x0, y0) where
    the mask (id, x, y) is; towards the mask's edge, over `blend` pixels, it fades into the image."""
    moved = patch.join(offsets.select("id", "x0", "y0"), "id").select("id", (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), F.col("v").alias("new"))
    at = ["id", "x", "y"]
    joined = image.join(moved, at, "left").join(edge_distances(mask, blend), at, "left")
    share = F.when(F.col("square").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.sqrt("square") / blend))
    mixed = F.floor(share * F.col("new") + (1 - share) * F.col("v") + 0.5).cast("int")
    return joined.select(*at, F.coalesce(mixed, F.col("v").cast("int")).alias("v"))
