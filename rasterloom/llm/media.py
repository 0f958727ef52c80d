"""Media columns: Netpbm and BMP images, area resizing by integral images, NPY tiles and difference hashes.

Any bytes can travel as a grey image: padded to whole tiles of 24 x 24 samples they become a binary PGM, which is
decoded to an array, kept as an NPY tile, read back and hashed by what it looks like.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
TILE = SIDE * SIDE
FILL = b"\xff"
#: White space and comments between the fields of a Netpbm header.
_FIELD = re.compile(rb"(?:[ \t\r\n]|#[^\n]*\n)+(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to uint8 or uint16 of shape (height, width) or (height, width, 3); bitmaps become 0 and 255."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _FIELD.match(data, at)):
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if not n or not 0 < top < 1 << 16 or n > 16 * len(data):
        raise ValueError("a Netpbm image of no such size or depth")
    if kind in (b"P2", b"P3"):
        out = np.array([int(x) for x in re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n]])
    elif kind == b"P1":
        out = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n], np.uint8) != ord("1")
    elif kind == b"P4":
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)
        out = bits[:, :width] == 0
    else:
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if out.size != n:
        raise ValueError("too few samples")
    if out.dtype != bool and not 0 <= int(out.min()) <= int(out.max()) <= top:
        raise ValueError("a sample outside the image's range")
    if out.dtype == bool:
        out = out * np.uint8(255)
    else:
        out = out.astype(np.uint8 if top <= 255 else np.uint16, copy=False)
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits to uint8 (height, width, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (8, 24, 32) or packed not in (0, 3) or (packed == 3 and bits != 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}, is not read")
    if width <= 0 or not height:
        raise ValueError("a BMP image without pixels")
    row = (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8]
    raw = raw[::-1] if height > 0 else raw
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)
        return colours[raw][:, :, 2::-1]
    return raw.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """uint8 (height, width, 3) to a BMP of 24 bits, bottom row first."""
    height, width = pixels.shape[:2]
    row = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 0, 0, 0, 0) + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def to_grey(image: np.ndarray) -> np.ndarray:
    """Luma by integer weights out of 256, for images with three channels."""
    if image.ndim == 2:
        return image
    return ((image.astype(np.uint32) @ np.array([77, 150, 29], np.uint32) + 128) >> 8).astype(image.dtype)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the area of each target sample, parts of source samples included, from an integral image."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])

    def at(edges: np.ndarray, axis: int, x: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(int), x.shape[axis] - 2)
        part = (edges - low)[:, None] if axis == 0 else edges - low
        return np.take(x, low, axis) * (1 - part) + np.take(x, low + 1, axis) * part

    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    corner = at(xs, 1, at(ys, 0, total))
    return np.diff(np.diff(corner, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 x 9 area means is under its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def media_tiles(images: DataFrame, id_col: str = "id", media_col: str = "media", height: int = SIDE, width: int = SIDE) -> DataFrame:
    """A row for each row of images (binary Netpbm or BMP): the id, source height and width, the grey NPY tile of the
    asked size, its difference hash, and error: null, or why the bytes can't be decoded (then the rest is null), as null
    and empty ones can't. Rows with equal or null ids are kept; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                try:
                    grey = to_grey(decode(x or b""))
                    out.append((*grey.shape, to_npy(np.round(area_resize(grey, height, width)).astype(grey.dtype)), difference_hash(grey), None))
                except (ValueError, ArithmeticError, struct.error, IndexError) as e:
                    out.append((None, None, None, None, str(e)))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "height", "width", "tile", "dhash", "error"])

    rows = images.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, "id string, height int, width int, tile binary, dhash string, error string").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """A row for each row of docs: its text's bytes stored as 8-bit samples, read back, and described.

    The bytes, filled up with 255 to a positive multiple of 576, become the rows of a PGM of 24 samples a row; that
    is decoded, stored as an NPY tile and read back. payload_* describe what was read back, media_* the stored tile;
    feature is the difference hash; full adds media (binary). A null text counts as empty. Rows with equal or null
    ids are kept; equal texts have equal values; other columns are not carried. Whole texts count, however long; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 8 if full else 7]
        for batch in batches:
            out = []
            for x in batch.column(1):
                data = x.as_py() or b""
                payload = np.frombuffer(data + FILL * (-len(data) % TILE or TILE * (not data)), np.uint8)
                media = to_npy(decode_netpbm(encode_pgm(payload.reshape(-1, SIDE))))
                image = from_npy(media)
                back = image.tobytes()
                row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image))
                out.append((*row, media) if full else row)
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["id", *names])

    kept = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if full else "")
    names = [x.split()[0] for x in kept.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id long, {kept}").withColumnRenamed("id", id_col)
