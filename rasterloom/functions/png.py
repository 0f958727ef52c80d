"""PNG to numpy arrays and back, by zlib."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the seven passes of an interlaced image.
INTERLACED = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(image: np.ndarray) -> bytes:
    """uint8 of (height, width) as grey, or (height, width, 3 or 4) as RGB or RGBA."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    rows = np.zeros((height, 1 + image.size // max(1, height)), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    header = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(raw: bytes, height: int, width_bytes: int, step: int) -> np.ndarray:
    """Rows without their filters. A byte depends on those to the left, above and above left of it, so all places whose
    row and column add up to the same number are worked out together."""
    data = np.frombuffer(raw, np.uint8, height * (width_bytes + 1)).reshape(height, width_bytes + 1)
    kinds, n = data[:, 0], -(-width_bytes // step)
    if kinds.max(initial=0) > 4:
        raise ValueError(f"PNG filter {kinds.max()} is not known")
    rows = np.zeros((height, n * step), np.uint8)
    rows[:, :width_bytes] = data[:, 1:]
    out = np.zeros((height + 1, n + 1, step), np.int16)  # zeros stand above and to the left
    if not kinds.any():
        return rows[:, :width_bytes]
    rows = rows.reshape(height, n, step)
    for total in range(height + n - 1):
        y = np.arange(max(0, total - n + 1), min(height - 1, total) + 1)
        x, kind = total - y, kinds[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        to_left, to_up, to_corner = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[y + 1, x + 1] = rows[y, x] + np.choose(kind, [0, left, up, (left + up) // 2, nearest]) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)[:, :width_bytes]


def _samples(rows: np.ndarray, height: int, width: int, n: int, depth: int, palette: bool) -> tuple[np.ndarray, np.ndarray]:
    """Samples as they stand, and as bytes."""
    if depth == 16:
        wide = rows.reshape(height, width, n, 2)
        return wide.astype(np.uint16) @ np.array([256, 1], np.uint16), wide[..., 0]
    if depth == 8:
        v = rows.reshape(height, width, n)
        return v, v
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
    keys = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
    return keys, keys if palette else (keys.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """RGBA, uint8 of (height, width, 4), of any PNG; of 16-bit samples, the upper byte."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, palette, clear = 8, [], None, None
    width = height = depth = kind = interlaced = 0
    while at + 8 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if name == b"IHDR":
            if n != 13:
                raise ValueError("broken PNG header")
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if interlaced > 1 or kind not in SAMPLES or depth not in (1, 2, 4, 8, 16):
                raise ValueError("unknown kind of PNG")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"broken PNG: {e}") from e
    n = SAMPLES[kind]
    passes = [p for p in INTERLACED if p[0] < width and p[1] < height] if interlaced else [(0, 0, 1, 1)]
    if not width or not height or len(raw) > 1 << 31:
        raise ValueError("broken PNG: no pixels, or too many")
    keys = v = None
    at = 0
    for x0, y0, dx, dy in passes:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        width_bytes = -(-w * n * depth // 8)
        part = raw[at : at + h * (width_bytes + 1)]
        if len(part) < h * (width_bytes + 1):
            raise ValueError("broken PNG: too few bytes")
        at += len(part)
        some_keys, some = _samples(_unfilter(part, h, width_bytes, max(1, n * depth // 8)), h, w, n, depth, kind == 3)
        if keys is None:
            keys, v = (np.zeros((height, width, n), x.dtype) for x in (some_keys, some))
        keys[y0::dy, x0::dx], v[y0::dy, x0::dx] = some_keys, some
    out = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        if palette is None or int(keys.max(initial=0)) >= len(palette):
            raise ValueError("broken PNG: no such colour")
        out[..., :3] = palette[keys[..., 0]]
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            out[..., 3] = alpha[keys[..., 0]]
        return out
    out[..., :3] = v[..., :1] if n < 3 else v[..., :3]
    if n in (2, 4):
        out[..., 3] = v[..., -1]
    elif clear is not None:
        out[..., 3] = np.where((keys == np.frombuffer(clear, ">u2")[:n]).all(axis=2), 0, 255)
    return out


def grey(rgba: np.ndarray) -> np.ndarray:
    """Luma by 16-bit fixed-point weights of ITU-R 601; alpha doesn't count."""
    r, g, b = (rgba[..., k].astype(np.uint32) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)
