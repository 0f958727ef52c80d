"""Hashed counts of byte n-grams of whole texts."""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once, so that a long text needs no more memory than a short one.
STRIDE = 1 << 18
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def ngram_counts(text: bytes, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of n-grams of these orders in 2**bits buckets; blanks stand around the text."""
    out = np.zeros(1 << bits, np.int64)
    data = b" " + text + b" "
    for at in range(0, len(data), STRIDE):
        raw = np.frombuffer(data, np.uint8, min(STRIDE + max(orders) - 1, len(data) - at), at).astype(np.uint32)
        last = at + STRIDE >= len(data)
        for n in orders:
            m = len(raw) - n + 1 if last else STRIDE
            if m > 0:
                h = np.full(m, n, np.uint32)
                for k in range(n):
                    h = (h ^ raw[k : k + m]) * _ODD[k]
                    h ^= h >> np.uint32(15)
                out += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out
