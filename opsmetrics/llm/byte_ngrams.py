"""Hashed byte n-gram counts of whole texts, as numpy arrays, for the two text classifiers."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20  # bytes counted at once, so a long text needs no more memory than that
_ODD = np.uint32(2654435761)


def ngram_counts(data: bytes, orders: tuple[int, ...], bits: int, symbols: np.ndarray | None = None) -> np.ndarray:
    """Counts of the n-grams of `data` by hash bucket, 2^bits of them.

    `symbols` maps each byte first; bytes mapped to 0 are boundaries, which an n-gram may have at
    its ends but not inside. The data is taken as having one boundary at either end.
    """
    counts = np.zeros(1 << bits, dtype=np.int64)
    overlap, shift = max(orders) - 1, np.uint32(32 - bits)
    for at in range(0, max(len(data), 1), PIECE):
        first, last = at == 0, at + PIECE >= len(data)
        part = np.frombuffer(data, np.uint8, count=min(len(data) - at, PIECE + overlap), offset=at) if data else np.zeros(0, np.uint8)
        at_end = at + len(part) == len(data)
        if symbols is not None:
            part = symbols[part]
        edge = np.array([0 if symbols is not None else 32], np.uint8)
        part = np.concatenate([edge[:first], part, edge[:at_end]]).astype(np.uint32)
        for n in orders:
            stop = min(len(part) - n + 1, len(part) if last else PIECE + first)
            if stop <= 0:
                continue
            packed = np.full(stop, n, np.uint32)
            inside = np.ones(stop, bool) if symbols is not None else None
            for k in range(n):
                column = part[k:k + stop]
                packed = packed * np.uint32(257) + column if n > 3 else (packed << np.uint32(8)) | column
                if inside is not None and 0 < k < n - 1:
                    inside &= column > 0
            buckets = (packed * _ODD) >> shift
            if inside is not None:
                buckets = buckets[inside]
            counts += np.bincount(buckets, minlength=1 << bits)
    return counts
