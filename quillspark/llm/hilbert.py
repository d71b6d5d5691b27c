"""Hilbert keys of points on a grid, vectorised over rows."""

from __future__ import annotations

import numpy as np


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``grid`` (cells of ``bits`` <= 8 bits).

    The coordinates are turned into the transposed index by undoing, from the highest
    bit down, the reflections and exchanges of axes that the curve makes at each level,
    and by Gray coding; the bits are then interleaved. ``columns * bits`` is at most 63.
    """
    n, d = grid.shape
    if d * bits > 63 or bits > 8:
        raise ValueError("a key has at most 63 bits, a cell at most 8")
    x = np.ascontiguousarray(grid.T.astype(np.uint8))
    for level in range(bits - 1, 0, -1):
        low = np.uint8((1 << level) - 1)
        for i in range(d):
            high = (x[i] >> level) & 1
            invert = high * low
            if i:
                swap = (x[0] ^ x[i]) & low & ~invert
                x[i] ^= swap
                x[0] ^= swap
            x[0] ^= invert
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.uint8)
    for level in range(bits - 1, 0, -1):
        flip ^= ((x[d - 1] >> level) & 1) * np.uint8((1 << level) - 1)
    x ^= flip
    planes = np.zeros((n, 64), np.uint8)
    at = 64 - d * bits
    for level in range(bits - 1, -1, -1):
        planes[:, at : at + d] = ((x >> level) & 1).T
        at += d
    return np.packbits(planes, axis=1).view(">u8").ravel().astype(np.int64)
