"""Hilbert curve positions of points on a grid, for many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the curve of each row of ``cells`` (whole numbers below 2**bits, one column an axis).

    Axes are first brought to the curve's transposed form (undo the excess rotations from the top
    bit down, then Gray-encode), whose bits are interleaved from the first axis on.
    """
    x = [c.astype(np.uint64) for c in cells.T]
    n, one = len(x), np.uint64(1)
    level = 1 << (bits - 1)
    while level > 1:
        low, top = np.uint64(level - 1), np.uint64(level)
        for i in range(n):
            flip = (x[i] & top) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[n - 1] & np.uint64(level)) != 0, np.uint64(level - 1), np.uint64(0))
        level >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(b)) & one)
    return key.astype(np.int64)
