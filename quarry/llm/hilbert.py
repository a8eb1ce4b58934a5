"""Hilbert keys of points, vectorised."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of integer cells (rows of ``dims`` coordinates below 2^bits; dims * bits <= 63).

    The cell's coordinates are turned into the curve's transposed index by
    exchanging and inverting their low bits from the highest bit downwards; the
    bits, interleaved, are the key.
    """
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        q = np.int64(1) << b
        low = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            x[high, 0] ^= low
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= t
            x[:, i] ^= t
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[:, dims - 1] >> b) & 1, (np.int64(1) << b) - 1, 0)
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key
