"""Places of points along Hilbert curves."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point along the Hilbert curve through a grid of 2**bits cells a side.

    cells: points by rows, whole coordinates below 2**bits; dimensions times bits
    must not exceed 63. Coordinates are first turned into the transposed index:
    from the highest bit down, each coordinate whose bit is set flips the lower
    bits of the first one, and otherwise swaps them with it; Gray decoding over
    coordinates and interleaving of bits follow.
    """
    x = np.array(cells.T, np.uint64)
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)
