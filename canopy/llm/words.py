"""Words of many texts at once, as arrays: where they stand, and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_CODE = np.random.default_rng(20240301).integers(1, 2**63, 1 << 16, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


def hashed_words(units: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every run of units (bytes or code points) that aren't blank.

    A hash is a polynomial, modulo 2^64, of what stands for its units.
    """
    edge = np.concatenate(([True], blank, [True]))
    edges = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    inside = np.arange(len(units)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(units)]))))
    letters = _CODE[units & units.dtype.type(0xFFFF if units.dtype.itemsize > 1 else 0xFF)]
    if units.dtype.itemsize > 2:
        letters ^= units >> np.uint32(16)
    letters *= powers(BASE, longest)[np.minimum(inside, longest)]
    letters[blank] = 0
    return starts, ends, mixed(np.add.reduceat(letters, starts) + (ends - starts).astype(np.uint64))
