"""The random test matrix as a hash of its indexes, so that it is never stored or shipped.

Spark's ANSI arithmetic refuses 64-bit products that wrap, so the hash is numpy's and the matrix, which has
as many rows as the data has columns, is made on the driver.
"""

from __future__ import annotations

import numpy as np

# The hash's multiplier and shift, the default seed, and the divisor that makes [-0.5, 0.5).
MULTIPLIER = 0xC6A4A7935BD1E995
SHIFT = 47
SEED = -6998239104786432000
DIVISOR = 2.0**64

_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def murmur64(values, seed: int = SEED, length: int = 8) -> np.ndarray:
    """The hash of 64-bit values, as signed 64-bit numbers."""
    m, r = np.uint64(MULTIPLIER), np.uint64(SHIFT)
    k = np.atleast_1d(np.asarray(values, np.int64)).astype(np.uint64)
    with np.errstate(over="ignore"):
        k = k * m
        k = (k ^ (k >> r)) * m
        h = (np.uint64((seed ^ length * MULTIPLIER) & _MASK) ^ k) * m
        h = (h ^ (h >> r)) * m
    return (h ^ (h >> r)).astype(np.int64)


def murmur64_bytes(data: bytes, seed: int = SEED) -> int:
    """The hash of bytes: whole words are big-endian and mixed, a rest is folded in unmixed."""
    h = (seed ^ len(data) * MULTIPLIER) & _MASK
    whole = len(data) // 8 * 8
    for i in range(0, whole, 8):
        k = int.from_bytes(data[i : i + 8], "big") * MULTIPLIER & _MASK
        h = (h ^ (k ^ k >> SHIFT) * MULTIPLIER & _MASK) * MULTIPLIER & _MASK
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "big")) * MULTIPLIER & _MASK
    h = (h ^ h >> SHIFT) * MULTIPLIER & _MASK
    return _signed(h ^ h >> SHIFT)


def murmur64_texts(texts: list[bytes], seed: int = SEED) -> np.ndarray:
    """murmur64_bytes of many byte strings: those of one length are hashed together."""
    m, r = np.uint64(MULTIPLIER), np.uint64(SHIFT)
    out, lengths = np.zeros(len(texts), np.int64), np.array([len(x) for x in texts], np.int64)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8).reshape(len(own), n)
        whole = n // 8 * 8
        words = np.ascontiguousarray(data[:, :whole]).view(">u8").astype(np.uint64).reshape(len(own), -1)
        h = np.full(len(own), (seed ^ int(n) * MULTIPLIER) & _MASK, np.uint64)
        with np.errstate(over="ignore"):
            for k in words.T:
                k = k * m
                h = (h ^ (k ^ (k >> r)) * m) * m
            if whole < n:
                rest = np.zeros(len(own), np.uint64)
                for c in data[:, whole:].T:
                    rest = rest << np.uint64(8) | c.astype(np.uint64)
                h = (h ^ rest) * m
            h = (h ^ (h >> r)) * m
        out[own] = (h ^ (h >> r)).view(np.int64)
    return out


def omega(rows: int, columns: int, seed: int = SEED) -> np.ndarray:
    """rows x columns values in [-0.5, 0.5), each the hash of its two indexes."""
    key = np.arange(rows, dtype=np.int64)[:, None] << np.int64(32) | np.arange(columns, dtype=np.int64)[None]
    return murmur64(key.ravel(), seed).astype(np.float64).reshape(rows, columns) / DIVISOR
