"""Golomb coding of sorted numbers, with a power of two as divisor.

Quotients stand in unary in one bit stream and remainders at a fixed width in a
second one, so both directions are whole-array operations.
"""

from __future__ import annotations

import struct

import numpy as np


def encode(values: np.ndarray) -> bytes:
    """values: sorted, distinct, unsigned 64-bit."""
    n = len(values)
    if not n:
        return struct.pack("<I", 0)
    gaps = np.diff(values, prepend=values[:1])
    gaps[0] = 0
    mean = max(1, int(values[-1] - values[0]) // n)
    width = max(0, mean.bit_length() - 1)
    q = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(width, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
    first = np.packbits(unary, bitorder="little").tobytes()
    return struct.pack("<IBQI", n, width, int(values[0]), len(first)) + first + np.packbits(rest.ravel(), bitorder="little").tobytes()


def decode(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    if not n:
        return np.zeros(0, np.uint64)
    _, width, first, size = struct.unpack_from("<IBQI", data)
    at = struct.calcsize("<IBQI")
    unary = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")
    q = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    gaps = q.astype(np.uint64) << np.uint64(width)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + size), count=n * width, bitorder="little").reshape(n, width)
        gaps |= (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    gaps[0] = np.uint64(first)
    return np.cumsum(gaps, dtype=np.uint64)


def slices(values: np.ndarray, bits: int, total_bits: int = 64) -> list[tuple[int, int, int]]:
    """(owner, from, to) of the sorted values, where the owner is their top `bits` of `total_bits`."""
    if not len(values):
        return []
    owners = (values >> np.uint64(total_bits - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    at = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    return [(int(owners[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(values)], strict=True)]
