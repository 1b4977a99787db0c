"""Bit-sliced comparison of 64-bit fingerprints: bit planes, carry-save counters, abandoned words."""

from __future__ import annotations

import numpy as np

#: Planes between two looks at the counters.
STEP = 8
_ONES = ~np.uint64(0)


def planes(values: np.ndarray) -> np.ndarray:
    """The vertical form: row i holds bit i of all values, 64 to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius, compared bitwise from the top."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            more |= same & counter[k]
            same = same & ~counter[k]
    return more


def within(vertical: np.ndarray, lanes: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Those of the ascending lanes whose value is within `radius` of the value d lanes on.

    vertical: bit planes, with two words of padding behind the last lane.
    """
    words, first = np.unique(lanes >> 6, return_index=True)
    asked = np.bitwise_or.reduceat(np.uint64(1) << (lanes & 63).astype(np.uint64), first)
    over = ~asked
    counter = [np.zeros(len(words), np.uint64) for _ in range(radius.bit_length() + 1)]
    far, turn = d >> 6, np.uint64(d & 63)
    for at in range(0, 64, STEP):
        part = vertical[at : at + STEP]
        other = part[:, words + far] >> turn
        if turn:
            other |= part[:, words + far + 1] << (np.uint64(64) - turn)
        for carry in part[:, words] ^ other:
            for k in range(len(counter)):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
        over |= _exceeds(counter, radius)
        left = over != _ONES
        if not left.all():
            words, over, counter = words[left], over[left], [c[left] for c in counter]
            if not len(words):
                break
    at = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")) if len(words) else np.zeros(0, np.int64)
    return (words[at >> 6] << 6) + (at & 63) if len(at) else at
