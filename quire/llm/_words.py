"""Words of a block of documents, interned with numpy.

A block is a few MB of UTF-8. Words are maximal runs without ASCII white space
(bytes 0x20 and 0x09-0x0D). Every word gets the index of its distinct form, so
that work per distinct word is done once per block and spread by indexing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

BLOCK_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LONG = 256


class Words:
    """starts, ends: of every word in `buf`; inverse: its distinct form; first: a word of each form; doc_first: the first word of each document, then the count."""

    __slots__ = ("buf", "starts", "ends", "inverse", "first", "doc_first", "keys")

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join(texts) + b"\n" + bytes(8)
        raw = np.frombuffer(joined, np.uint8)
        buf = self.buf = _LOWER[raw] if lower else raw
        n = len(joined) - 8
        space = _SPACE[buf[:n]]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if n and not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        doc_starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=doc_starts[1:])
        self.doc_first = np.searchsorted(self.starts, doc_starts)
        self._intern()

    def _intern(self) -> None:
        starts, lens = self.starts, self.ends - self.starts
        lanes = np.ndarray((len(self.buf) - 7,), "<u8", self.buf.data, strides=(1,))
        with np.errstate(over="ignore"):
            lane = lanes[starts] & _MASK[np.minimum(lens, 8)]
            a = (lane ^ (lens.astype(np.uint64) * _M3)) * _M1
            a ^= a >> np.uint64(32)
            b = (lane + lens.astype(np.uint64)) * _M2
            more, at = np.flatnonzero(lens > 8), 8
            while more.size:
                if at >= _LONG:
                    view = memoryview(self.buf)
                    for i in more:
                        d = xxhash.xxh3_128_intdigest(view[starts[i] + at : self.ends[i]])
                        a[i] ^= np.uint64(d & (1 << 64) - 1)
                        b[i] ^= np.uint64(d >> 64)
                    break
                lane = lanes[starts[more] + at] & _MASK[np.minimum(lens[more] - at, 8)]
                x = (a[more] ^ lane) * _M1
                a[more] = x ^ (x >> np.uint64(29))
                b[more] = (b[more] ^ (lane >> np.uint64(7))) * _M3 + lane
                at += 8
                more = more[lens[more] > at]
            a = (a ^ (a >> np.uint64(31))) * _M2
        order = np.argsort(a)
        sa, sb = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = sa[1:] != sa[:-1]
        if len(a) and np.any(~new[1:] & (sb[1:] != sb[:-1])):
            order = np.lexsort((b, a))
            sa, sb = a[order], b[order]
            new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        self.inverse = np.empty(len(a), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.keys = sa[new]

    def distinct(self) -> list[bytes]:
        """The distinct words, by their index."""
        raw = self.buf.tobytes()
        return [raw[s:e] for s, e in zip(self.starts[self.first].tolist(), self.ends[self.first].tolist(), strict=True)]

    def distinct_at(self, indexes: np.ndarray) -> list[tuple[int, bytes]]:
        """(index, word) of some of the distinct words."""
        return [(k, self.buf[self.starts[f] : self.ends[f]].tobytes()) for k, f in zip(indexes.tolist(), self.first[indexes].tolist(), strict=True)]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_first) - 1), np.diff(self.doc_first))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, distinct word and count of each pair that occurs, by document."""
        n = max(1, len(self.first))
        key = np.sort(self.doc_of() * n + self.inverse)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(key)))
        return key[new] // n, key[new] % n, counts


def blocks(batches: Iterable, columns: list[str], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[dict[str, list]]:
    """Regroups Arrow batches so that each block has about `size` bytes of text; null text becomes empty. A longer document is a block of its own."""
    import pyarrow as pa

    rows: dict[str, list] = {c: [] for c in [*columns, text]}
    held = 0
    for batch in batches:
        cols = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns}
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        for k, t in enumerate(texts):
            t = t or b""
            if held and held + len(t) > size:
                yield rows
                rows, held = {c: [] for c in [*columns, text]}, 0
            for c in columns:
                rows[c].append(cols[c][k])
            rows[text].append(t)
            held += len(t) + 16
    if rows[text]:
        yield rows
