"""Finds fingerprints that occur more than once, by exchanging Golomb-coded lists.

Every partition sorts its fingerprints and sends each owner (a range of values)
one compressed list, with a bit for those that it holds more than once itself.
The owner answers each list with a bitmap of the values that are duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import _golomb
from ._store import released

SENT = "msg long, owner int, payload binary, own binary"
REPLY = "msg long, owner int, n int, bitmap binary"


def owner_bits(partitions: int) -> int:
    return max(2, (max(1, partitions) - 1).bit_length() + 1)


def pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


def messages(msg: int, values: np.ndarray, repeated: np.ndarray, bits: int, total_bits: int = 64) -> dict[str, list]:
    """values: sorted and distinct; repeated: those that the sender holds more than once."""
    out: dict[str, list] = {"msg": [], "owner": [], "payload": [], "own": []}
    for owner, a, b in _golomb.slices(values, bits, total_bits):
        out["msg"].append(msg)
        out["owner"].append(owner)
        out["payload"].append(_golomb.encode(values[a:b]))
        out["own"].append(pack(repeated[a:b]))
    return out


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, dict[str, list]]]:
    """Groups the rows of a partition that is sorted by `key`."""
    now, held = None, None
    for batch in batches:
        cols = batch.to_pydict()
        for k, value in enumerate(cols[key]):
            if value != now:
                if held is not None:
                    yield now, held
                now, held = value, {c: [] for c in cols}
            for c, v in cols.items():
                held[c].append(v[k])
    if held is not None:
        yield now, held


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for owner, rows in by_key(batches, "owner"):
        lists = [_golomb.decode(p) for p in rows["payload"]]
        own = [unpack(o, len(v)) for o, v in zip(rows["own"], lists, strict=True)]
        every = np.sort(np.concatenate(lists))
        twice = every[1:][every[1:] == every[:-1]]
        twice = np.unique(np.concatenate([twice, *(v[o] for v, o in zip(lists, own, strict=True))]))
        maps = []
        for v in lists:
            at = np.searchsorted(twice, v)
            maps.append(pack((twice[np.minimum(at, len(twice) - 1)] == v) if len(twice) else np.zeros(len(v), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(rows["msg"], pa.int64()), pa.array([owner] * len(maps), pa.int32()), pa.array([len(v) for v in lists], pa.int32()), pa.array(maps, pa.binary())], names=["msg", "owner", "n", "bitmap"])


def replies(sent, partitions: int):
    """One row per message and owner; sent: a kept table of SENT."""
    return sent.repartition(partitions, "owner").sortWithinPartitions("owner").mapInArrow(released(answer), REPLY)
