"""Count tables summed over map tasks.

A table of counts is cut into slices of ``SLICE`` entries. A map task sends the
slices it touched (sparse where that is shorter), first to one of ``SALTS``
places for each slice and from there to the slice's own, so no task receives
one part from every map task, and each adds up by streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftline.session import buckets

SLICE, SALTS = 1 << 12, 64
SCHEMA = "key string, slice int, salt int, data binary"


def _pack(n: np.ndarray) -> bytes:
    """Width of a count (its logarithm) and whether sparse, places if so, counts in the fewest bytes that hold them all."""
    at, top = np.flatnonzero(n), max(int(n.max(initial=0)), -int(n.min(initial=0)) - 1)
    k = next(k for k in range(4) if top < 1 << (8 << k) - 1)
    kind = np.dtype(f"i{1 << k}")
    if (2 + kind.itemsize) * len(at) < kind.itemsize * len(n):
        return bytes([4 + k]) + at.astype(np.uint16).tobytes() + n[at].astype(kind).tobytes()
    return bytes([k]) + n.astype(kind).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(f"i{1 << (data[0] & 3)}")
    if data[0] < 4:
        return np.frombuffer(data, kind, offset=1).astype(np.int64)
    k, out = (len(data) - 1) // (2 + kind.itemsize), np.zeros(SLICE, np.int64)
    out[np.frombuffer(data, np.uint16, k, 1)] = np.frombuffer(data, kind, k, 1 + 2 * k)
    return out


def _rows(held: dict[tuple[str, int], np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
    keys = list(held)
    for lo in range(0, len(keys), 512):
        part = keys[lo : lo + 512]
        yield pa.record_batch([pa.array([k for k, _ in part], pa.string()), pa.array([s for _, s in part], pa.int32()), pa.array([salt] * len(part), pa.int32()), pa.array([_pack(held[k]) for k in part], pa.binary())], ["key", "slice", "salt", "data"])


def send(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A map task's counts (each a multiple of SLICE long) as rows."""
    salt = TaskContext.get().partitionId() % SALTS
    for key, n in counts.items():
        parts = n.astype(np.int64).reshape(-1, SLICE)
        yield from _rows({(key, int(k)): parts[k] for k in np.flatnonzero(parts.any(axis=1))}, salt)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, total, salt = None, None, 0
    for x in batches:
        for key, k, salt, data in zip(*(x.column(j).to_pylist() for j in range(4))):
            if (key, k) != at:
                if at is not None:
                    yield from _rows({at: total}, salt)
                at, total = (key, k), np.zeros(SLICE, np.int64)
            total = total + _unpack(data)
    if at is not None:
        yield from _rows({at: total}, salt)


def collect(sent: DataFrame) -> dict[str, np.ndarray]:
    """The sums, {key: counts}; all tables end at the last slice that any of them touched."""
    parts = buckets(sent.sparkSession)
    first = sent.repartition(parts, "key", "slice", "salt").sortWithinPartitions("key", "slice").mapInArrow(_add, SCHEMA)
    rows = first.repartition(parts, "key", "slice").sortWithinPartitions("key", "slice").mapInArrow(_add, SCHEMA).collect()
    size = (max((r.slice for r in rows), default=-1) + 1) * SLICE
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.key, np.zeros(size, np.int64))[r.slice * SLICE : (r.slice + 1) * SLICE] = _unpack(bytes(r.data))
    return out
