"""Arrays of 64-bit keys that blocks of documents send to buckets, and the buckets' answers.

A block sends each distinct key once, whatever the number of its rows that hold it, so a key
that fills a third of the corpus costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Buckets are told apart by the leading bits of a key.
BUCKET_BITS = 24


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key; sorted keys have sorted buckets."""
    return ((keys >> np.uint64(64 - BUCKET_BITS)) * np.uint64(buckets)) >> np.uint64(BUCKET_BITS)


def slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """``(bucket, its slice)`` of sorted keys."""
    if len(keys):
        b = bucket_of(keys, buckets)
        cuts = np.flatnonzero(np.diff(b)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            yield int(b[lo]), slice(int(lo), int(hi))


def by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each block of a batch, in their order."""
    block = batch.column("block").to_numpy(zero_copy_only=False)
    if len(block) == 0:
        return
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    for rows in np.split(order, cuts):
        whole = len(rows) == len(block)
        yield int(block[rows[0]]), batch if whole else batch.take(pa.array(rows))


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def unpacked(column: pa.ChunkedArray, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of packed arrays, and the row that each came from."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def squeezed(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays packed byte plane by byte plane: the leading bytes of sorted keys hardly change."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array([pack(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) for a in arrays], pa.binary())


def opened(data: bytes, kind=np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def unsqueezed(column: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    parts = [opened(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)
