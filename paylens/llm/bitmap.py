"""Bitmaps of bounded size over all rows, merged segment by segment in a tree.

Partitions note which positions their rows set, once or more often. Segments of these notes
are merged on the executors, ``FAN_IN`` at a time; only the finished bitmap, never more than
``2 ** MOST_BITS`` bits, is sent through the driver. A full bitmap lets more rows through and
loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.scan import WRAP, mix
from paylens.llm.worker import turn

#: Bounds of a bitmap: 8 KB to 4 MB.
LEAST_BITS, MOST_BITS = 16, 25
BITS_PER_ROW = 24
PROBES = 4
#: Bits of one segment.
SEGMENT = 1 << 16
FAN_IN = 16

Positions = Callable[[pa.RecordBatch, int], np.ndarray]


def bits_for(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(max(1, rows) * BITS_PER_ROW).bit_length()))


def id_positions(column: str) -> Positions:
    """Positions of integer ids; a null id counts as -1."""

    def at(batch: pa.RecordBatch, bits: int) -> np.ndarray:
        ids = batch.column(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return np.stack([(mix(ids + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % WRAP)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(PROBES)], axis=1)

    return at


def _sightings(positions: Positions, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bitmap")
        seen = np.zeros(1 << bits, np.uint8)
        for b in batches:
            if b.num_rows:
                at, n = np.unique(positions(b, bits), return_counts=True)
                seen[at] = np.minimum(seen[at] + n, 2)
        rows = seen.reshape(-1, min(SEGMENT, 1 << bits))
        used = np.flatnonzero(rows.any(axis=1))
        if len(used):
            once, more = (np.packbits(rows[used] >= k, axis=1) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([r.tobytes() for r in once], pa.binary()), pa.array([r.tobytes() for r in more], pa.binary())], ["segment", "once", "more"])

    return run


def _merge(t: pa.Table) -> pa.Table:
    once, more = (np.stack([np.frombuffer(x, np.uint8) for x in t.column(c).to_pylist()]) for c in ("once", "more"))
    have, twice = once[0].copy(), more[0].copy()
    for o, m in zip(once[1:], more[1:], strict=True):
        twice |= m | (have & o)
        have |= o
    part = pa.array([t.column("part")[0].as_py() // FAN_IN], pa.int64())
    return pa.table({"segment": t.column("segment")[:1], "part": part, "once": pa.array([have.tobytes()], pa.binary()), "more": pa.array([twice.tobytes()], pa.binary())})


def bitmap(rows: DataFrame, positions: Positions, bits: int, which: str) -> np.ndarray:
    """Packed bits that rows set (``which`` = once) or that several rows set (more). ``rows`` must be a plain scan of a written table."""
    found = rows.mapInArrow(_sightings(positions, bits), "segment long, once binary, more binary")
    found = found.select("segment", F.floor(F.spark_partition_id() / FAN_IN).alias("part"), "once", "more")
    parts = rows.rdd.getNumPartitions()
    while True:
        found = found.groupBy("segment", "part").applyInArrow(_merge, "segment long, part long, once binary, more binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, min(SEGMENT, 1 << bits) // 8)
    for r in found.select("segment", which).collect():  # at most 2 ** MOST_BITS bits
        out[r["segment"]] |= np.frombuffer(r[which], np.uint8)
    return out.reshape(-1)


def hits(batch: pa.RecordBatch, positions: Positions, bits: int, packed: np.ndarray) -> np.ndarray:
    """Rows all of whose positions are set."""
    at = positions(batch, bits)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)
