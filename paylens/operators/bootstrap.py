"""Poisson bootstrap with the replicate as an aggregated key.

A row's weight in a replicate is a counter-based draw from the two, so no replicate is ever a
column and no row is copied: a task walks over tiles of rows and replicates and keeps, per group,
one sum of weights and one weighted sum for each replicate. The sums of all tasks are combined in
a tree of two steps, for blocks of replicates apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.draws import counter, mixed, poisson, stream
from paylens.operators.quantiles import group_quantiles

#: Replicates of a tile and of a row of sums, rows of a tile, groups whose sums a task holds, branches of the tree.
REPLICATES, ROWS, GROUPS, BRANCHES = 1024, 512, 64, 64
SUMS = "key string, part long, block long, n binary, s binary"


class Sums:
    """Per group the sums of weights and of weighted values, one for each replicate."""

    def __init__(self, replicates: int, seed: int):
        self.streams = stream(np.arange(replicates), seed)
        self.of: dict[str, np.ndarray] = {}

    def add(self, keys: list[str], rows: np.ndarray, values: np.ndarray) -> None:
        """Rows in order of their keys."""
        starts = np.flatnonzero([True, *(a != b for a, b in zip(keys[1:], keys, strict=False))])
        for key in {keys[k] for k in starts} - self.of.keys():
            self.of[key] = np.zeros((2, len(self.streams)))
        for lo in range(0, len(keys), ROWS):
            hi = min(lo + ROWS, len(keys))
            cuts = np.r_[lo, starts[(starts > lo) & (starts < hi)]]
            for r in range(0, len(self.streams), REPLICATES):
                w = poisson(mixed(self.streams[r : r + REPLICATES, None] ^ rows[None, lo:hi])).astype(np.float64)
                for into, x in enumerate((w, w * values[lo:hi])):
                    total = np.add.reduceat(x, cuts - lo, axis=1)
                    for k, cut in enumerate(cuts):
                        self.of[keys[cut]][into, r : r + REPLICATES] += total[:, k]

    def rows(self, part: int) -> pa.RecordBatch:
        """All sums, and none are left."""
        out = [(key, part, b, *(x[b * REPLICATES : (b + 1) * REPLICATES].tobytes() for x in sums)) for key, sums in self.of.items() for b in range(-(-len(self.streams) // REPLICATES))]
        self.of = {}
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["key", "part", "block", "n", "s"])


def _together(t: pa.Table) -> pa.Table:
    """The sums of several parts, added in the order of the parts so that reruns agree to the last bit."""
    t = t.sort_by("part")
    n, s = (np.sum([np.frombuffer(x) for x in t.column(c).to_pylist()], axis=0) for c in ("n", "s"))
    return pa.table({"key": t.column("key")[:1], "part": pa.array([t.column("part")[0].as_py() % BRANCHES], pa.int64()), "block": t.column("block")[:1], "n": pa.array([n.tobytes()], pa.binary()), "s": pa.array([s.tobytes()], pa.binary())})


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, block, n, s in zip(*(b.column(c).to_pylist() for c in ("key", "block", "n", "s")), strict=True):
            n, s = np.frombuffer(n), np.frombuffer(s)
            mean = pa.array(np.divide(s, n, out=np.zeros(len(n)), where=n > 0), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(n), pa.string()), pa.array(block * REPLICATES + np.arange(len(n)), pa.int32()), pa.array(n.astype(np.int64)), mean], ["key", "replicate", "n", "mean"])


def bootstrap(df: DataFrame, by: Sequence[str], value: str, id_: str | Sequence[str], replicates: int, seed: int = 15) -> DataFrame:
    """``by, replicate, n, mean``: resampled size and mean of each group in each replicate.

    The rows are read once whatever the number of replicates. ``id_`` tells rows apart; rows that share
    it share their weights. Rows without a value are left out; a replicate that drew no row of a
    group has no mean. Groups of null keys count as groups.
    """
    ids = [id_] if isinstance(id_, str) else list(id_)
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}")
    rows = df.filter(F.col(value).isNotNull()).select(key.alias("key"), counter(*ids).alias("row"), F.col(value).cast("double").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), Sums(replicates, seed)
        for b in batches:
            b = b.sort_by("key")
            keys = b.column("key").to_pylist()
            if keys:
                sums.add(keys, b.column("row").to_numpy().astype(np.uint32), b.column("v").to_numpy())
            if len(sums.of) > GROUPS:
                yield sums.rows(part)
        yield sums.rows(part)

    parts = rows.mapInArrow(run, SUMS)
    for at in (F.pmod("part", F.lit(BRANCHES)), F.lit(0)):
        parts = parts.groupBy("key", "block", at.alias("at")).applyInArrow(_together, SUMS)
    out = parts.mapInArrow(_opened, "key string, replicate int, n long, mean double")
    if not by:
        return out.drop("key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    return out.withColumn("key", F.from_json("key", fields)).select("key.*", "replicate", "n", "mean")


def bootstrap_interval(df: DataFrame, by: Sequence[str], value: str, id_: str | Sequence[str], replicates: int = 10_000, level: float = 0.95, seed: int = 15) -> DataFrame:
    """``by, replicates, lo, hi``: percentile interval of the resampled means."""
    means = bootstrap(df, by, value, id_, replicates, seed)
    edge = (1 - level) / 2
    return group_quantiles(means, by, "mean", {"lo": edge, "hi": 1 - edge}).withColumnRenamed("n", "replicates")
