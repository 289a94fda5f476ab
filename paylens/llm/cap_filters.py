"""Near-duplicate vectors by spherical-cap filters.

A filter is a random direction; a vector belongs to it when their product exceeds a threshold.
Directions are product codes: after a random rotation a vector is cut in two halves, each half
has a code of random unit vectors, and any pair of codewords is a direction. So the filters that
a vector exceeds can be listed without trying all: both halves' products are sorted, and for each
codeword of one half the partners that reach the threshold are a prefix of the other's order.
Vectors join on filters, and every pair met in a filter is verified by its exact cosine.

Equal vectors are one class. A filter's members are dealt out in tiles, and pairs of tiles are
compared apart, so that no filter has to fit one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.landing import landed
from paylens.operators.graph import connected_components

THRESHOLD = 0.95
#: Codes, each with a rotation of its own; filters that a linked pair is expected to share in all; members of a filter.
CODES, SHARED, LOAD = 4, 20.0, 48.0
#: Members of one tile.
TILE = 1024
#: Small filters that are compared in one call.
TOGETHER = 64
SEED = 20240601


def tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def both(t: float, rho: float) -> float:
    """Chance that two normal variables of correlation ``rho`` exceed ``t``."""
    x = np.linspace(t, t + 9, 4001)
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * np.array([tail((t - rho * v) / math.sqrt(1 - rho * rho)) for v in x])
    return float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))


def plan(rows: int, threshold: float = THRESHOLD, codes: int = CODES, shared: float = SHARED, load: float = LOAD) -> tuple[float, int]:
    """``(threshold in deviations, codewords of each half)``: a filter holds about ``load`` of ``rows`` vectors, a linked pair shares ``shared`` filters."""
    lo, hi = 1.0, 8.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if rows * tail(mid) > load else (lo, mid)
    t = lo
    return t, max(8, math.ceil(math.sqrt(shared / codes / both(t, threshold))))


class Code:
    """The filters of one rotation."""

    def __init__(self, dim: int, words: int, seed: int):
        rnd = np.random.default_rng(seed)
        self.half = (dim + 1) // 2
        q, r = np.linalg.qr(rnd.standard_normal((2 * self.half, 2 * self.half)))
        self.rotation = (q * np.sign(np.diag(r)))[:, :dim]
        self.words = []
        for _ in range(2):
            w = rnd.standard_normal((words, self.half))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True))

    def list(self, vectors: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` for every filter that a unit vector exceeds."""
        n, words = len(vectors), len(self.words[0])
        turned = vectors @ self.rotation.T
        a, b = (turned[:, i * self.half : (i + 1) * self.half] @ self.words[i].T * math.sqrt(self.half) for i in range(2))
        order = np.argsort(-b, axis=1)
        b = np.take_along_axis(b, order, axis=1)
        least = deviations - a  # what the partner must reach; the sum of both has variance 1
        row, one = np.nonzero(least <= b[:, :1])
        # the partners are a prefix; its length by bisection, all rows at once
        need = least[row, one]
        lo, hi = np.ones(len(row), np.int64), np.full(len(row), words, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = b[row, mid - 1] >= need
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        at = np.arange(int(lo.sum())) - np.repeat(np.cumsum(lo) - lo, lo)
        row, one = np.repeat(row, lo), np.repeat(one, lo)
        return row, one * words + order[row, at]


def _filters(dim: int, words: int, deviations: float, codes: int, names_only: bool):
    """One row per vector and filter: the vector, and all its filters in order; or the filters' names alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Code(dim, words, SEED + c) for c in range(codes)]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                x = np.stack([np.frombuffer(v, np.float64) for v in b.column("unit").to_pylist()])
                found = [book.list(x, deviations) for book in books]
                row = np.concatenate([r for r, _ in found])
                name = np.concatenate([f + c * words * words for c, (_, f) in enumerate(found)])
                if names_only:
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64())], ["filter"])
                    continue
                order = np.lexsort((name, row))
                row, name = row[order], name[order]
                own = [o.tobytes() for o in np.split(name, np.searchsorted(row, np.arange(1, b.num_rows)))]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "size", "unit")), pa.array(name, pa.int64()), pa.array([own[r] for r in row], pa.binary())], ["id", "size", "unit", "filter", "filters"])

    return run


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _within(here: int, unit: np.ndarray, tile: np.ndarray, books: list[bytes], threshold: float, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among the members of one filter, and which of them no earlier filter has met."""
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
    if across:
        keep = tile[a] != tile[b]
        a, b = a[keep], b[keep]
    cosine = np.einsum("ij,ij->i", unit[a], unit[b])
    for i in np.flatnonzero(np.abs(cosine - threshold) < 1e-9):  # too close for a sum in any order
        cosine[i] = math.fsum(unit[a[i]] * unit[b[i]])
    a, b = a[cosine >= threshold], b[cosine >= threshold]
    if not len(a):
        return a, b, np.zeros(0, bool)
    used, at = np.unique(np.r_[a, b], return_inverse=True)
    lists = [np.frombuffer(books[i], np.int64) for i in used]
    lists = [x[: np.searchsorted(x, here)] for x in lists]
    names, col = np.unique(np.concatenate(lists), return_inverse=True)
    holds = np.zeros((len(used), len(names)), np.float32)
    holds[np.repeat(np.arange(len(used)), [len(x) for x in lists]), col] = 1
    before = holds @ holds.T > 0
    return a, b, ~before[at[: len(a)], at[len(a) :]]


def _linked(threshold: float):
    """Links that are first met in these filters, counted by row, and a spanning forest of all their links."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("filter")
        name, ids, size, tile = (t.column(c).to_numpy() for c in ("filter", "id", "size", "tile"))
        units = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
        books = t.column("filters").to_pylist()
        across = t.column("one")[0].as_py() != t.column("two")[0].as_py()
        cuts = np.r_[0, np.flatnonzero(np.diff(name)) + 1, len(name)]
        out = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j - i > 1:
                a, b, first = _within(int(name[i]), units[i:j], tile[i:j], books[i:j], threshold, across)
                if len(a):
                    n, weight = j - i, size[i:j].astype(float)
                    links = np.bincount(a[first], weight[b[first]], n) + np.bincount(b[first], weight[a[first]], n)
                    label = components(n, a, b)
                    used = np.unique(np.r_[a, b])
                    out.append((ids[i:j][used], links[used].astype(np.int64), ids[i:j][label[used]]))
        ids, links, root = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    return run


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; nothing for a vector that has none."""
    for b in batches:
        out = []
        for v in b.column("vector").to_pylist():
            x = np.array([] if v is None or any(e is None for e in v) else v, np.float64)
            norm = math.sqrt(math.fsum(x * x)) if len(x) and np.isfinite(x).all() else 0.0
            if norm and not math.isfinite(norm):
                x, norm = x / np.abs(x).max(), math.sqrt(math.fsum((x / np.abs(x).max()) ** 2))
            out.append((x / norm).tobytes() if norm else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "unit"])


def cap_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``.

    Vectors of cosine ``threshold`` or more that meet in a filter are linked; ``n_links`` counts the
    other rows linked directly, equal vectors among them. A vector that is null, empty or zero, or
    holds a null or a number that is not finite, links with nothing and is kept, and so does a row
    without an id. Vectors of other lengths than the commonest are compared among themselves. Rows
    of one id count each and share a component. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    units = landed(rows.mapInArrow(_unit, "id long, unit binary"), "units")
    good = units.filter("id IS NOT NULL AND unit IS NOT NULL")
    classes = landed(good.groupBy("unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")), "classes")
    owned = landed(good.join(classes.select("unit", F.col("id").alias("class"), "size"), "unit").select("id", "class", "size"), "owned")
    found = None
    for r in classes.groupBy(F.expr("octet_length(unit) div 8").alias("dim")).count().collect():  # one row per length of vectors
        dim, n = r["dim"], r["count"]
        t, words = plan(n, threshold)
        mine = classes.filter(F.octet_length("unit") == 8 * dim).select("id", "size", "unit").repartition(F.col("id"))
        names = mine.mapInArrow(_filters(dim, words, t, CODES, True), "filter long")
        # only filters of more than a tile are cut into tiles
        large = landed(names.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE).select("filter", F.ceil(F.col("n") / TILE).alias("tiles")), f"large-{dim}")
        met = mine.mapInArrow(_filters(dim, words, t, CODES, False), "id long, size long, unit binary, filter long, filters binary")
        met = met.join(large, "filter", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long"))).withColumn("tile", F.expr("pmod(xxhash64(id), tiles)"))
        # every pair of tiles once, a tile with itself among them
        pairs = F.expr("transform(sequence(0L, tiles - 1), x -> struct(least(x, tile) AS one, greatest(x, tile) AS two))")
        met = met.withColumn("pair", F.explode(pairs)).withColumn("part", F.when(F.col("tiles") > 1, -F.col("filter") - 1).otherwise(F.expr(f"filter div {TOGETHER}")))
        links = met.select("part", "pair.one", "pair.two", "filter", "filters", "id", "size", "unit", "tile").groupBy("part", "one", "two").applyInArrow(_linked(threshold), "id long, links long, root long")
        found = links if found is None else found.unionByName(links)
    if found is None:
        alone = units.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return alone
    found = landed(found, "links")
    bridge = owned.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).select("a", "b")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(bridge).filter("a <> b").distinct()
    label = connected_components(edges, "a", "b").withColumnRenamed("id", "class")
    links = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    per_class = landed(classes.select(F.col("id").alias("class"), "size").join(links, "class", "left").join(label, "class", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("cluster", "class").alias("component_id")), "per-class")
    linked = owned.select("id", "class").join(per_class, "class").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    others = units.filter("id IS NULL OR unit IS NULL").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(others).select("vec_id", "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))
