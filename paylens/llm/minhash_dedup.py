"""Near duplicates by one-permutation MinHash with optimal densification.

Texts with one set of shingles are first made one class. A class is hashed once into ``bins``
minima; an empty bin borrows from the bin that a hash of (bin, attempt) names, the first that is
not empty. Bands of bins give buckets, and each bucket is a star: its members are compared with
one centre, the member that meets the most others over all its buckets, instead of with each
other. Links are confirmed on full sets.

A star can miss links between its rays. So the members of every bucket that confirmed links have
not made one component are joined once more, exactly: two sets of the wanted similarity share one
of their first shingles in any fixed order, at places that leave room for the overlap. With rare
shingles first, only pairs that are nearly similar remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.bitmap import bitmap, bits_for, hits, id_positions
from paylens.llm.exchange import packed
from paylens.llm.landing import landed, texts
from paylens.llm.scan import inside, mix, scan, windows
from paylens.llm.worker import turn
from paylens.operators.graph import connected_components

SHINGLE, THRESHOLD = 5, 85
#: A pair at the threshold meets in no band with a chance of (1 - 0.85 ** 6) ** 32, about 3e-7.
BANDS, ROWS = 32, 6
#: Documents of one step of the signatures.
STEP_DOCS = 256
#: Cells in which shingles are counted to tell rare from common ones, 4 MB in all, and the parts they are summed in.
CELL_BITS, CELL_PARTS = 20, 16
CELLS = 1 << CELL_BITS
ENDS = "doc_id long, n_shingles long, set_hash binary, shingles binary"


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("minhash_dedup")
        for batch in batches:
            for i, j, w in scan(batch.column("text"), lower=True):
                h, count = w.hashes(), w.count
                runs = windows(h, size)
                start = np.flatnonzero(inside(w.first, size))
                doc = w.doc()
                value, owner = runs[start], doc[start]
                short = np.flatnonzero((count > 0) & (count < size))
                if len(short):  # the whole sequence as one
                    whole = np.array([windows(h[w.first[d] : w.first[d + 1]], count[d])[0] for d in short], np.uint64)
                    value, owner = np.r_[value, whole], np.r_[owner, short]
                order = np.lexsort((value, owner))
                value, owner = value[order], owner[order]
                new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
                value, owner = value[new], owner[new]
                at = np.searchsorted(owner, np.arange(j - i + 1))
                sets = np.split(value, at[1:-1])
                total = [np.r_[np.uint64(0), np.cumsum(mix(value + np.uint64(k)))] for k in (1, 2)]
                two = np.stack([t[at[1:]] - t[at[:-1]] for t in total], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at), pa.int64()), packed(list(two)), packed(sets)], ["doc_id", "n_shingles", "set_hash", "shingles"]
                )

    return run


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """``(sets, bins)`` minima of one permutation, empty bins densified; every set has an element."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D))
    cell = owner * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    low = h & np.uint64(0xFFFFFFFF)
    none = np.uint64(1 << 40)
    out = np.full(len(sets) * bins, none, np.uint64)
    np.minimum.at(out, cell, low)
    out = out.reshape(len(sets), bins)
    filled = out != none
    todo_row, todo_bin = np.nonzero(~filled)
    attempt = 1
    while len(todo_row):
        ask = mix(todo_bin.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)
        ask = ask.astype(np.int64)
        ok = filled[todo_row, ask]
        # the borrowed value is mixed with the bin it came from, so that bins do not agree by accident
        out[todo_row[ok], todo_bin[ok]] = mix(out[todo_row[ok], ask[ok]] + (ask[ok].astype(np.uint64) << np.uint64(33))) | np.uint64(1 << 41)
        todo_row, todo_bin = todo_row[~ok], todo_bin[~ok]
        attempt += 1
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """``(sets, bands)`` keys of the bands of their signatures."""
    s = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
    key = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        key = mix(key + s[:, :, r] + np.arange(bands, dtype=np.uint64)[None, :])
    return key


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("minhash_dedup")
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):  # one pair at a time: sets can be long
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= threshold * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _signed(size: int, bands: int, rows: int):
    """Per text its set's size and hash, and the keys of its bands."""
    sets = _sets(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sets(batches):
            n = b.column("n_shingles").to_numpy()
            keys = [b""] * b.num_rows
            some = np.flatnonzero(n)
            for at in np.split(some, range(STEP_DOCS, len(some), STEP_DOCS)) if len(some) else []:
                k = band_keys([np.frombuffer(b.column("shingles")[int(i)].as_py(), np.uint64) for i in at], bands, rows)
                for i, row in zip(at, k, strict=True):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "set_hash", "bands"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per band of each class."""
    for b in batches:
        if b.num_rows:
            keys = np.stack([np.frombuffer(x, np.int64) for x in b.column("bands").to_pylist()])
            doc, n = (np.repeat(b.column(c).to_numpy(), keys.shape[1]) for c in ("doc", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(doc), pa.array(n)], ["bucket", "doc", "n"])


def _sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n_shingles, shingles)`` of the documents in ``ids``, made again from their texts alone; a few more may come along."""
    spark = ids.sparkSession
    bits, at = bits_for(ids.count()), id_positions("doc_id")
    shared = spark.sparkContext.broadcast(bitmap(ids, at, bits, "once"))
    make = _sets(size)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return make(b.filter(pa.array(hits(b, at, bits, shared.value))) for b in batches if b.num_rows)

    return landed(docs.mapInArrow(some, ENDS).filter("n_shingles > 0").select("doc_id", "n_shingles", "shingles"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The links among ``pairs`` (a, b), on whole sets."""
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    both = right.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    return landed(both.select("a", "b", "left", "right").mapInArrow(_confirm(threshold), "a long, b long"), "links")


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold a shingle of each cell."""
    n = np.zeros(CELLS, np.uint32)
    for b in batches:
        for x in b.column("shingles").to_pylist():
            np.add.at(n, (np.frombuffer(x, np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
    parts = n.reshape(-1, CELLS // CELL_PARTS) if n.any() else []
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), packed(list(parts))], ["part", "counts"])


def _crowd_sum(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in t.column("counts").to_pylist())
    return pa.table({"part": t.column("part")[:1].combine_chunks(), "counts": packed([np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)])})


def _prefixes(threshold: int, shared):
    """A set's first shingles, rare ones first: two similar sets share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = shared.value
        for b in batches:
            tokens, rows, places = [], [], []
            for r, x in enumerate(b.column("shingles").to_pylist()):
                s = np.frombuffer(x, np.uint64)
                s = s[np.lexsort((s, crowd[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))]
                first = len(s) - -(-threshold * len(s) // 100) + 1
                tokens.append(s[:first].view(np.int64))
                rows.append(np.full(first, r))
                places.append(np.arange(first))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *(b.column(c).take(take) for c in ("doc_id", "n_shingles", "label")), pa.array(np.concatenate(places), pa.int64())], ["token", "doc", "n", "label", "place"])

    return run


def _completed(open_: DataFrame, label: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """All links among the documents of ``open_`` between different components, exactly."""
    sets = _sets_of(open_, docs, size)
    own = sets.join(open_, "doc_id")
    own = own.join(label.select(F.col("id").alias("doc_id"), "cluster"), "doc_id", "left").withColumn("label", F.coalesce("cluster", "doc_id"))
    own = landed(own.select("doc_id", "n_shingles", "shingles", "label"), "open-sets")
    crowd = np.zeros((CELL_PARTS, CELLS // CELL_PARTS), np.uint32)
    counts = own.select("shingles").mapInArrow(_crowds, "part long, counts binary").groupBy("part").applyInArrow(_crowd_sum, "part long, counts binary")
    for r in counts.collect():  # CELLS numbers in all
        crowd[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    shared = open_.sparkSession.sparkContext.broadcast(crowd.reshape(-1))
    first = landed(own.mapInArrow(_prefixes(threshold, shared), "token long, doc long, n long, label long, place long"), "prefixes")
    mixed = first.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    first = landed(first.join(mixed, "token"), "mixed")
    x, y = (first.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", "label", "place")]) for side in ("x", "y"))
    met = x.join(y, "token").filter("doc_x < doc_y AND label_x <> label_y")
    met = met.filter(F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * threshold)
    # what is left after the places where they meet must hold the overlap that the similarity asks for
    met = met.filter((1 + F.least(F.expr("n_x - place_x - 1"), F.expr("n_y - place_y - 1"))) * (100 + threshold) >= F.expr("n_x + n_y") * threshold)
    pairs = landed(met.select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b")).distinct(), "pairs")
    return _confirmed(pairs, sets, threshold)


def _joined(members: DataFrame, docs: DataFrame, size: int, threshold: int, bridge: DataFrame) -> DataFrame:
    """``(id, cluster)`` of the classes that links join; ``members`` are ``(bucket, doc, n, m)`` of buckets of ``m`` members."""
    degree = members.groupBy("doc").agg(F.sum("m").alias("degree"))
    ranked = landed(members.join(degree, "doc").select("bucket", "doc", "n", "degree"), "ranked")
    centre = landed(ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc")).alias("back"), "n")).alias("c")).select("bucket", (-F.col("c.back")).alias("centre"), F.col("c.n").alias("centre_n")), "centres")
    met = ranked.join(centre, "bucket").filter("doc <> centre").filter(F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * threshold)
    pairs = landed(met.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct(), "pairs")
    ids = landed(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    links = landed(_confirmed(pairs, _sets_of(ids, docs, size), threshold).unionByName(bridge), "links")
    label = landed(connected_components(links, "a", "b"), "labels")
    named = ranked.join(label.select(F.col("id").alias("doc"), "cluster"), "doc", "left").withColumn("label", F.coalesce("cluster", "doc"))
    named = landed(named.select("bucket", "doc", "label"), "named")
    apart = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = landed(named.join(apart, "bucket").select(F.col("doc").alias("doc_id")).distinct(), "open")
    more = _completed(open_, label, docs, size, threshold)
    return landed(connected_components(links.unionByName(more), "a", "b"), "labels")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Words are lower-cased in A-Z. A text of fewer words than a shingle has its whole sequence as
    one; an empty or null text has no shingle and links with nothing. Texts with
    ``100 * common >= threshold * all`` shingles are linked; a component is named by its smallest
    id. A row without an id links with nothing and is kept. Rows of one id are one document: they
    share its component. An empty table gives no rows.
    """
    t = texts(docs, id_col, text_col)
    signed = landed(t.mapInArrow(_signed(shingle, bands, rows), "doc_id long, n_shingles long, set_hash binary, bands binary"), "signed")
    some = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets are one class, named by its smallest id
    classes = landed(some.groupBy("set_hash").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "bands")).alias("c")).select("set_hash", F.col("c.doc_id").alias("doc"), F.col("c.n").alias("n"), F.col("c.bands").alias("bands")), "classes")
    spread = classes.select("bands", "doc", "n").mapInArrow(_spread, "bucket long, doc long, n long")
    spread = landed(spread, "spread")
    shared = spread.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").select("bucket", "m")
    members = landed(spread.join(shared, "bucket"), "members")
    # an id with several texts joins their classes
    owned = landed(some.join(classes.select("set_hash", "doc"), "set_hash").select("doc_id", "doc"), "owned")
    bridge = owned.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("a", "b")
    label = _joined(members, t.filter("doc_id IS NOT NULL"), shingle, threshold, bridge)
    named = owned.join(label.withColumnRenamed("id", "doc"), "doc", "left").select("doc_id", F.coalesce("cluster", "doc").alias("component_id"))
    named = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
