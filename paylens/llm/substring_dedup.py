"""Repeated passages: fixed-block anchors, rolling probes, maximal extension.

Every document is cut into blocks of ``window // 2`` words; these are the index. Every run
of as many words, at any position, is a probe. A window that occurs twice contains a whole
indexed block in both places, and that block is hit by a probe elsewhere. So only windows
around hit blocks are candidates: those are extended to full windows and the first place of
each is found; all later ones are repeats, and their union gives the maximal repeated runs.

Probes travel as 40-bit prints in buckets, one per block of documents and distinct value; a
false hit only makes a further candidate. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.exchange import bucket_of, by_block, packed, slices, unpacked
from paylens.llm.landing import block_of, landed, texts, wide
from paylens.llm.scan import Words, buffers, inside, scan, windows

WINDOW = 20
#: Documents of a block, and bytes of text for each bucket of prints.
ROWS, BYTES_PER_BUCKET = 2048, 12 << 20
PRINT = np.uint64((1 << 40) - 1)


def _prints(h: np.ndarray) -> np.ndarray:
    """Low five bytes of each hash."""
    return np.ascontiguousarray((h & PRINT).view(np.uint8).reshape(-1, 8)[:, :5])


def _from_prints(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = x.reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _place(w: Words, n: int) -> np.ndarray:
    """Position within its text of the first ``n`` words."""
    return (np.arange(int(w.first[-1])) - np.repeat(w.first[:-1], w.count))[:n]


def _long(w: Words, size: int) -> np.ndarray:
    """Runs of ``size`` words that lie within a text of at least a window."""
    return inside(w.first, size)


def _probe(buckets: int, window: int):
    step = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in by_block(batch):
                hashes, anchors = [], []
                for _, _, w in scan(rows.column("text")):
                    h = windows(w.hashes(), step)
                    ok = inside(w.first, step) & (np.repeat(w.count, w.count)[: len(h)] >= window)
                    hashes.append(h[ok])
                    anchors.append(_place(w, len(h))[ok] % step == 0)
                h, a = np.concatenate(hashes), np.concatenate(anchors)
                order = np.argsort(h)
                h, a = h[order], a[order]
                at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                if len(at):
                    many = np.diff(np.r_[at, len(h)]) > 1
                    anchored = np.logical_or.reduceat(a, at)
                    h = h[at]
                    parts = list(slices(h, buckets))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b for b, _ in parts], pa.int64()),
                            pa.array([block] * len(parts), pa.int64()),
                            packed([_prints(h[s]) for _, s in parts]),
                            packed([np.packbits(anchored[s]) for _, s in parts]),
                            packed([np.packbits(many[s]) for _, s in parts]),
                        ],
                        ["bucket", "block", "prints", "anchored", "many"],
                    )

    return run


def _hit(t: pa.Table) -> pa.Table:
    """Indexed blocks that are met elsewhere: for each block of documents its own, as bucket and print in one number."""
    raw, _ = unpacked(t.column("prints"), np.uint8)
    sizes = np.array([len(x) // 5 for x in t.column("prints").to_pylist()])
    prints, row = _from_prints(raw), np.repeat(np.arange(len(sizes)), sizes)
    flag = [np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(t.column(c).to_pylist(), sizes, strict=True)]).astype(bool) for c in ("anchored", "many")]
    order = np.argsort(prints, kind="stable")
    prints, row, anchored, many = prints[order], row[order], flag[0][order], flag[1][order]
    at = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
    size = np.diff(np.r_[at, len(prints)])
    hot = np.logical_or.reduceat(anchored, at) & ((size > 1) | np.logical_or.reduceat(many, at))
    mine = np.repeat(hot, size) & anchored
    keys, row = prints[mine] | np.uint64(t.column("bucket")[0].as_py() << 40), row[mine]
    order = np.argsort(row, kind="stable")
    keys, row = keys[order], row[order]
    used, at = np.unique(row, return_index=True)
    return pa.table({"block": t.column("block").take(pa.array(used)).combine_chunks(), "hits": packed(np.split(keys, at[1:])) if len(used) else pa.array([], pa.binary())})


def _sorted(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _candidates(buckets: int, hit_buckets: int, window: int):
    step = window // 2

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        found = []
        if docs.num_rows and hits.num_rows:
            hot = np.unique(unpacked(hits.column("hits"))[0])
            for _, _, w in scan(docs.column("text")):
                h = w.hashes()
                runs = windows(h, step)
                place = _place(w, len(h))
                is_hot = np.zeros(len(h) + step, bool)
                at = np.flatnonzero(inside(w.first, step) & (place[: len(runs)] % step == 0))
                key = (runs[at] & PRINT) | (bucket_of(runs[at], hit_buckets) << np.uint64(40))
                i = np.searchsorted(hot, key)
                is_hot[at] = hot[np.minimum(i, len(hot) - 1)] == key
                ok = inside(w.first, window)
                start = np.flatnonzero(ok)
                p = place[start]
                near = is_hot[start + (-p) % step] & ((p % step != 0) | is_hot[start + step])
                found.append(windows(h, window)[start[near]])
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        parts = list(slices(keys, buckets))
        block = docs.column("block")[0].as_py() if docs.num_rows else None
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int64()), "keys": packed([keys[s] for _, s in parts])})

    return run


def _later(t: pa.Table) -> pa.Table:
    """For each block the windows that an earlier block has too."""
    t = t.sort_by("block")
    keys, row = unpacked(t.column("keys"))
    block = t.column("block").to_numpy()
    order = np.argsort(keys, kind="stable")  # equal keys stay in the order of blocks
    keys, row = keys[order], row[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    first = np.repeat(block[row[at]], np.diff(np.r_[at, len(keys)]))
    late = block[row] > first
    keys, row = keys[late], row[late]
    order = np.argsort(row, kind="stable")
    keys, row = keys[order], row[order]
    used, at = np.unique(row, return_index=True)
    return pa.table({"block": pa.array(block[used], pa.int64()), "repeats": packed(np.split(keys, at[1:])) if len(used) else pa.array([], pa.binary())})


def _strip(window: int):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        docs = _sorted(docs)
        known = np.unique(unpacked(repeats.column("repeats"))[0])
        hashes, covers = [], []
        for _, _, w in scan(docs.column("text")):
            h = windows(w.hashes(), window)
            start = np.flatnonzero(inside(w.first, window))
            hashes.append(h[start])
            covers.append((start, w.first))
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        again = np.ones(len(every), bool)
        again[np.unique(every, return_index=True)[1]] = False
        if len(known) and len(every):
            again |= known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every
        data, at = buffers(docs.column("text"))
        kept, n_words, n_removed, doc, seen = [], [], [], 0, 0
        for start, first in covers:
            bad = start[again[seen : seen + len(start)]]
            seen += len(start)
            edge = np.zeros(int(first[-1]) + 1, np.int64)
            np.add.at(edge, bad, 1)
            np.add.at(edge, bad + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            lost = np.diff(np.r_[0, np.cumsum(gone)][first])
            for i in range(len(first) - 1):
                ws = data[at[doc] : at[doc + 1]].tobytes().split()
                if lost[i]:
                    ws = [x for x, g in zip(ws, gone[first[i] : first[i + 1]].tolist(), strict=True) if not g]
                kept.append(b" ".join(ws).decode())
                doc += 1
            n_words.append(np.diff(first))
            n_removed.append(lost)
        n_words, n_removed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n_removed))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rows_per_block: int = ROWS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row: ``kept`` are the words left, joined by one space.

    A word goes when a window of ``window`` words covers it whose words also start earlier: in a
    document of smaller id, or earlier in the same one. Windows are judged on the input. Rows of
    one id are ordered by text; rows without an id come after all others in a fixed order of
    their texts. A null text has no words. An empty table gives no rows.
    """
    spark = docs.sparkSession
    t = texts(docs, id_col, text_col)
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = wide(spark, max(64, -(-size // BYTES_PER_BUCKET)))
    if window % 2 or buckets >= 1 << 24:
        raise ValueError("window must be even, and there are at most 2**24 buckets")
    t = t.withColumn("block", block_of(rows_per_block))
    sent = t.mapInArrow(_probe(buckets, window), "bucket long, block long, prints binary, anchored binary, many binary")
    hits = landed(sent.groupBy("bucket").applyInArrow(_hit, "block long, hits binary"), "hits")
    blocks = t.groupBy("block")
    found = blocks.cogroup(hits.groupBy("block")).applyInArrow(_candidates(buckets, buckets, window), "bucket long, block long, keys binary")
    repeats = found.groupBy("bucket").applyInArrow(_later, "block long, repeats binary")
    return blocks.cogroup(repeats.groupBy("block")).applyInArrow(_strip(window), "doc_id long, n_words long, n_removed long, kept string")
