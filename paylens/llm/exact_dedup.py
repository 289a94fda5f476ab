"""Exact duplicates by two-pass Bloom filtering.

Pass one adds every text's hash to a counting filter of one or several sightings, kept in
segments that are merged in a tree. Pass two lets through every row whose positions were not
all seen repeatedly; only the others, the possibly repeated ones, are shuffled by their hash
and settled exactly. The filter's size follows the number of rows up to ``bitmap.MOST_BITS``, which
bounds what is broadcast; beyond that more rows take the exact way, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.bitmap import PROBES, bitmap, bits_for, hits
from paylens.llm.landing import landed, texts


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_sha256, size)``: hash of the text without white space, code points of the original."""
    t = texts(docs, id_col, text_col)
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")
    return t.select("doc_id", F.sha2(bare.cast("binary"), 256).alias("text_sha256"), F.char_length("text").alias("size"))


def _positions(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    """``(rows, PROBES)`` positions, read off the hash itself."""
    raw = np.frombuffer(bytes.fromhex("".join(batch.column("text_sha256").to_pylist())), ">u8").reshape(-1, 4)[:, :PROBES]
    return (raw.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, shuffled``.

    Texts are equal when they are after deleting white space; a null text is empty, and empty
    texts are equal to each other. Of equal texts the one with the most code points stays, on a
    tie the smallest id; a null id comes last. Rows that share an id share its outcome. An empty
    table gives no rows. Other columns of ``docs`` are not looked at. ``shuffled`` says whether
    the filter sent the row the exact way.
    """
    spark = docs.sparkSession
    rows = landed(digests(docs, id_col, text_col), "digests")
    bits = bits_for(rows.count())
    shared = spark.sparkContext.broadcast(bitmap(rows.select("text_sha256"), _positions, bits, "more"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("maybe", pa.array(hits(b, _positions, bits, shared.value)))

    told = landed(rows.mapInArrow(probe, "doc_id long, text_sha256 string, size int, maybe boolean"), "probed")
    alone = told.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", F.lit(False).alias("shuffled"))
    some = told.filter("maybe")
    best = some.groupBy("text_sha256").agg(F.max(F.struct("size", (-F.col("doc_id")).alias("back"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    best = landed(best.select("text_sha256", (-F.col("best.back")).alias("keep_id"), "group_size"), "groups")
    settled = some.join(best, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.lit(True).alias("shuffled"))
    return alone.unionByName(settled)
