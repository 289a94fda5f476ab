"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source_size`` times. Whole copies are taken
outright; the fractions left are rounded in pairs: mass, counted in words, moves at random
from one document to the other until one of the two is whole, so the words taken by a source
never drift from its target. Blocks of a source are reduced alone and leave at most one
unsettled document each; those residuals are combined block by block in a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.landing import landed
from paylens.llm.scan import mix
from paylens.llm.worker import turn

#: Share of all words that the mix holds, the sources' weights in turn, and the most copies of a document.
SHARE, WEIGHTS, MOST_COPIES = 1.5, (3, 1, 2), 2
#: Documents of a block, and residuals that meet in one step of the tree.
BLOCK = 1 << 12
FAN_IN = 1 << 6


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, row_hash)``; the hash tells rows apart and drives all chance."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.select("doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64("doc_id", "source", "text").alias("row_hash"))


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weights in turn by code point order, null last; what a source cannot hold is shared again by weight."""
    spark = sources.sparkSession
    # order of all sources without one task: sort by range, then count whole partitions before
    ranked = landed(sources.orderBy(F.col("source").cast("binary").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    parts = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offset, before = {}, 0
    for r in parts:  # one row per partition
        offset[r["part"]] = before
        before += r["n"]
    offsets = spark.createDataFrame(list(offset.items()) or [(0, 0)], "part long, before long")
    place = ranked.withColumn("part", F.shiftright("at", 33)).join(offsets, "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    weighed = landed(place.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double").alias("weight")), "weighed")
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:  # each round at least one more source is full; levels only rise
        cap = F.col("source_size") * most
        is_full = F.col("weight") * F.lit(level) >= cap
        r = weighed.agg(F.sum(F.when(is_full, cap)).alias("held"), F.sum(F.when(~is_full, F.col("weight"))).alias("w"), F.count(F.when(is_full, 1)).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        full, level = r["n"], (total - (r["held"] or 0)) / r["w"]
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), (F.col("source_size") * most).cast("double")).alias("target"))


def pivot(size: np.ndarray, part: np.ndarray, chance: np.ndarray) -> int:
    """Rounds ``part`` (in words, 0 to ``size``) in place; returns the row still open, or -1.

    One row is open at a time. It and the next share their words until one of them is empty
    or full; expectations stay what they were, and so does the sum.
    """
    open_, eps = -1, 1e-9
    for i in range(len(size)):
        if part[i] <= eps * size[i] or part[i] >= size[i] * (1 - eps):
            part[i] = 0.0 if part[i] <= eps * size[i] else size[i]
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = open_, i
        up = min(size[a] - part[a], part[b])  # from b to a
        down = min(part[a], size[b] - part[b])  # from a to b
        move = up if chance[i] * (up + down) < down else -down
        part[a] += move
        part[b] -= move
        for x in (a, b):
            if part[x] <= eps * size[x]:
                part[x] = 0.0
            elif part[x] >= size[x] * (1 - eps):
                part[x] = size[x]
        left = [x for x in (a, b) if 0.0 < part[x] < size[x]]
        open_ = left[0] if left else -1
    return open_


def _settle(t: pa.Table) -> pa.Table:
    turn("mixing")
    t = t.sort_by([("size", "descending"), ("row_hash", "ascending"), ("doc_id", "ascending")])
    size, part = (t.column(c).to_numpy().astype(float).copy() for c in ("size", "part"))
    seed = t.column("row_hash").to_numpy().astype(np.uint64)
    chance = (mix(seed + np.uint64(t.column("depth")[0].as_py() + 1)) >> np.uint64(11)).astype(float) / float(1 << 53)
    last = pivot(size, part, chance)
    is_open = np.zeros(len(size), bool)
    if last >= 0:
        is_open[last] = True
    depth = t.column("depth").to_numpy() + 1
    up = t.column("block").to_numpy() // FAN_IN
    for name, col in (("part", pa.array(part)), ("open", pa.array(is_open)), ("depth", pa.array(depth)), ("block", pa.array(up))):
        t = t.set_column(t.schema.get_field_index(name), name, col)
    return t


ROW = "uid long, doc_id long, source string, size long, row_hash long, part double, block long, depth long, open boolean"


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` per row of ``docs``; ``taken = copies * size``.

    A null text has size 0 and takes nothing; a null source is a source of its own, the last.
    Repeated rows are rounded apart from each other in a fixed order. The last open document of a source is
    rounded by chance, so a source misses its target by less than one document. Chance is a hash
    of the row, hence reruns agree. An empty table gives no rows.
    """
    rows = landed(sizes(docs, id_col, text_col, source_col), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = landed(targets(per_source, share, weights, most), "targets")
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    # a number for each row, the same at every run of the later steps because it is written
    wanted = rows.withColumn("k", key).join(goal.withColumn("k", key).select("k", "source_size", "target"), "k")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumn("rate", F.least(rate, F.lit(float(most)))).withColumn("whole", F.floor(F.col("rate") + F.lit(1e-12)).cast("long"))
    wanted = landed(
        wanted.select("doc_id", "source", "size", "row_hash", "source_size", "target", "whole", (F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)) * F.col("size")).alias("part"), F.monotonically_increasing_id().alias("uid")),
        "wanted",
    )
    blocks = F.pmod(F.col("row_hash"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)))
    count = wanted.filter("part > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("k", key).select("k", "n")
    open_ = wanted.filter("part > 0").withColumn("k", key).join(count, "k").withColumn("block", blocks).withColumn("depth", F.lit(0).cast("long")).withColumn("open", F.lit(True))
    most_rows = wanted.filter("part > 0").groupBy("source").count().agg(F.max("count")).first()[0] or 0
    width, done = max(1, -(-most_rows // BLOCK)), []
    level = open_.select(*[c.split()[0] for c in ROW.split(", ")])
    while True:
        level = landed(level.groupBy(F.col("source"), F.col("block")).applyInArrow(_settle, ROW), "settled")
        done.append(level.filter("not open"))
        if width <= 1:
            break
        width = -(-width // FAN_IN)
        level = level.filter("open")
    toss = F.pmod(F.xxhash64("row_hash", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    done.append(level.filter("open").withColumn("part", F.when(toss * F.col("size") < F.col("part"), F.col("size").cast("double")).otherwise(0.0)))
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    extra = settled.filter("part > 0").select("uid", F.lit(1).cast("long").alias("more"))
    out = wanted.join(extra, "uid", "left")
    copies = F.col("whole") + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


