"""Connected components by alternating star contraction.

Edges are kept between a node and a smaller one. A large step hangs every larger neighbour
of a node on the smallest node around it, a small step does the same for the smaller side.
Both are a map-side combined minimum and a join, so a hub with very many edges is never
collected in one place (its join key is split by the adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.session import cut_lineage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    # u > v in every edge here
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(id, cluster)`` for every node of ``pairs``; the cluster is its smallest node."""
    edges = pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = cut_lineage(edges)
    seen = _fingerprint(edges)
    for _ in range(max_rounds):
        # the large step yields (larger, smallest) with larger > smallest, the form the small step needs
        edges = cut_lineage(_small(_large(edges).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("cluster"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("cluster")).distinct()
    return members.union(roots)
