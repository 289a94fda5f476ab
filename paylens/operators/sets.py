"""Unions, differences and identity checks on sets of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all sources under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def clean_tokens(df: DataFrame, token: str, pos: str) -> DataFrame:
    """Lower-case, trimmed, non-blank tokens with the position of their first occurrence."""
    t = F.lower(F.trim(F.col(token)))
    return df.select(t.alias(token), pos).filter(F.col(token) != "").groupBy(token).agg(F.min(pos).alias(pos))


def duplicate_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def shared_fields(a: DataFrame, b: DataFrame, path: str = "path") -> DataFrame:
    """Field names that occur on both sides of a boundary."""
    leaf = lambda df: df.select(F.element_at(F.split(path, r"\."), -1).alias("field")).distinct()
    return leaf(a).intersect(leaf(b))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def agreement(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows flagged by all and by any of the rules."""
    votes = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return df.withColumns({"votes": votes, "by_all": votes == len(flags), "by_any": votes > 0})
