"""Exact order statistics, quantiles and ranks that never put one group into one task.

Spark's ``percentile``/``median`` keep every distinct value of a group in one aggregation
buffer, and a plain rank window sorts a whole group in one task. Both fail when one key
holds a large share of the rows. Here the value axis is cut into cells by a monotone
formula (no sampling, so a re-run task sees the same cells):

* quantiles: a histogram per (group, cell) is partially aggregated map-side, prefix-summed,
  and only the few cells that contain a wanted rank are looked into;
* ranks: offsets per cell plus a running count inside a cell, so the sort work of a group
  is spread over its cells;
* a cell is cut again into parts of equal width, as many as its rows call for, so that values of a
  narrow range are spread as well.

The number of cells of a group is bounded by the range of DOUBLE, not by its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_PER_OCTAVE = 512
#: Rows for which a crowded cell gets one more part of equal width.
PART_ROWS = 4096


def value_cell(value: Column, per_octave: int = CELLS_PER_OCTAVE) -> Column:
    """Monotone bucket number of a double: logarithmic in |value|, signed."""
    scaled = F.floor(F.log2(F.lit(1.0) + F.abs(value) * F.lit(1048576.0)) * F.lit(per_octave))
    return (F.signum(value) * scaled).cast("long")


def _wanted_ranks(probs: Sequence[float], method: str) -> list[tuple[str, str, str]]:
    """(lower rank, upper rank, weight of the upper) as SQL over ``__n``, ranks from 0."""
    out = []
    for p in map(float, probs):
        if method == "inclusive":
            low = f"floor({p!r}D * (__n - 1))"
            out.append((low, f"least({low} + 1, __n - 1)", f"({p!r}D * (__n - 1) - {low})"))
        else:
            # position p(n+1) counted from 1, the lower neighbour kept inside [1, n-1]
            j = f"greatest(1, least(floor({p!r}D * (__n + 1)), __n - 1))"
            out.append((f"({j} - 1)", f"least({j}, __n - 1)", f"({p!r}D * (__n + 1) - {j})"))
    return out


def _joined_on(by: Sequence[str]) -> Column:
    """Same cell and, null-safe, same group; the right side's keys carry a ``__by_`` prefix."""
    return F.expr(" AND ".join(["__c = __cell"] + [f"`{k}` <=> `__by_{k}`" for k in by]))


def _sub_cell(rows: str) -> str:
    """SQL of the place of ``__v`` among the equal parts of its cell, about one for each ``PART_ROWS`` of its ``rows``."""
    parts = f"ceil({rows} / {PART_ROWS}D)"
    return f"CAST(CASE WHEN __max > __min THEN least({parts} - 1, floor((__v - __min) / (__max - __min) * {parts})) ELSE 0 END AS BIGINT)"


def order_stats(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, str], times: str | None = None) -> DataFrame:
    """Exact order statistics per group: columns ``by``, ``n`` and one value per name in ``ranks``.

    A rank is SQL over ``__n`` (rows of the group with a value) and counts from 0. Without
    ``by`` the table of wanted cells has one row per rank and is broadcast; with groups the
    optimiser decides by its size. Null values are left out. A crowded cell, as values of a narrow
    range make, is cut again into parts of equal width, and only the parts with a wanted rank are sorted.
    ``times`` names a column that says how many rows a row stands for.
    """
    by = list(by)
    plain = df.select(*by, F.col(value).cast("double").alias("__v"), *([F.col(times).alias("__t")] if times else [])).filter("__v IS NOT NULL")
    counted = F.sum("__t") if times else F.count(F.lit(1))
    plain = plain.withColumn("__c", value_cell(F.col("__v")))

    over = "PARTITION BY " + (", ".join(f"`{k}`" for k in by) if by else "0")
    hist = plain.groupBy(*by, "__c").agg(counted.alias("__k"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    hist = hist.selectExpr(
        *[f"`{k}` AS `__by_{k}`" for k in by],
        "__c AS __cell",
        "__k AS __rows",
        "__min",
        "__max",
        f"sum(__k) OVER ({over} ORDER BY __c ROWS UNBOUNDED PRECEDING) AS __hi",
        f"sum(__k) OVER ({over}) AS __n",
    ).selectExpr("*", "__hi - __rows AS __lo")
    wanted = lambda lo, hi: " OR ".join(f"({rank} >= {lo} AND {rank} < {hi})" for rank in ranks.values())
    cells = hist.filter(wanted("__lo", "__hi")).drop("__hi")
    if not by:  # one row per rank
        cells = F.broadcast(cells)

    near = plain.join(cells, _joined_on(by)).selectExpr(*[f"`{k}`" for k in by], "__c", "__lo", "__n", "__v", *(["__t"] if times else []), f"{_sub_cell('__rows')} AS __s")
    keys = [*by, "__c", "__s"]
    near = near.groupBy(*keys, "__lo", "__n", "__v").agg(counted.alias("__k"))
    in_cell, in_part = ("PARTITION BY " + ", ".join(f"`{k}`" for k in ks) for ks in ([*by, "__c"], keys))
    parts = near.groupBy(*keys, "__lo", "__n").agg(F.sum("__k").alias("__k"))
    parts = parts.selectExpr("*", f"__lo + sum(__k) OVER ({in_cell} ORDER BY __s ROWS UNBOUNDED PRECEDING) AS __end").selectExpr("*", "__end - __k AS __begin")
    parts = parts.filter(wanted("__begin", "__end")).select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__begin")
    near = near.join(parts, F.expr(" AND ".join(f"`{k}` <=> `__of_{k}`" for k in keys)))
    near = near.selectExpr("*", f"__begin + sum(__k) OVER ({in_part} ORDER BY __v ROWS UNBOUNDED PRECEDING) AS __to")
    near = near.selectExpr("*", "__to - __k AS __from")
    at = [F.expr(f"max(CASE WHEN {rank} >= __from AND {rank} < __to THEN __v END)").alias(name) for name, rank in ranks.items()]
    return near.groupBy(*by).agg(F.expr("CAST(max(__n) AS BIGINT)").alias("n"), *at)


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    method: str = "inclusive",
    times: str | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per group: columns ``by``, ``n`` and one per name in ``probs``.

    ``method`` is ``inclusive`` (position p(n-1), as ``percentile``) or ``exclusive`` (position p(n+1)).
    ``times`` names a column that says how many rows a row stands for.
    """
    ranks = _wanted_ranks(probs.values(), method)
    named = {f"__{side}{i}": rank for i, (low, high, _) in enumerate(ranks) for side, rank in (("l", low), ("h", high))}
    stats = order_stats(df, by, value, named, times)
    weights = [frac.replace("__n", "n") for _, _, frac in ranks]
    return stats.selectExpr(
        *[f"`{k}`" for k in by],
        "n",
        *[f"__l{i} + (__h{i} - __l{i}) * {weights[i]} AS `{name}`" for i, name in enumerate(probs)],
    )


def group_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return group_quantiles(df, by, value, {name: 0.5})


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value) with its multiplicity."""
    return (
        df.select(*by, F.col(value).cast("double").alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy(*by, "v")
        .agg(F.count(F.lit(1)).alias("k"))
    )


def rank_table(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Ranks of every distinct value: ``by``, ``v``, ``k``, ``below`` (rows strictly smaller)
    and ``avg_rank`` (mean rank of the tie, from 1)."""
    by = list(by)
    counts = value_counts(df, by, value).withColumn("__c", value_cell(F.col("v")))
    return _ranked(counts, by)


def _ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    keys = [f"`{k}`" for k in by]
    over = "PARTITION BY " + (", ".join(keys) if by else "0")
    offs = counts.groupBy(*by, "__c").agg(F.sum("k").alias("__k"), F.count(F.lit(1)).alias("__values"), F.min("v").alias("__min"), F.max("v").alias("__max"))
    offs = offs.selectExpr(
        *[f"`{k}` AS `__by_{k}`" for k in by],
        "__c AS __cell",
        "__values",
        "__min",
        "__max",
        f"sum(__k) OVER ({over} ORDER BY __c ROWS UNBOUNDED PRECEDING) - __k AS __off",
        f"sum(__k) OVER ({over}) AS __total",
    )
    placed = counts.withColumn("__v", F.col("v")).join(offs, _joined_on(by)).selectExpr(*keys, "__c", "v", "k", "__off", "__total", f"{_sub_cell('__values')} AS __s")
    part = [*by, "__c", "__s"]
    in_cell, in_part = ("PARTITION BY " + ", ".join(f"`{k}`" for k in ks) for ks in ([*by, "__c"], part))
    before = placed.groupBy(*part).agg(F.sum("k").alias("__k"))
    before = before.selectExpr(*[f"`{k}` AS `__of_{k}`" for k in part], f"sum(__k) OVER ({in_cell} ORDER BY __s ROWS UNBOUNDED PRECEDING) - __k AS __before")
    out = placed.join(before, F.expr(" AND ".join(f"`{k}` <=> `__of_{k}`" for k in part)))
    out = out.selectExpr("*", f"__off + __before - k + sum(k) OVER ({in_part} ORDER BY v ROWS UNBOUNDED PRECEDING) AS __below")
    return out.selectExpr(
        *keys,
        "v",
        "k",
        "CAST(__below AS BIGINT) AS below",
        "__below + (k + 1) / 2D AS avg_rank",
        "CAST(__total AS BIGINT) AS n",
    )
