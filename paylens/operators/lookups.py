"""Reference look-ups and the joins between facts, dimensions and earlier runs.

No side is force-broadcast: reference tables come in as DataFrames whose size the
optimiser knows (file statistics, adaptive runtime sizes) and it decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, entity: Sequence[str], order: str, keep: Sequence[str]) -> DataFrame:
    """Newest observation per entity, one map-side combined aggregation."""
    picked = F.max_by(F.struct(order, *keep), F.col(order)).alias("__p")
    out = df.groupBy(*entity).agg(picked)
    return out.select(*entity, *[F.col(f"__p.{c}").alias(c) for c in [order, *keep]])


def exact_lookup(df: DataFrame, ref: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Left look-up on every key exactly; ``value`` is null where there is none."""
    return df.join(ref.select(*on, value), list(on), "left")


def year_or_latest(df: DataFrame, ref: DataFrame, entity: str, year: str, value: str, used: str) -> DataFrame:
    """Value of the same year, else of the newest year the entity has; ``used`` is the year taken."""
    exact = ref.select(entity, F.col(year).alias("__y"), F.col(value).alias("__exact"))
    newest = ref.groupBy(entity).agg(
        F.max_by(value, year).alias("__latest"), F.max(year).alias("__latest_year")
    )
    out = df.join(exact, (df[entity] == exact[entity]) & (df[year] == exact["__y"]), "left").drop(exact[entity])
    out = out.join(newest, entity, "left")
    return out.select(
        *df.columns,
        F.coalesce("__exact", "__latest").alias(value),
        F.when(F.col("__exact").isNotNull(), F.col(year)).otherwise(F.col("__latest_year")).alias(used),
    )


def crosswalk_join(df: DataFrame, crosswalk: DataFrame, on: Sequence[str], key: str, unmapped: str = "unmapped") -> DataFrame:
    """Attach the shared key; a row without one, or mapped to the sentinel, says why."""
    out = df.join(crosswalk.select(*on, key), list(on), "left")
    return out.withColumn(
        "reason",
        F.when(F.col(key).isNull(), "no mapping").when(F.col(key) == unmapped, "no correspondence"),
    )


def reconcile(live: DataFrame, stored: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """Full outer comparison: match, mismatch, live-only, stored-only.

    The tolerance is a share of the stored value; a stored 0 must be met by 0.
    """
    a = live.select(*keys, F.col("value").alias("live"))
    b = stored.select(*keys, F.col("value").alias("stored"))
    both = a.join(b, list(keys), "full_outer")
    within = F.abs(F.col("live") - F.col("stored")) <= F.abs(F.col("stored")) * tol
    return both.withColumn(
        "class",
        F.when(F.col("stored").isNull(), "live_only")
        .when(F.col("live").isNull(), "stored_only")
        .when(within, "match")
        .otherwise("mismatch"),
    )


def stale_merge(merged: DataFrame, sources: DataFrame, key: str, stamp: str) -> DataFrame:
    """Members whose stamp at merge time differs from the stamp now."""
    a = merged.select(key, F.col(stamp).alias("recorded"))
    b = sources.select(key, F.col(stamp).alias("current"))
    return a.join(b, key).filter(~F.col("recorded").eqNullSafe(F.col("current")))


def lost_keys(base: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``base`` that ``current`` no longer has."""
    return base.select(*keys).distinct().join(current.select(*keys).distinct(), list(keys), "left_anti")


def orphans(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """Keys present on one side only, tagged with the side that has them."""
    left = lost_keys(a, b, [key]).withColumn("only_in", F.lit(a_name))
    right = lost_keys(b, a, [key]).withColumn("only_in", F.lit(b_name))
    return left.unionByName(right)


def classes_back(df: DataFrame, classes: DataFrame, key: str, label: str, default: str = "unclassified") -> DataFrame:
    """Class of every row through its distinct key."""
    out = df.join(classes.select(key, label), key, "left")
    return out.withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def drop_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows that are not a removable member of a duplicate cluster."""
    return df.join(members.select(key), key, "left_anti")


def segments(points: DataFrame, entity: Sequence[str], x: str, y: str) -> DataFrame:
    """Consecutive points as line segments ``x0,y0,x1,y1``; one open-ended row before and after.

    Points of a curve are few per entity, so the window holds a handful of rows.
    """
    w = Window.partitionBy(*entity).orderBy(x)
    body = points.select(
        *entity,
        F.col(x).alias("x0"),
        F.col(y).alias("y0"),
        F.lead(x).over(w).alias("x1"),
        F.lead(y).over(w).alias("y1"),
        F.row_number().over(w).alias("__n"),
    )
    first = body.filter("__n = 1").select(
        *entity, F.lit(float("-inf")).alias("x0"), "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1")
    )
    rest = body.select(
        *entity, "x0", "y0", F.coalesce("x1", F.lit(float("inf"))).alias("x1"), F.coalesce("y1", "y0").alias("y1")
    )
    return first.unionByName(rest)


def on_segment(x: Column) -> Column:
    """Linear value on a matched segment; the open ends hold their only value (no extrapolation)."""
    inner = F.col("x0").between(-1e300, 1e300) & F.col("x1").between(-1e300, 1e300)
    return F.when(
        inner, F.col("y0") + (x - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    ).otherwise(F.col("y0"))


def curve_lookup(df: DataFrame, points: DataFrame, entity: Sequence[str], at: str, x: str, y: str, out: str) -> DataFrame:
    """Piecewise-linear value of each row's own curve, clamped at both ends."""
    seg = segments(points, entity, x, y)
    cond = (df[at] >= seg["x0"]) & (df[at] < seg["x1"])
    for k in entity:
        cond = cond & (df[k] == seg[k])
    joined = df.join(seg, cond, "left")
    return joined.select(
        *[df[c] for c in df.columns],
        on_segment(df[at]).alias(out),
        F.when(seg["x0"] == float("-inf"), "low")
        .when((seg["x1"] == float("inf")) & (df[at] > seg["x0"]), "high")
        .alias("clamped"),
    )


def benchmark_ratio(
    df: DataFrame, reference: DataFrame, entity: str, year: str, lo: float, hi: float, verified: str
) -> DataFrame:
    """Median (regular basis, else total) against the average of the same entity and year.

    status: exempt (entity has no series), no_year, uncheckable (composition not verified),
    no_figure, flagged, ok. ``verified`` names a boolean column.
    """
    has_series = reference.select(entity).distinct().withColumn("__series", F.lit(True))
    same_year = reference.select(entity, year, F.col("value").alias("reference"))
    out = df.join(has_series, entity, "left").join(same_year, [entity, year], "left")
    figure = F.coalesce("regular", "total")
    ratio = figure / F.nullif(F.col("reference"), F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn(
        "status",
        F.when(F.col("__series").isNull(), "exempt")
        .when(F.col("reference").isNull(), "no_year")
        .when(figure.isNull() & ~F.col(verified), "uncheckable")
        .when(figure.isNull(), "no_figure")
        .when((ratio < lo) | (ratio > hi), "flagged")
        .otherwise("ok"),
    ).drop("__series")
