"""Annual and sub-annual series: changes, rebasing, growth, extension, reduction.

Windows run over the points of one entity, which are periods, not rows of raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions.maths import round_up_half


def yoy(df: DataFrame, entity: Sequence[str], t: str, value: str) -> DataFrame:
    """Percent change from the previous point that exists; the first point has none."""
    prev = F.lag(value).over(Window.partitionBy(*entity).orderBy(t))
    out = df.withColumn("__prev", prev).filter("__prev IS NOT NULL")
    return out.withColumn("change_pct", (F.try_divide(F.col(value), F.col("__prev")) - 1) * 100).drop("__prev")


def rebase(df: DataFrame, entity: Sequence[str], t: str, value: str, base) -> DataFrame:
    """Index with 100 at ``base``, or at the first point where the entity has no such period."""
    ref = df.groupBy(*entity).agg(F.max(F.when(F.col(t) == base, F.col(value))).alias("__at"), F.min_by(value, t).alias("__first"))
    out = df.join(ref, list(entity))
    return out.withColumn("index", 100 * F.try_divide(F.col(value), F.coalesce("__at", "__first"))).drop("__at", "__first")


def compound(actual: DataFrame, growth: DataFrame, entity: Sequence[str], t: str, value: str, rate: str) -> DataFrame:
    """Growth rates (percent) of later periods compounded onto the last actual value.

    A rate of -100 % or less has no logarithm and ends the projection at zero from there on.
    """
    tail = actual.groupBy(*entity).agg(F.max(t).alias("__last"), F.max_by(value, t).alias("__base"))
    w = Window.partitionBy(*entity).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    later = growth.join(tail, list(entity)).filter(F.col(t) > F.col("__last"))
    factor = F.col(rate) / 100 + 1
    logs = F.sum(F.when(factor > 0, F.ln(F.when(factor > 0, factor)))).over(w)
    gone = F.max((factor <= 0).cast("int")).over(w) == 1
    return later.select(*entity, t, F.when(gone, 0.0).otherwise(F.col("__base") * F.exp(logs)).alias(value))


def extrapolate(df: DataFrame, entity: Sequence[str], t: str, value: str, to: int, points: int = 10, anchor: bool = False) -> DataFrame:
    """Straight line through the first and last of the newest ``points``, year by year up to ``to``.

    With ``anchor`` the last actual point begins the line.
    """
    rn = F.row_number().over(Window.partitionBy(*entity).orderBy(F.desc(t)))
    recent = df.withColumn("__rn", rn).filter(F.col("__rn") <= points)
    ends = recent.groupBy(*entity).agg(
        F.min(t).alias("t0"), F.min_by(value, t).alias("v0"), F.max(t).alias("t1"), F.max_by(value, t).alias("v1")
    )
    start = F.col("t1") if anchor else F.col("t1") + 1
    ends = ends.filter((F.col("t1") > F.col("t0")) & (start <= to))
    out = ends.withColumn(t, F.explode(F.sequence(start, F.lit(to))))
    slope = (F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0"))
    return out.select(*entity, t, (F.col("v1") + slope * (F.col(t) - F.col("t1"))).alias(value))


def apply_trend(current: DataFrame, series: DataFrame, place: str, entity: str, t: str, value: str) -> DataFrame:
    """A place's current value moved along its country's series; every row is an estimate."""
    last = series.groupBy(entity).agg(F.max_by(value, t).alias("__latest")).filter("__latest <> 0")
    out = current.select(place, entity, F.col("value").alias("__now")).join(series.select(entity, t, value).join(last, entity), entity)
    return out.select(place, entity, t, (F.col("__now") * (F.col(value) / F.col("__latest"))).alias("value"), F.lit(True).alias("is_estimate"))


def last_per_year(df: DataFrame, entity: Sequence[str], year: str, t: str, value: str, digits: int = 1) -> DataFrame:
    return df.groupBy(*entity, year).agg(round_up_half(F.max_by(value, t), digits).alias("value"))


def mean_per_year(df: DataFrame, entity: Sequence[str], year: str, value: str, digits: int = 1) -> DataFrame:
    return df.groupBy(*entity, year).agg(round_up_half(F.avg(value), digits).alias("value"))


def monthly_mean(df: DataFrame, keys: Sequence[str], month: Column, value: str, digits: int = 2) -> DataFrame:
    """Daily points to monthly means with the number of days behind each."""
    return df.groupBy(*keys, month.alias("month")).agg(F.round(F.avg(value), digits).alias("value"), F.count(value).alias("days"))


def first_period(df: DataFrame, entity: Sequence[str], t: str) -> DataFrame:
    return df.groupBy(*entity).agg(F.min(t).alias("first_period"))


def year_spread(df: DataFrame, group: Sequence[str], year: str, label: str, pos: str) -> DataFrame:
    """Oldest and newest year of a group with the first row, in input order, that has them."""
    out = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(F.struct(year, pos, label)).alias("__old"),
        F.min(F.struct((-F.col(year)).alias("y"), pos, label)).alias("__new"),
    )
    return out.filter("__n >= 2").select(
        *group,
        (-F.col("__new.y") - F.col(f"__old.{year}")).alias("spread"),
        F.col(f"__old.{year}").alias("oldest_year"), F.col(f"__old.{label}").alias("oldest"),
        (-F.col("__new.y")).alias("newest_year"), F.col(f"__new.{label}").alias("newest"),
    )


def thin(df: DataFrame, entity: Sequence[str], t: str) -> DataFrame:
    """Every second point from the first, and always the last."""
    w = Window.partitionBy(*entity)
    out = df.withColumns({"__rn": F.row_number().over(w.orderBy(t)), "__n": F.count(F.lit(1)).over(w)})
    return out.filter((F.col("__rn") % 2 == 1) | (F.col("__rn") == F.col("__n"))).drop("__rn", "__n")


def domain(df: DataFrame, group: Sequence[str], value: str, off: str) -> DataFrame:
    """Axis range of a group: flagged rows do not set it unless fewer than two others remain."""
    on = F.when(~F.col(off), F.col(value))
    agg = df.groupBy(*group).agg(
        F.count(on).alias("in_scale"), F.min(on).alias("__lo"), F.max(on).alias("__hi"), F.min(value).alias("__alo"), F.max(value).alias("__ahi")
    )
    enough = F.col("in_scale") >= 2
    return agg.select(
        *group, "in_scale", F.when(enough, F.col("__lo")).otherwise(F.col("__alo")).alias("lo"), F.when(enough, F.col("__hi")).otherwise(F.col("__ahi")).alias("hi")
    )


def monotone(df: DataFrame, entity: Sequence[str], t: str, value: str, slack: float = 0.0) -> DataFrame:
    """Where a curve falls from one point to the next by more than ``slack``."""
    prev = F.lag(value).over(Window.partitionBy(*entity).orderBy(t))
    return df.withColumn("previous", prev).filter(F.col(value) < F.col("previous") - slack)


def headline(df: DataFrame, entity: str, t: str, value: str) -> DataFrame:
    """Per entity: first and last value, change between them, and the latest-period extremes over all."""
    per = df.groupBy(entity).agg(
        F.min(t).alias("from"), F.max(t).alias("to"), F.min_by(value, t).alias("first"), F.max_by(value, t).alias("last")
    )
    ends = F.broadcast(per.agg(F.max_by(entity, F.struct("last", entity)).alias("highest"), F.min_by(entity, F.struct("last", entity)).alias("lowest")))
    out = per.withColumn("change_pct", (F.try_divide("last", "first") - 1) * 100).join(ends)
    return out.withColumns({"is_highest": F.col(entity) == F.col("highest"), "is_lowest": F.col(entity) == F.col("lowest")}).drop("highest", "lowest")


def periods_at_top(df: DataFrame, entity: str, t: str, value: str) -> DataFrame:
    """In how many periods each entity had the largest value (smallest name on ties)."""
    top = df.groupBy(t).agg(F.min(F.struct((-F.col(value)).alias("v"), entity)).alias("m"))
    return top.groupBy(F.col(f"m.{entity}").alias(entity)).agg(F.count(F.lit(1)).alias("periods_at_top"))


def climate_normals(df: DataFrame, city: str, date: str, high: str, low: str) -> DataFrame:
    """Twelve monthly normals per city, all or none; the mean comes from the unrounded averages."""
    m = df.filter(F.col(high).isNotNull() & F.col(low).isNotNull()).groupBy(city, F.month(date).alias("month")).agg(
        F.avg(high).alias("h"), F.avg(low).alias("l")
    )
    full = m.groupBy(city).agg(F.count(F.lit(1)).alias("c")).filter("c = 12").select(city)
    return m.join(full, city).select(
        city, "month", F.round("h", 1).alias("avg_high"), F.round("l", 1).alias("avg_low"), F.round((F.col("h") + F.col("l")) / 2, 1).alias("mean")
    )
