"""The core tables: places enriched with what is known of their country, and coverage of both."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.operators import lookups
from paylens.operators.ranking import derive_money


def build_core(cities: DataFrame, countries: DataFrame, series: dict[str, DataFrame], country: str) -> DataFrame:
    """Cities joined with their country and the latest point of each series (entity, year, value)."""
    out = cities.join(countries, country, "left")
    for name, s in series.items():
        newest = s.groupBy(F.col("entity").alias(country)).agg(F.max_by("value", "year").alias(name), F.max("year").alias(f"{name}_year"))
        out = out.join(newest, country, "left")
    return out


def core_with_money(cities: DataFrame, countries: DataFrame, series: dict[str, DataFrame], country: str) -> DataFrame:
    return derive_money(build_core(cities, countries, series, country))


def coverage_matrix(wages: DataFrame, experience: DataFrame, postings: DataFrame, entity: str) -> DataFrame:
    """Entity by capability. Pay by basis counts only where the entity is comparable at all.

    wages: entity, comparable, depth, basis, ok (one row per basis). postings: entity, paid.
    """
    per = wages.groupBy(entity, "comparable", "depth").agg(
        *[F.max(F.when((F.col("basis") == b) & F.col("comparable"), F.col("ok"))).alias(f"ok_{b}") for b in ("regular_pay", "total_earnings")]
    )
    counts = postings.groupBy(entity).agg(F.count(F.lit(1)).alias("postings"), F.count_if("paid").alias("paid"))
    has = experience.select(entity).distinct().withColumn("experience", F.lit(True))
    out = per.join(has, entity, "left").join(counts, entity, "left")
    return out.select(
        entity, "comparable", "depth", "ok_regular_pay", "ok_total_earnings",
        F.coalesce("experience", F.lit(False)).alias("experience"),
        F.coalesce("postings", F.lit(0)).cast("long").alias("postings"),
        F.round(100 * F.try_divide("paid", "postings"), 1).alias("stated_pay_pct"),
    )


def coverage(entities: DataFrame, wages: DataFrame, gradient: DataFrame, absent: DataFrame, entity: str) -> DataFrame:
    """What works for each entity, on three axes that are reported apart, with the reason when not.

    wages: entity, comparable, reason, n_points. gradient and absent: entity (, reason).
    """
    w = wages.select(entity, "comparable", F.col("reason").alias("__why"), "n_points", F.lit(True).alias("__row"))
    g = gradient.select(entity).distinct().withColumn("__curve", F.lit(True))
    a = absent.select(entity, F.col("reason").alias("__absent"))
    d = entities.select(entity).join(w, entity, "left").join(g, entity, "left").join(a, entity, "left")
    ok = F.coalesce(F.col("comparable"), F.lit(False))
    spread = F.coalesce(F.col("n_points") >= 2, F.lit(False))
    return d.select(
        entity, ok.alias("occupation_ok"), spread.alias("spread_ok"), (ok & spread).alias("works"),
        (ok & spread & F.coalesce(F.col("__curve"), F.lit(False))).alias("personalised"),
        F.when(F.col("__row").isNull(), F.coalesce("__absent", F.lit("no wage source at all")))
        .when(~ok, F.col("__why")).when(~spread, "no spread to rank within").alias("reason"),
    )


def theme_table(series: DataFrame, theme: dict[str, Column], entity: str, year: str) -> DataFrame:
    """Series of one theme side by side: one row per (entity, year)."""
    return series.groupBy(entity, year).agg(*[F.max(c).alias(n) for n, c in theme.items()])


def pay_vs_cost(estimates: DataFrame, cities: DataFrame, country: str) -> DataFrame:
    """An estimate in place of the city's own salary, carried through to savings and stability."""
    joined = cities.join(estimates.select(country, F.col("estimate").alias("__pay")), country, "left")
    return derive_money(joined.withColumn("gross", F.coalesce("__pay", "gross")).drop("__pay"))


def manifest(datasets: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """One row per dataset: theme, kind, confidence, status, rows and whether it is empty."""
    sizes = facts.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    out = datasets.join(sizes, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))
    return out.withColumn("empty", F.col("rows") == 0)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def enrich(df: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """A chain of left look-ups on dimensions."""
    for dim, key in dims:
        df = df.join(dim, key, "left")
    return df


def rederive_pay(posts: DataFrame, classes: DataFrame, removable: DataFrame, key: str, wanted: str, min_publish: int = 30) -> DataFrame:
    """Published against de-duplicated against one-class medians, with the interval of the last.

    posts: id, title, key, value. classes: title, class. removable: id.
    """
    from paylens.operators.quantiles import group_median
    from paylens.operators.stats import median_ci

    kept = lookups.drop_members(posts, removable, "id")
    tagged = lookups.classes_back(kept, classes, "title", "class")
    only = tagged.filter(F.col("class") == wanted)
    published = group_median(posts, [key], "value", "published").withColumnRenamed("n", "n_published")
    deduped = kept.groupBy(key).agg(F.count("value").alias("n_after_dedupe"))
    ci = median_ci(only, [key], "value", min_n=5).withColumnRenamed("n", "n_class")
    out = published.join(deduped, key, "left").join(ci, key, "left")
    return out.withColumns(
        {
            "delta_pct": 100 * F.try_divide(F.col("median") - F.col("published"), F.col("published")),
            "publishable": F.coalesce(F.col("n_class") >= min_publish, F.lit(False)),
        }
    )
