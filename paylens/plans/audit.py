"""Whole-table audits built from the single statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.operators import dedupe, multivariate, quality, stats
from paylens.plans.postings import representativeness
from paylens.session import cut_lineage, let_go, written


def leaf_rows(df: DataFrame, key: Sequence[str], payload: str) -> DataFrame:
    """``path, value, v, numeric`` of every measured leaf, written once: the number in it, and whether its
    path is mostly numbers, at least twelve of them."""
    leaves = quality.measured(quality.flatten_leaves(df, key, payload))
    leaves = cut_lineage(leaves.select("path", "value", F.col("value").try_cast("double").alias("v")))
    kinds = leaves.groupBy("path").agg(((F.count("v") >= 12) & (F.count("v") >= 0.5 * F.count(F.lit(1)))).alias("numeric"))
    return leaves.join(kinds, "path")


def profile_documents(df: DataFrame, key: Sequence[str], payload: str) -> DataFrame:
    """Numeric profile of every measured path of JSON documents that is mostly numbers."""
    return stats.profile_numeric(leaf_rows(df, key, payload).filter("numeric"), ["path"], "v")


def profile_categories(df: DataFrame, key: Sequence[str], payload: str, min_n: int = 12) -> DataFrame:
    """``path, n, missing, cardinality, mode, mode_share_pct, singletons, rare`` of every measured path
    that is not mostly numbers. Values are counted once per path; the profile is made of the counts."""
    rows = leaf_rows(df, key, payload).filter("NOT numeric")
    counts = rows.groupBy("path", "value").agg(F.count(F.lit(1)).alias("k"))
    told = counts.groupBy("path").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("k"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("missing"),
        F.count("value").alias("cardinality"), F.max(F.when(F.col("value").isNotNull(), F.struct("k", "value"))).alias("top"), F.count_if((F.col("k") == 1) & F.col("value").isNotNull()).alias("singletons"),
    )
    rare = counts.filter("value IS NOT NULL").join(told.select("path", "n"), "path").groupBy("path").agg(F.count_if(F.col("k") < 0.01 * F.col("n")).alias("rare"))
    out = told.filter(F.col("n") >= min_n).join(rare, "path")
    return out.select("path", "n", "missing", "cardinality", F.col("top.value").alias("mode"), (100 * F.col("top.k") / F.col("n")).alias("mode_share_pct"), "singletons", "rare")


def measure(name: str, df: DataFrame, key: str | None, values: Sequence[str]) -> DataFrame:
    """Columns of a one-measurement-per-group table as (finding, key, measure, value)."""
    k = F.col(key).cast("string") if key else F.lit("all")
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")
    return df.select(F.lit(name).alias("finding"), k.alias("key"), rows).select("finding", "key", "m.measure", "m.value")


@dataclass(frozen=True)
class Evidence:
    """What an audit looks at besides postings and yearly series; findings without their rows are left out.

    ``pairs``: (group, x, y), the same thing from two sources. ``monthly``: (entity, t, value). ``homes``: (group, rent,
    price). ``features`` with ``columns``: rows of several positive measures, told apart by ``ids``. ``derived`` with
    ``graph``: columns and what each is derived from. ``expected``: (country, weight), shares that a panel should have.
    """

    pairs: DataFrame | None = None
    monthly: DataFrame | None = None
    homes: DataFrame | None = None
    features: DataFrame | None = None
    columns: Sequence[str] = ()
    ids: Sequence[str] = ()
    derived: DataFrame | None = None
    graph: Mapping[str, Sequence[str]] = field(default_factory=dict)
    expected: DataFrame | None = None


def growth(series: DataFrame) -> DataFrame:
    """Yearly growth of each entity between its first and its last year."""
    ends = series.filter("value IS NOT NULL").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("year").alias("first"), F.max("year").alias("last"), F.min_by("value", "year").alias("from"), F.max_by("value", "year").alias("to")
    )
    rate = F.when((F.col("from") > 0) & (F.col("to") > 0) & (F.col("last") > F.col("first")), 100 * (F.pow(F.col("to") / F.col("from"), 1.0 / (F.col("last") - F.col("first"))) - 1))
    return ends.withColumn("growth_pct", rate)


def _settled(parts: Sequence[DataFrame]) -> list[DataFrame]:
    """Findings so far as one written table, a row per measurement: one plan over all of them would fill the driver."""
    if len(parts) < 2:  # nothing has come since
        return list(parts)
    out = written(quality.union(parts))
    let_go(out.sparkSession)
    return [out]


def statistical_audit(posts: DataFrame, series: DataFrame, words: Sequence[str] = ("BUILDING", "MACHINERY"), more: Evidence | None = None) -> DataFrame:
    """Findings over postings (id, provider, company, country, title, pay, year) and a series
    (entity, year, value) in one long table (finding, key, measure, value). The postings are written
    once, with the columns that findings read."""
    e = more or Evidence()
    posts = written(posts.select("provider", "company", "country", "title", "pay", "year"))
    census = stats.keyword_census(posts, [], "title", words)
    parts = [
        measure("keyword_census", census, None, census.columns),
        measure("exact_duplicates", dedupe.exact_census(posts, ["title", "company", "country"]), None, ["groups", "rows_in_groups", "removable"]),
        measure("heaping", stats.digit_heaping(posts.withColumn("whole", F.floor("pay")), ["provider"], "whole"), "provider", ["n", "ends_in_0_or_5_pct", "ends_in_000_pct"]),
        measure("estimator_error", stats.estimator_error(posts, ["country"], "pay"), "country", ["n", "mean", "median", "mean_vs_median_pct", "skew"]),
        measure("benford", stats.benford(posts, ["provider"], "pay"), "provider", ["n", "mad", "orders"]),
        measure("hill", stats.hill(posts, ["country"], "pay"), "country", ["n", "alpha"]),
        measure("temporal_gap", stats.temporal_gap(posts, ["country"], "year", "pay"), "country", ["n", "gap_pct"]),
        measure("growth", growth(series), "entity", ["n", "growth_pct"]),
        measure("missingness", stats.missingness(posts, ["provider"], ["company", "country", "title", "pay"]).withColumn("key", F.concat_ws(".", "provider", "field")), "key", ["of", "missing"]),
    ]
    parts = _settled(parts)
    if e.monthly is not None:
        parts.append(measure("noise", stats.noise_test(e.monthly, ["entity"], "t", "value"), "entity", ["n", "residual_acf1", "residual_acf2", "change_acf1", "change_sd_pct"]))
    if e.pairs is not None:
        pairs = written(e.pairs)
        parts += [
            measure("agreement", stats.bland_altman(pairs, ["group"], "x", "y"), "group", ["n", "bias", "loa_lo", "loa_hi", "pearson_r"]),
            measure("deming", stats.deming(pairs, ["group"], "x", "y"), "group", ["n", "slope", "ols_slope"]),
            measure("ratio_outliers", stats.ratio_outliers(pairs, "x", "y").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("robust_z")).alias("largest_z")), "group", ["n", "largest_z"]),
        ]
    parts = _settled(parts)
    if e.homes is not None:
        homes = cut_lineage(e.homes)
        yields = stats.implied_yield(homes, ["group"], "rent", "price")
        # is the group of the highest median yield really above the others?
        top = yields.select(F.max_by("group", F.struct("median_yield", "group")).alias("g")).first()["g"]
        each = homes.filter("rent <> 0 AND price <> 0").withColumn("yield", 12 * F.col("rent") / (60 * F.col("price")))
        parts += [
            measure("implied_yield", yields, "group", ["n", "median_yield"]),
            measure("yield_test", stats.mann_whitney(each, F.col("group") == top, "yield").withColumn("key", F.lit(str(top))), "key", ["n1", "n2", "u", "z", "p"]),
        ]
    parts = _settled(parts)
    if e.features is not None:
        rows, cols = written(e.features), list(e.columns)
        parts += [
            measure("inflation", multivariate.vif(rows, cols), "feature", ["r2_on_others", "vif"]),
            measure("components", multivariate.pca_dims(rows, cols), "component", ["variance", "cumulative"]),
            measure("votes", multivariate.mv_census(multivariate.mv_verdicts(rows, cols, list(e.ids) or None)), None, ["n", "left_out", "far_n", "isolated_n", "alone_n", "by_all_n", "by_any_n", "flagged_n"]),
        ]
    parts = _settled(parts)
    if e.derived is not None:
        links = stats.lineage(e.derived, e.graph, e.derived.columns)
        parts.append(measure("lineage", links.withColumn("key", F.concat_ws("<-", "derived", "input")), "key", ["r"]))
    if e.expected is not None:
        panel = posts.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
        parts.append(measure("representativeness", representativeness(panel, e.expected, "country"), "country", ["n", "representativeness"]))
    return quality.union(parts)
