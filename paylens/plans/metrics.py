"""The metric registry: every metric of a place as data, compiled to one projection.

A metric is an SQL expression over the columns of a place or over other metrics, with the way it
points, its theme, its unit and how sure its source is. Metrics that need others come after them,
in as few steps as the depth of that order asks for, so the table of places is read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGHER, LOWER, NEUTRAL = "higher", "lower", "neutral"
#: Years of savings are told for a home of this many square metres.
HOME_M2 = 90


@dataclass(frozen=True)
class Metric:
    """``needs`` names the other metrics that ``value`` reads; what else it reads are columns of the place."""

    key: str
    theme: str
    direction: str
    confidence: str
    unit: str
    value: str
    needs: tuple[str, ...] = ()


# The published metrics with their theme, direction and kind of source.
METRICS = (
    Metric("salary_gross", "money", HIGHER, "crowd", "usd/year", "gross"),
    Metric("salary_top_employers", "money", HIGHER, "crowd", "usd/year", "employer_pay"),
    Metric("salary_net", "money", HIGHER, "official", "usd/year", "salary_gross * net_pct / 100", ("salary_gross",)),
    Metric("savings", "money", HIGHER, "crowd", "usd/year", "salary_net - 12 * total_monthly", ("salary_net", "total_monthly")),
    Metric("net_pct", "money", HIGHER, "official", "percent", "net_pct"),
    Metric("pr_years", "visa", LOWER, "official", "years", "pr_years"),
    Metric("citizenship_years", "visa", LOWER, "official", "years", "citizenship_years"),
    Metric("tuition", "visa", LOWER, "official", "usd/year", "tuition"),
    Metric("post_study_months", "visa", HIGHER, "official", "months", "post_study_months"),
    Metric("ict_specialists", "jobs", HIGHER, "official", "thousands", "ict_thousands"),
    Metric("ict_share", "jobs", HIGHER, "official", "percent", "ict_share"),
    Metric("rent_outside", "housing", LOWER, "crowd", "usd/month", "rent"),
    Metric("rent_centre", "housing", LOWER, "crowd", "usd/month", "rent_centre"),
    Metric("living_costs", "housing", LOWER, "crowd", "usd/month", "living"),
    Metric("total_monthly", "housing", LOWER, "crowd", "usd/month", "rent_outside + living_costs", ("rent_outside", "living_costs")),
    Metric("apt_m2", "housing", LOWER, "crowd", "usd/m2", "price_m2"),
    Metric("years_to_home", "housing", LOWER, "crowd", "years", f"CASE WHEN savings > 0 THEN {HOME_M2} * apt_m2 / savings END", ("savings", "apt_m2")),
    Metric("m2_per_year", "housing", HIGHER, "crowd", "m2", "CASE WHEN savings IS NOT NULL AND apt_m2 > 0 THEN greatest(savings, 0) / apt_m2 END", ("savings", "apt_m2")),
    Metric("foreign_born", "people", NEUTRAL, "official", "percent", "foreign_born_share"),
    Metric("own_diaspora", "people", NEUTRAL, "official", "people", "diaspora"),
    Metric("english_work", "people", HIGHER, "official", "grade", "CASE english_work WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END"),
    Metric("happiness_rank", "life", LOWER, "index", "rank", "coalesce(happiness_rank, happiness_rank_old)"),
    Metric("peace_rank", "life", LOWER, "index", "rank", "peace_rank"),
    Metric("healthcare", "life", HIGHER, "crowd", "index", "healthcare"),
    Metric("hdi", "life", HIGHER, "index", "index", "hdi"),
    Metric("sunshine", "climate", HIGHER, "official", "hours/year", "sunshine"),
    Metric("summer_high", "climate", NEUTRAL, "official", "celsius", "summer_high"),
    Metric("winter_low", "climate", NEUTRAL, "official", "celsius", "winter_low"),
    Metric("rainy_days", "climate", LOWER, "official", "days/year", "rainy_days"),
    Metric("travel_hours", "climate", LOWER, "index", "hours", "travel_hours"),
)


def in_steps(metrics: Sequence[Metric]) -> list[list[Metric]]:
    """Metrics in steps: each needs only metrics of earlier steps. A circle or a missing metric is an error."""
    left, known, steps = list(metrics), set(), []
    while left:
        now = [m for m in left if known.issuperset(m.needs)]
        if not now:
            raise ValueError(f"metrics that wait for each other or for what is not there: {sorted(m.key for m in left)}")
        steps.append(now)
        known |= {m.key for m in now}
        left = [m for m in left if m.key not in known]
    return steps


def with_metrics(places: DataFrame, metrics: Sequence[Metric] = METRICS, prefix: str = "metric_") -> DataFrame:
    """``places`` with one column per metric; a metric whose inputs are missing is null.

    Metrics may be named as columns are, so they are kept under ``prefix`` and read by their own names
    only where a metric needs them.
    """
    out, columns = places, {c.lower() for c in places.columns}
    for step in in_steps(metrics):
        new = {}
        for m in step:
            given = {n: f"{prefix}{n}" for n in m.needs}
            new[f"{prefix}{m.key}"] = F.expr(_named(m.value, given)).cast("double")
        if clash := columns & {n.lower() for n in new}:
            raise ValueError(f"columns of the places have the names of metrics: {sorted(clash)}")
        out = out.withColumns(new)
    return out


def _named(value: str, names: dict[str, str]) -> str:
    """An expression in which the metrics it needs go by their columns' names."""
    import re

    return re.sub(r"\b[a-z_][a-z0-9_]*\b", lambda m: names.get(m.group(), m.group()), value)


def metric_rows(places: DataFrame, key: Sequence[str], metrics: Sequence[Metric] = METRICS) -> DataFrame:
    """One row per place and metric: ``key, metric, value, direction, theme, confidence, unit``."""
    told = with_metrics(places, metrics)
    rows = [
        F.struct(F.lit(m.key).alias("metric"), F.col(f"metric_{m.key}").alias("value"), *[F.lit(getattr(m, c)).alias(c) for c in ("direction", "theme", "confidence", "unit")])
        for m in metrics
    ]
    return told.select(*key, F.explode(F.array(*rows)).alias("m")).select(*key, "m.*")


def by_theme(theme: str, metrics: Sequence[Metric] = METRICS) -> list[Metric]:
    return [m for m in metrics if m.theme == theme]
