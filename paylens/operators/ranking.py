"""Derived money, composites, ranks, limits and samples over places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOME_M2 = 90
# One published step of 10 on each of two monthly amounts, over a year.
SAVINGS_STEP = 12 * 10 * 2
STABILITY_TOLERANCE = 0.25


def missing_inputs(named: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in named.items()]))


def ratio_stability(num: Column, den: Column, step: float = SAVINGS_STEP, tol: float = STABILITY_TOLERANCE) -> Column:
    """Whether num/den outlives one step of its denominator's own precision, null without a ratio."""
    base = num / F.nullif(den, F.lit(0.0))
    moved = lambda d: (den + d <= 0) | (F.abs(num / F.nullif(den + d, F.lit(0.0)) - base) / base > tol)
    shaky = F.coalesce(moved(step), F.lit(True)) | F.coalesce(moved(-step), F.lit(True))
    return F.when((den > 0) & num.isNotNull(), F.when(shaky, "unstable").otherwise("stable"))


def derive_money(df: DataFrame, budget: dict[str, float] | None = None) -> DataFrame:
    """Net, savings, years to a home and m2 a year, with the inputs that were missing.

    Needs gross, net_pct, rent, living, price_m2. ``budget`` may hold rent, living, salary
    (amounts) or rent_factor, living_factor.
    """
    b = budget or {}
    pick = lambda name: F.lit(float(b[name])) if b.get(name) is not None else F.col({"salary": "gross"}.get(name, name)) * b.get(f"{name}_factor", 1.0)
    gross, rent, living = pick("salary"), pick("rent"), pick("living")
    out = df.withColumns({"gross": gross, "rent": rent, "living": living})
    out = out.withColumn("net", F.col("gross") * F.col("net_pct") / 100)
    out = out.withColumn("savings", F.col("net") - 12 * (F.col("rent") + F.col("living")))
    s, price = F.col("savings"), F.col("price_m2")
    return out.withColumns(
        {
            "years_to_home": F.when(s > 0, HOME_M2 * price / F.nullif(s, F.lit(0.0))),
            "m2_per_year": F.when(s.isNotNull(), F.greatest(s, F.lit(0.0)) / F.nullif(price, F.lit(0.0))),
            "stability": ratio_stability(HOME_M2 * price, s),
            "never": (s <= 0) & price.isNotNull(),
            "missing_inputs": missing_inputs(
                {"salary": F.col("gross"), "tax rate": F.col("net_pct"), "rent": F.col("rent"), "living costs": F.col("living"), "apartment price": price}
            ),
        }
    )


def by_lens(lens: Column) -> Column:
    return F.when(lens == "gross", F.col("gross")).when(lens == "net", F.col("net")).otherwise(F.col("savings"))


def vs_average(value: Column, average: Column) -> Column:
    return F.when(average > 0, value / F.nullif(average, F.lit(0.0)))


def budget_split(net: Column, rent: Column, living: Column) -> dict[str, Column]:
    """Monthly net laid out: left over, and the shares of the larger of income and spending."""
    known = net.isNotNull() & (rent + living).isNotNull()  # greatest() skips nulls
    whole = F.when(known, F.greatest(net, rent + living))
    return {
        "left_over": F.when(known, F.greatest(F.lit(0.0), net - rent - living)),
        "rent_share": F.try_divide(rent, whole),
        "living_share": F.try_divide(living, whole),
    }


def months_old(as_of: Column, today: str) -> Column:
    """Whole months between ``YYYY[-MM]`` and today (``YYYY-MM-DD``)."""
    y, m = int(today[:4]), int(today[5:7])
    parts = F.split(as_of, "-")
    year, month = F.get(parts, F.lit(0)).try_cast("int"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(1))
    return (F.lit(y) - year) * 12 + (F.lit(m) - month)


def is_stale(as_of: Column, today: str, limit: Column) -> Column:
    return F.coalesce(months_old(as_of, today) > limit, F.lit(False))


def metric_long(df: DataFrame, key: Sequence[str], registry: dict[str, dict]) -> DataFrame:
    """One row per (place, metric) with direction, theme and confidence of the metric."""
    rows = [
        F.struct(
            F.lit(name).alias("metric"), spec["value"].cast("double").alias("value"), F.lit(spec["direction"]).alias("direction"),
            F.lit(spec["theme"]).alias("theme"), F.lit(spec["confidence"]).alias("confidence"),
        )
        for name, spec in registry.items()
    ]
    return df.select(*key, F.explode(F.array(*rows)).alias("m")).select(*key, "m.*")


def composite(long: DataFrame, key: Sequence[str], weights: dict[str, float], unstable: str | None = None) -> DataFrame:
    """Weighted score of min-max normalised metrics.

    The weight of a missing metric goes to the present ones; rows marked ``unstable`` are scored
    but do not set the range; a metric without a range counts as missing.
    """
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    d = long.withColumn("weight", F.try_element_at(weight, F.col("metric"))).filter("weight > 0")
    sets_range = F.when(F.coalesce(~F.col(unstable), F.lit(True)), F.col("value")) if unstable else F.col("value")
    span = F.broadcast(d.groupBy("metric").agg(F.min(sets_range).alias("lo"), F.max(sets_range).alias("hi")))  # one row per weighted metric
    t = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    scored = d.join(span, "metric").withColumn("score", F.when(F.col("direction") == "higher", t).otherwise(1 - t))
    has = F.col("score").isNotNull()
    return scored.groupBy(*key).agg(
        F.try_divide(F.sum(F.when(has, F.col("score") * F.col("weight"))), F.sum(F.when(has, F.col("weight")))).alias("score"),
        F.coalesce(F.sum(F.when(has, F.col("weight"))), F.lit(0.0)).alias("used_weight"),
        F.coalesce(F.sum(F.when(~has, F.col("weight"))), F.lit(0.0)).alias("missing_weight"),
        F.array_sort(F.collect_list(F.when(~has, F.col("metric")))).alias("missing"),  # at most one entry per weighted metric
    )


#: Rows that each view shows.
SHOWN = {"list": 500, "compare": 15, "summary": 12}


def shown(df: DataFrame, view: str, *order: Column | str) -> DataFrame:
    """The first rows that a view shows, in a whole order."""
    return df.orderBy(*order).limit(SHOWN[view])


def climate_match(df: DataFrame, winter: float | None, summer: float | None, sun: bool) -> DataFrame:
    """Match of a climate with what is asked for: one minus the mean penalty of the usable wishes.

    Needs monthly (array of struct(low, high)), winter_low, summer_high, sunshine.
    """
    full = F.size("monthly") == 12
    low = F.when(full, F.array_min(F.transform("monthly", lambda m: m["low"]))).otherwise(F.col("winter_low"))
    high = F.when(full, F.array_max(F.transform("monthly", lambda m: m["high"]))).otherwise(F.col("summer_high"))
    most = F.broadcast(df.agg(F.max("sunshine").alias("__sun")))  # one row
    out = df.join(most).withColumns({"low": low, "high": high})
    wishes = []
    if winter is not None:
        wishes.append(("winter low", F.col("low"), F.greatest(F.lit(0.0), F.lit(float(winter)) - F.col("low")) / 25))
    if summer is not None:
        wishes.append(("summer high", F.col("high"), F.greatest(F.lit(0.0), F.col("high") - F.lit(float(summer))) / 25))
    if sun:
        wishes.append(("sunshine", F.col("sunshine"), 1 - F.try_divide("sunshine", "__sun")))
    used = sum((c.isNotNull().cast("int") for _, c, _ in wishes), F.lit(0))
    penalty = sum((F.coalesce(F.when(c.isNotNull(), p), F.lit(0.0)) for _, c, p in wishes), F.lit(0.0))
    return out.withColumns(
        {"match": F.when(used > 0, F.greatest(F.lit(0.0), 1 - penalty / F.nullif(used, F.lit(0)))), "missing": missing_inputs({n: c for n, c, _ in wishes})}
    ).drop("__sun")


def order_nulls_last(df: DataFrame, col: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(col).asc_nulls_last(), *ties)


def order_comparable(df: DataFrame, median: str, mean: str, name: str, one_currency: bool) -> DataFrame:
    """By pay where one currency makes sizes comparable, else by name."""
    return df.orderBy(F.coalesce(median, mean).desc_nulls_last(), name) if one_currency else df.orderBy(name)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group; the rank filter runs before the exchange, so hot groups shrink map-side."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank_of(df: DataFrame, period: str, rank: str, entity: str, members: DataFrame | None = None) -> DataFrame:
    """Rank N of M, M taken over all entities of the period before any of them is dropped."""
    of = df.groupBy(period).agg(F.max(rank).alias("ranked_of"))
    kept = df.join(members.select(entity), entity, "left_semi") if members is not None else df
    return kept.join(of, period)


def probe_order(candidates: DataFrame, token: str, pos: str, cached: str, verified: str, max_new: int) -> DataFrame:
    """Three buckets that never overlap: cached, verified before, new; only the new one is limited."""
    bucket = F.when(F.col(cached), 1).when(F.col(verified), 2).otherwise(3)
    d = candidates.withColumn("bucket", bucket)
    new = d.filter("bucket = 3").orderBy(pos, token).limit(max_new)
    return d.filter("bucket < 3").unionByName(new)


def stratified_sample(df: DataFrame, strata: str, value: str, quota: int, seed: int) -> DataFrame:
    """A fixed number of distinct values per stratum, chosen by a hash so that a re-run chooses the same."""
    distinct = df.select(strata, value).distinct()
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(value).cast("string")))
    return top_k(distinct.withColumn("__h", h), [strata], [F.col("__h"), F.col(value)], quota).drop("__h", "rank")


def search_names(df: DataFrame, name: str, q: str, k: int) -> DataFrame:
    return df.filter(F.contains(F.lower(name), F.lit(q.strip().lower()))).orderBy(name).limit(k)


def search_places(df: DataFrame, place: str, country: str, q: str) -> DataFrame:
    """Places whose own or whose country's name holds the text (from two letters on), numbered
    inside their country; countries without a hit do not appear."""
    q = q.strip().lower()
    hit = F.contains(F.lower(place), F.lit(q)) | F.contains(F.lower(country), F.lit(q)) if len(q) >= 2 else F.lit(True)
    return df.filter(hit)


def origins(df: DataFrame, origin: str, value: str, k: int, q: str = "") -> DataFrame:
    """The ``k`` largest origins, or largest of those matching a text, with their share of the largest."""
    top = F.broadcast(df.agg(F.greatest(F.max(value), F.lit(1.0)).alias("__max")))  # one row
    shown = df.filter(F.contains(F.lower(origin), F.lit(q.lower()))) if len(q) > 1 else df
    shown = shown.orderBy(F.desc(value), origin).limit(k)
    return shown.join(top).withColumn("share_of_max", F.col(value) / F.col("__max")).drop("__max")


def rule_chips(citizenship_years: Column, dual: Column, tuition: Column, friction: Column) -> Column:
    """Up to three labels of a country's rules, in a fixed order."""
    labels = F.array(
        F.when(citizenship_years.isNull(), "no_citizenship").when(F.coalesce(dual, F.lit(False)), "citizenship_dual").otherwise("citizenship"),
        F.when(tuition == 0, "free_tuition").when(tuition > 30000, "high_tuition"),
        F.when(friction == "high", "extra_checks"),
    )
    return F.slice(F.array_compact(labels), 1, 3)


def residency_order(df: DataFrame, years: str, name: str) -> DataFrame:
    """Countries by years to residency, those without a path after all others."""
    return df.withColumn("no_path", F.col(years).isNull()).orderBy(F.coalesce(F.col(years), F.lit(999)), name)


def thresholds(df: DataFrame, amount: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(with a threshold, ascending; without one)."""
    return df.filter(F.col(amount).isNotNull()).orderBy(amount, name), df.filter(F.col(amount).isNull())


def axis_years(v: Column) -> Column:
    """Position on the years axis: linear to 30, compressed to 130, then held; kept inside 2..97."""
    x = F.when(v >= 130, 95.0).when(v <= 30, 4 + (v - 2) / 28 * 70).otherwise(74 + (v - 30) / 100 * 18)
    return F.greatest(F.lit(2.0), F.least(F.lit(97.0), x))


def compare_view(long: DataFrame, place: str, places: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics as rows, places as columns, with the best place of each row and the widths
    relative to the row's largest value."""
    places = list(places)
    d = long.filter(F.col(place).isin(*places) & F.col("metric").isin(*metrics))
    best = d.groupBy("metric").agg(
        F.max("value").alias("row_max"),
        F.when(F.first("direction") == "higher", F.max_by(place, F.struct("value", place))).otherwise(F.min_by(place, F.struct("value", place))).alias("best"),
    )
    wide = d.groupBy("metric").pivot(place, places).agg(F.first("value"))
    return wide.join(best, "metric")
