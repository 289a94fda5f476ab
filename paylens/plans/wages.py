"""Wage observations brought to one basis, period and currency, with the reasons when not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions import money
from paylens.operators import crosswalk, lookups

FIELDS = ("mean", "median", "p10", "p25", "p75", "p90")
BASES = ("regular_pay", "total_earnings")
# What must be taken out of a figure that holds everything.
TAKEN_OUT = {
    "total_earnings": ("employer_social_contributions",),
    "regular_pay": ("employer_social_contributions", "irregular_bonus"),
}
_VALUES = ",".join(f"{f}:double" for f in FIELDS)
FIGURES_TYPE = f"struct<ok:boolean,reason:string,chain:{money.CHAIN_TYPE},{_VALUES}>"

OBSERVATION_SCHEMA = (
    "country string, source_id string, national_code string, year int, period string, currency string, "
    "mean double, median double, p10 double, p25 double, p75 double, p90 double, "
    "n_employees double, distribution string"
)


def classify_distribution(col: Callable[[str], Column]) -> Column:
    """What spread a source publishes."""
    return (
        F.when(col("p10").isNotNull() & col("p90").isNotNull(), "full")
        .when(col("p25").isNotNull() & col("p75").isNotNull(), "quartile-only")
        .when(col("median").isNotNull(), "central-tendency-only")
        .otherwise("mean-only")
    )


def figures(values: dict[str, Column], chain: Column) -> Column:
    return F.struct(
        F.lit(True).alias("ok"),
        F.lit(None).cast("string").alias("reason"),
        chain.cast(money.CHAIN_TYPE).alias("chain"),
        *[values[f].cast("double").alias(f) for f in FIELDS],
    )


def no_figures(reason: Column) -> Column:
    return F.struct(
        F.lit(False).alias("ok"),
        reason.alias("reason"),
        F.array().cast(money.CHAIN_TYPE).alias("chain"),
        *[F.lit(None).cast("double").alias(f) for f in FIELDS],
    )


def per_field(
    df: DataFrame, source: str, target: str, result: Callable[[Column], Column], value: Callable[[str, Column], Column]
) -> DataFrame:
    """Convert every field of a figures struct. ``result`` converts the shown field (the median,
    else the mean, else the first there is) and decides on refusal and chain; ``value`` gives
    the number of each field, null where that field alone cannot be converted."""
    src = F.col(source)
    shown = F.coalesce(*[src[f] for f in ("median", "mean", "p10", "p25", "p75", "p90")])
    out = df.withColumn(f"__{target}", F.when(src["ok"] & shown.isNotNull(), result(shown)))
    res = F.col(f"__{target}")
    done = (
        F.when(~src["ok"], src)
        .when(res.isNull(), no_figures(F.lit("no figure published")))
        .when(res["ok"], figures({f: value(f, src[f]) for f in FIELDS}, F.concat(src["chain"], res["chain"])))
        .otherwise(no_figures(res["reason"]))
    )
    return out.withColumn(target, done).drop(f"__{target}")


def figure_for_basis(df: DataFrame, basis: str, target: str) -> DataFrame:
    """Figures on one basis, by the first way that is open: the source publishes the basis
    apart (``split_<basis>`` struct), its composition already is that basis, or every part to
    be taken out is published by the source itself. Otherwise refused.

    Needs columns FIELDS, ``split_regular_pay``/``split_total_earnings`` (structs, null when not
    split), ``expressible`` (array of bases), ``published`` (array) and ``part_<component>``.
    """
    split = F.col(f"split_{basis}")
    parts = TAKEN_OUT[basis]
    listed = F.lit(True)
    taken = F.lit(0.0)
    mentions = lambda part: F.exists(F.coalesce("published", F.array().cast("array<string>")), lambda x: x.contains(part))
    for p in parts:
        listed = listed & mentions(p)
        listed = listed & F.col(f"part_{p}").isNotNull()
        taken = taken + F.coalesce(F.col(f"part_{p}"), F.lit(0.0))
    native = {f: F.col(f) for f in FIELDS}
    shown = F.coalesce("median", "mean")
    steps = F.array(
        *[money.step("subtract", F.concat(F.lit(f"{p} "), money.amount(F.col(f"part_{p}")))) for p in parts],
        money.step("assumption", F.lit("the same amount is taken out at every percentile")),
    )
    return df.withColumn(
        target,
        F.when(
            split.isNotNull(),
            figures({f: split[f] for f in FIELDS}, F.array(money.step("native_basis_select", F.lit(basis)))),
        )
        .when(F.array_contains("expressible", basis), figures(native, F.array(money.step("native", F.lit(basis)))))
        .when(listed & shown.isNotNull(), figures({f: F.col(f) - taken for f in FIELDS}, steps))
        .otherwise(no_figures(F.lit(f"source cannot express {basis}"))),
    )


def resolve(df: DataFrame) -> DataFrame:
    """The four results of every observation: {native, usd} x {regular_pay, total_earnings}.

    Needs the columns of :func:`figure_for_basis` plus country, year, period, currency,
    ``hours`` (per week, null when not sourced) and ``rate`` (null when the year has none);
    ``hours_<field>`` columns, when present, are hours published for that field alone.
    """
    combos = []
    for basis in BASES:
        df = figure_for_basis(df, basis, f"__{basis}")
        df = per_field(
            df, f"__{basis}", f"__y_{basis}",
            lambda v: money.annualise(v, F.col("period"), F.col("hours"), F.col("country")),
            lambda f, v: money.yearly_value(v, F.col("period"), F.coalesce(F.col(f"hours_{f}"), F.col("hours")) if f"hours_{f}" in df.columns else F.col("hours")),
        )
        df = per_field(
            df, f"__y_{basis}", f"__u_{basis}",
            lambda v: money.convert_at(v, F.col("rate"), F.col("country"), F.col("year")),
            lambda f, v: v / F.col("rate"),
        )
        combos += [
            F.struct(F.lit("native").alias("mode"), F.lit(basis).alias("basis"), F.col("currency").alias("in"), F.col(f"__y_{basis}").alias("r")),
            F.struct(F.lit("usd").alias("mode"), F.lit(basis).alias("basis"), F.lit("USD").alias("in"), F.col(f"__u_{basis}").alias("r")),
        ]
    keep = ["country", "source_id", "national_code", "year"]
    keep = [c for c in keep if c in df.columns]
    return df.select(*keep, F.explode(F.array(*combos)).alias("c")).select(
        *keep, "c.mode", "c.basis", F.col("c.in").alias("currency"), "c.r.*"
    )


def extract(source: DataFrame, spec: dict) -> DataFrame:
    """One source's rows in the common observation schema.

    ``spec``: source_id, country, period, currency, code (column or literal), year, and the
    column of every published field; a field that is not named stays null.
    """
    get = lambda name: F.col(spec[name]) if spec.get(name) else F.lit(None)
    out = source.select(
        F.lit(spec["country"]).alias("country"),
        F.lit(spec["source_id"]).alias("source_id"),
        F.col(spec["code"]).cast("string").alias("national_code"),
        F.col(spec["year"]).cast("int").alias("year"),
        F.lit(spec["period"]).alias("period"),
        F.lit(spec["currency"]).alias("currency"),
        *[get(f).cast("double").alias(f) for f in FIELDS],
        get("n_employees").cast("double").alias("n_employees"),
    )
    return out.withColumn("distribution", classify_distribution(F.col))


# Unit suffix, period and currency of every source's published fields.
SOURCES = {
    "salary_se": ("SE", "month", "SEK", "sek_month"),
    "salary_dk": ("DK", "hour", "DKK", "std_dkk_hour"),
    "salary_no": ("NO", "month", "NOK", "nok_month"),
    "salary_fi": ("FI", "month", "EUR", "eur_month"),
    "salary_de": ("DE", "year", "EUR", "eur_year"),
    "salary_es": ("ES", "year", "EUR", "eur_year"),
    "salary_uk": ("GB", "year", "GBP", "gbp_year"),
    "salary_ca": ("CA", "hour", "CAD", "cad_hour"),
    "bls_oews": ("US", "year", "USD", "usd"),
    "salary_au": ("AU", "year", "AUD", "aud_year"),
    "salary_nl": ("NL", "hour", "EUR", "eur_hour"),
    "salary_ie": ("IE", "hour", "EUR", "eur_hour"),
    "salary_qa": ("QA", "month", "QAR", "qar_month"),
    "salary_ae": ("AE", "month", "AED", "aed_month"),
}
# Field names that depart from <statistic>_<unit>.
FIELD_NAMES = {
    "salary_ca": {"mean": "average_cad_hour", "p10": "p10_low_cad_hour", "p25": "p25_q1_cad_hour",
                  "p75": "p75_q3_cad_hour", "p90": "p90_high_cad_hour"},
    "salary_fi": {f: f"regular_{f}_eur_month" for f in ("mean", "median", "p10", "p90")},
    "bls_oews": {f: f"annual_{f}_usd" for f in FIELDS},
    "salary_ae": {"mean": "monthly_average_wage_aed"},
    "salary_qa": {"mean": "weighted_mean_qar_month"},
}


def extract_source(source: DataFrame, source_id: str, code: str = "national_code", year: str = "year") -> DataFrame:
    """Extractor of a known source: exact field names only, missing ones null."""
    country, period, currency, unit = SOURCES[source_id]
    names = FIELD_NAMES.get(source_id, {})
    columns = {f: names.get(f, f"{f}_{unit}") for f in FIELDS}
    spec = {"source_id": source_id, "country": country, "period": period, "currency": currency, "code": code, "year": year}
    spec.update({f: c for f, c in columns.items() if c in source.columns})
    if "n_employees" in source.columns:
        spec["n_employees"] = "n_employees"
    rows = lookups.latest(source, [code], year, [c for c in source.columns if c not in (code, year)])
    return extract(rows, spec)


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean weighted by published counts; null when a value or all weights are missing."""
    complete = F.count_if(F.col(value).isNull()) == 0
    w = F.coalesce(F.col(weight), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.when(complete, F.try_divide(F.sum(F.col(value) * w), F.sum(w))).alias("weighted_mean"),
        F.sum(w).alias("weight"),
    )


def build_wages(observations: DataFrame, composition: DataFrame, fx: DataFrame, hours: DataFrame, mappings: DataFrame, reference_key: str) -> tuple[DataFrame, DataFrame]:
    """(figures, verdicts): the four results per observation and each row's place in the set.

    composition: source_id, irregular_bonus, employer_social_contributions, published,
    part_* and split_* columns. mappings: country, national_code, shared_key.
    """
    obs = observations.join(composition, "source_id", "left")
    obs = obs.withColumn(
        "expressible", money.bases(F.col("source_id"), F.col("irregular_bonus"), F.col("employer_social_contributions"))
    )
    obs = lookups.exact_lookup(obs, fx, ["country", "year"], "rate")
    obs = lookups.year_or_latest(obs, hours, "country", "year", "hours", "hours_year")
    table = resolve(obs)
    verdicts = observations.select("country", "national_code").join(mappings, ["country", "national_code"], "left")
    verdicts = verdicts.withColumn(
        "verdict", crosswalk.compare(F.lit(reference_key), F.col("shared_key"), F.lit("reference"), F.col("country"))
    )
    verdicts = verdicts.withColumn("own_depth", F.col("verdict.depth")).withColumn("label", F.concat_ws("-", "country", "national_code"))
    verdicts = crosswalk.resolve_set(verdicts.withColumn("__all", F.lit(1)), ["__all"], "label", "country", "own_depth").drop("__all")
    return table, verdicts


def absent_rows(spark, reasons: dict[str, str]) -> DataFrame:
    """Countries that publish no such series, with the reason."""
    return spark.createDataFrame(list(reasons.items()), "country string, reason string")


def with_absent(table: DataFrame, absent: DataFrame) -> DataFrame:
    """``country, reason, published``: the countries of a wage table, and the absent ones (country, reason) that it does not have."""
    there = table.select("country").distinct()
    listed = there.select("country", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("published"))
    return listed.unionByName(absent.join(there, "country", "left_anti").select("country", "reason", F.lit(False).alias("published")))


# ---------------------------------------------------------------- experience

CAREER_START_AGE = 22


def premium_curve(bands: DataFrame, entity: str, band: str, value: str, total_band: str) -> DataFrame:
    """Premium of each band over the total row of the same table, in percent, two decimals."""
    total = bands.filter(F.col(band) == total_band).select(entity, F.col(value).alias("__total"))
    out = bands.filter(F.col(band) != total_band).join(total, entity)
    return out.withColumn("premium_pct", F.round((F.try_divide(F.col(value), F.col("__total")) - 1) * 100, 2)).drop("__total")


def known_points(col: Callable[[str], Column]) -> Column:
    """Published (percentile, value) points of one row, in order of value."""
    pairs = (("p10", 10.0), ("p25", 25.0), ("median", 50.0), ("p75", 75.0), ("p90", 90.0))
    pts = [F.when(col(f).isNotNull(), F.struct(col(f).alias("value"), F.lit(p).alias("pct"))) for f, p in pairs]
    return F.array_sort(F.array_compact(F.array(*pts)))


def rank_within(value: Column, points: Column) -> Column:
    """Percentile of a value among known points, linear between neighbours, held at the ends.

    struct(pct, clamped); null with fewer than two points.
    """
    lo = F.get(points, F.lit(0))
    hi = F.get(points, F.size(points) - 1)
    below = F.filter(points, lambda p: p["value"] <= value)
    a = F.get(below, F.size(below) - 1)
    b = F.get(F.filter(points, lambda p: p["value"] >= value), F.lit(0))
    inside = F.when(b["value"] == a["value"], F.get(F.filter(points, lambda p: p["value"] == value), F.lit(0))["pct"]).otherwise(
        a["pct"] + (value - a["value"]) / (b["value"] - a["value"]) * (b["pct"] - a["pct"])
    )
    none = F.lit(None).cast("string")
    return F.when(
        (F.size(points) >= 2) & value.isNotNull(),
        F.when(value <= lo["value"], F.struct(lo["pct"].alias("pct"), F.when(value < lo["value"], "low").alias("clamped")))
        .when(value >= hi["value"], F.struct(hi["pct"].alias("pct"), F.when(value > hi["value"], "high").alias("clamped")))
        .otherwise(F.struct(inside.alias("pct"), none.alias("clamped"))),
    )


def position_and_estimate(rows: DataFrame, curves: DataFrame, entity: str, years: str) -> DataFrame:
    """Estimate (central figure moved by the entity's own premium, held inside the published
    points) and percentile position. Needs FIELDS, ``comparable`` and ``premium_basis``;
    ``curves`` has entity, age_midpoint, premium_pct.

    The premium is rounded to one decimal before it is used, so shown numbers multiply out.
    """
    df = rows.withColumn("assumed_age", (F.col(years) + CAREER_START_AGE).cast("double"))
    df = lookups.curve_lookup(df, curves, [entity], "assumed_age", "age_midpoint", "premium_pct", "__raw")
    df = df.withColumn("premium", F.floor(F.col("__raw") * 10 + 0.5) / 10).withColumnRenamed("clamped", "age_clamped")
    central = F.when(
        F.col("premium").isNotNull() & (F.col("premium_basis") == "mean"), F.coalesce("mean", "median")
    ).otherwise(F.coalesce("median", "mean"))
    df = df.withColumn("points", known_points(F.col)).withColumn("central", central)
    df = df.withColumn("shifted", F.when(F.col("premium").isNotNull(), F.col("central") * (1 + F.col("premium") / 100)))
    lo, hi = F.get("points", F.lit(0)), F.get("points", F.size("points") - 1)
    usable = F.col("comparable") & (F.size("points") >= 2)
    rank = rank_within(F.col("shifted"), F.col("points"))
    return df.select(
        *rows.columns,
        "premium",
        F.when(
            usable,
            F.when(F.col("shifted").isNull(), F.col("central")).otherwise(F.greatest(lo["value"], F.least(hi["value"], F.col("shifted")))),
        ).alias("estimate"),
        F.when(usable, F.coalesce(rank["pct"], F.lit(50.0))).alias("position"),
        F.when(usable, F.col("shifted").isNotNull()).alias("personalised"),
        F.when(usable, rank["clamped"]).alias("clamped"),
        F.when(~F.col("comparable"), "not comparable").when(F.size("points") < 2, "no spread to place within").alias("reason"),
    )


def experience_gradient(bands: DataFrame, entity: str, band: str, value: str, total_band: str, midpoint: str) -> DataFrame:
    """Premium curve per entity with a flag where it falls back from one band to the next."""
    from pyspark.sql import Window

    curve = premium_curve(bands, entity, band, value, total_band)
    before = F.lag("premium_pct").over(Window.partitionBy(entity).orderBy(midpoint))
    return curve.withColumn("falls", F.coalesce(F.col("premium_pct") < before - 0.01, F.lit(False)))
