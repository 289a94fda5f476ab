"""Data-quality rules. Each returns findings and changes nothing.

A finding is (rule, severity, entity, field, observed, bound, detail); severity is one of
error, drop, flag, warn. Wage tables are read in long form, one row per
(entity, statistic), made by :func:`unpivot_wages`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions import text
from paylens.operators.quantiles import group_median
from paylens.session import cut_lineage

FINDING = "rule string, severity string, entity string, field string, observed double, bound double, detail string"
ORDER = ("p10", "p25", "median", "p75", "p90")
# Labels of the spread a source publishes; absolute bands per pay period; yearly factors
# used by the plausibility band alone.
DISTRIBUTION_LABELS = ("full", "quartile-only", "central-tendency-only", "mean-only")
SANITY_BANDS = {"hour": (0.5, 2000.0), "month": (50.0, 500_000.0), "year": (500.0, 5_000_000.0)}
BAND_FACTOR = {"year": 1, "month": 12, "hour": 2080}
# Refresh interval in months by source id, first match wins.
REFRESH_RULES = (
    (r"^postings(_|$)", 1),
    (r"^fx_rates$", 3),
    (r"^salary_|^bls_oews$", 15),
    (r"^(experience_gradient|hours_worked|pay_composition)$", 15),
    (r"^(world_bank|imf_weo|oecd_|un_wpp|un_migrant_stock|worldbank_gep)", 15),
    (r"^(climate_normals|city_coordinates|mipex|wipo_gii|rsf_press_freedom|wikipedia_english_speakers|world_happiness_report)$", 24),
    (r"^(bis_property_prices|fhfa_hpi_metro|teranet_national_bank_hpi|uk_hpi|numbeo_history)", 15),
    (r"^levels_fyi$", 6),
    (r"^stackoverflow_survey$", 15),
)
DEFAULT_REFRESH = 15
SENIORITY_WORDS = r"(?i)(junior|senior|entry|lead|staff|principal|experienced|new_grad)"
ADVERTISED_WORDS = r"(?i)(advertised|posting|vacancy)"


def findings(df: DataFrame, rule: str, severity, entity: Column, field, observed=None, bound=None, detail=None) -> DataFrame:
    """Rows of ``df`` as findings of one rule."""
    col = lambda x, t: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(t)
    return df.select(
        F.lit(rule).alias("rule"), col(severity, "string").alias("severity"), entity.cast("string").alias("entity"),
        col(field, "string").alias("field"), col(observed, "double").alias("observed"), col(bound, "double").alias("bound"), col(detail, "string").alias("detail"),
    )


def union(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def unpivot_wages(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wide wage fields to one row per (record, field) with the parts of the field's name."""
    long = df.select(*key, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(list(key), list(fields), "field", "value")
    fam = text.field_family(F.col("field"))
    return long.filter("value IS NOT NULL").withColumn("family", fam).filter("family IS NOT NULL").select(
        *key, "field", "value", F.col("family.prefix").alias("prefix"), F.col("family.statistic").alias("statistic"), F.col("family.suffix").alias("suffix")
    )


def check_percentiles(df: DataFrame, entity: str, fields: dict[str, str]) -> DataFrame:
    """Neighbouring percentiles among those present must not invert. ``fields``: statistic -> column."""
    points = F.array_compact(F.array(*[F.when(F.col(fields[s]).isNotNull(), F.struct(F.lit(s).alias("s"), F.col(fields[s]).cast("double").alias("v"))) for s in ORDER if s in fields]))
    pairs = F.arrays_zip(F.slice("__p", F.lit(1), F.greatest(F.size("__p") - 1, F.lit(0))).alias("a"), F.slice("__p", F.lit(2), F.greatest(F.size("__p") - 1, F.lit(0))).alias("b"))
    bad = df.withColumn("__p", points).filter("size(__p) >= 2").select(F.col(entity).alias("__e"), F.explode(pairs).alias("x")).filter("x.a.v > x.b.v")
    return findings(bad, "percentiles_ordered", "error", F.col("__e"), F.concat_ws("<=", "x.a.s", "x.b.s"), F.col("x.a.v"), F.col("x.b.v"))


def check_mean_in_range(df: DataFrame, entity: str, mean: str, p10: str, p90: str) -> DataFrame:
    bad = df.filter((F.col(mean) < F.col(p10)) | (F.col(mean) > F.col(p90)))
    return findings(bad, "mean_in_range", "error", F.col(entity), mean, F.col(mean), F.when(F.col(mean) < F.col(p10), F.col(p10)).otherwise(F.col(p90)))


def check_positive_pay(long: DataFrame, entity: str) -> DataFrame:
    """Pay with a known unit is above zero. Needs field, value, currency, period."""
    bad = long.filter("currency IS NOT NULL AND period IS NOT NULL AND value <= 0")
    return findings(bad, "positive_pay", "error", F.col(entity), F.col("field"), F.col("value"), 0.0, F.when(F.col("value") == 0, "zero in place of a missing value").otherwise("negative"))


def check_distribution_label(df: DataFrame, entity: str, label: str, fields: dict[str, str]) -> DataFrame:
    """Labels are known, and one that says there are no percentiles is not contradicted."""
    spread = F.coalesce(*[F.when(F.col(fields[s]).isNotNull(), F.lit(True)) for s in ("p10", "p25", "p75", "p90") if s in fields], F.lit(False))
    known = F.col(label).isin(*DISTRIBUTION_LABELS)
    why = F.when(~known, "unknown label").when(F.col(label).isin("central-tendency-only", "mean-only") & spread, "percentiles are published")
    bad = df.filter(F.col(label).isNotNull()).withColumn("__why", why).filter("__why IS NOT NULL")
    return findings(bad, "distribution_label", "error", F.col(entity), label, detail=F.col("__why"))


def check_unit_disclosed(leaves: DataFrame, entity: str) -> DataFrame:
    """Every wage field tells its currency and period. Needs field, container, currency, period (siblings)."""
    cur, per = text.resolve_unit(F.col("field"), F.col("container"), (F.col("currency"), F.col("period")))
    d = leaves.filter(text.field_family(F.col("field")).isNotNull() & ~F.coalesce("container", F.lit("")).rlike("(?i)coefficient_of_variation"))
    d = d.withColumns({"__c": cur, "__p": per}).filter("__c IS NULL OR __p IS NULL")
    return findings(
        d, "unit_disclosed", "error", F.col(entity), F.col("field"),
        detail=F.when(F.col("__c").isNull() & F.col("__p").isNull(), "currency and period").when(F.col("__c").isNull(), "currency").otherwise("period"),
    )


def magnitude_bounds(long: DataFrame, min_n: int = 5) -> DataFrame:
    """Plausible range per (currency, period): median +- 8 MAD, never below a quarter of the median.

    Built from the statistics that are not means wherever a family has any.
    """
    family = ["entity", "prefix", "suffix"]
    others = long.groupBy(*family).agg(F.max((F.col("statistic") != "mean").cast("int")).alias("__has"))
    src = long.join(others, family).filter((F.col("__has") == 0) | (F.col("statistic") != "mean"))
    keys = ["currency", "period"]
    med = group_median(src, keys, "value", "med").filter(F.col("n") >= min_n)
    dev = src.join(med, keys).withColumn("__d", F.abs(F.col("value") - F.col("med")))
    mad = group_median(dev, keys, "__d", "mad").drop("n")
    out = med.join(mad, keys).withColumn("mad", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("med") * 0.05))
    return out.select(*keys, "n", F.greatest(F.col("med") - 8 * F.col("mad"), F.col("med") / 4).alias("lo"), (F.col("med") + 8 * F.col("mad")).alias("hi"))


def check_magnitude(long: DataFrame) -> DataFrame:
    """Figures outside the absolute band of their period, else outside their own bucket's range.

    Needs entity, field, prefix, statistic, suffix, value, currency, period.
    """
    known = long.filter("currency IS NOT NULL AND period IS NOT NULL")
    band = lambda i: F.coalesce(*[F.when(F.col("period") == p, F.lit(b[i])) for p, b in SANITY_BANDS.items()])
    v = F.col("value")
    d = known.join(magnitude_bounds(known), ["currency", "period"], "left")
    absolute = (v < band(0)) | (v > band(1))
    relative = (v < F.col("lo")) | (v > F.col("hi"))
    which = F.when(absolute, "absolute").when(relative, "relative")
    bad = d.withColumn("__w", which).filter("__w IS NOT NULL")
    low = F.when(F.col("__w") == "absolute", band(0)).otherwise(F.col("lo"))
    high = F.when(F.col("__w") == "absolute", band(1)).otherwise(F.col("hi"))
    return findings(bad, "magnitude", "flag", F.col("entity"), F.col("field"), v, F.when(v < low, low).otherwise(high), F.col("__w"))


def check_embedded(df: DataFrame, entity: str, hourly: str, computed: str, published: str, residual: str) -> DataFrame:
    """A stored cross-check is computed again: 37 hours a week, 52 weeks, 12 months."""
    again = F.round(F.col(hourly) * (37.0 * 52 / 12), 2)
    real = F.round(F.abs(F.col(computed) - F.col(published)) / F.col(published) * 100, 4)
    d = df.withColumns({"__a": again, "__r": real})
    return union(
        [
            findings(d.filter(F.abs(F.col("__a") - F.col(computed)) > 0.02), "embedded_product", "error", F.col(entity), computed, F.col(computed), F.col("__a")),
            findings(d.filter(F.abs(F.col("__r") - F.col(residual)) > 0.001), "embedded_residual", "error", F.col(entity), residual, F.col(residual), F.col("__r")),
            findings(d.filter("__r > 1.0"), "embedded_bound", "error", F.col(entity), published, F.col("__r"), 1.0),
        ]
    )


def refresh_months(source_id: Column) -> Column:
    return F.coalesce(*[F.when(source_id.rlike(p), m) for p, m in REFRESH_RULES], F.lit(DEFAULT_REFRESH))


def check_refresh(prov: DataFrame, source_id: str, fetched: str, now: str) -> DataFrame:
    """Sources older than their interval (30 days to a month); ``now`` is a date text."""
    age = F.datediff(F.to_date(F.lit(now)), F.try_to_timestamp(F.col(fetched)).cast("date"))
    limit = refresh_months(F.col(source_id)) * 30
    return findings(prov.filter(age > limit), "refresh", "flag", F.col(source_id), fetched, age, limit)


def check_identity(a: DataFrame, b: DataFrame, keys: Sequence[str], factor: float, tol_pct: float) -> DataFrame:
    """One row: pairs compared, worst residual in percent, and whether the identity holds.

    Nothing to compare is a failure.
    """
    both = a.select(*keys, F.col("value").alias("__a")).join(b.select(*keys, F.col("value").alias("__b")), list(keys)).filter("__b <> 0")
    worst = F.max(F.abs(F.col("__a") * factor - F.col("__b")) / F.abs("__b") * 100)
    return both.agg(F.count(F.lit(1)).alias("checked"), worst.alias("worst_pct")).withColumn(
        "holds", F.coalesce((F.col("checked") > 0) & (F.col("worst_pct") <= tol_pct), F.lit(False))
    )


def check_merge_current(merged: DataFrame, sources: DataFrame, key: str, stamp: str) -> DataFrame:
    from paylens.operators.lookups import stale_merge

    s = stale_merge(merged, sources, key, stamp)
    return findings(s, "merge_current", "error", F.col(key), stamp, detail=F.concat_ws(" -> ", "recorded", "current"))


def check_benchmark(status_rows: DataFrame, entity: str, lo: float = 1.0, hi: float = 2.5) -> DataFrame:
    """Findings of :func:`paylens.operators.lookups.benchmark_ratio`; nothing checked is an error."""
    flagged = findings(
        status_rows.filter("status IN ('flagged', 'no_year', 'no_figure')"), "benchmark", "flag", F.col(entity), "ratio", F.col("ratio"),
        F.when(F.col("ratio") < lo, F.lit(lo)).when(F.col("ratio") > hi, F.lit(hi)), F.col("status"),
    )
    none = status_rows.agg(F.count_if(F.col("status").isin("ok", "flagged")).alias("c")).filter("c = 0")
    return flagged.unionByName(findings(none, "benchmark", "error", F.lit("all"), "ratio", detail="nothing was checked"))


def check_annualised(df: DataFrame, entity: str, lo: float = 500.0, hi: float = 5_000_000.0) -> DataFrame:
    """Postings whose yearly USD midpoint is outside a wide band. Needs usd_min, usd_max, period."""
    factor = F.coalesce(*[F.when(F.col("period") == p, F.lit(float(k))) for p, k in BAND_FACTOR.items()])
    d = df.withColumn("__m", (F.col("usd_min") + F.col("usd_max")) / 2 * factor).filter((F.col("__m") < lo) | (F.col("__m") > hi))
    return findings(d, "annualised", "flag", F.col(entity), "compensation", F.col("__m"), F.when(F.col("__m") < lo, lo).otherwise(hi))


def check_curated(cities: DataFrame, countries: DataFrame) -> DataFrame:
    """Unique ids, known country, dated, sourced, salary bands in order, tax in range, no fake nulls.

    cities: id, country, as_of, sources, new_grad, mid, senior and text columns.
    countries: id, as_of, sources, net_pct.
    """
    dup = lambda df, what: findings(df.groupBy("id").count().filter("count > 1"), "unique_id", "error", F.col("id"), what, F.col("count"), 1.0)
    unsourced = lambda df, what: [
        findings(df.filter(F.coalesce("as_of", F.lit("")) == ""), "as_of", "error", F.col("id"), what),
        findings(df.filter(F.coalesce(F.size("sources"), F.lit(0)) <= 0), "sources", "error", F.col("id"), what),
    ]
    unknown = cities.join(countries.select(F.col("id").alias("country")), "country", "left_anti")
    inverted = cities.filter("new_grad > mid OR mid > senior").filter("new_grad IS NOT NULL AND mid IS NOT NULL AND senior IS NOT NULL")
    texts = [c for c, t in cities.dtypes if t == "string" and c != "id"]
    fake = F.array_compact(F.array(*[F.when(text.is_fake_null(F.col(c)) & (F.col(c) != ""), F.lit(c)) for c in texts]))
    fakes = cities.select("id", F.explode(fake).alias("f"))
    tax = countries.filter("net_pct < 30 OR net_pct > 100")
    return union(
        [
            dup(cities, "cities"), dup(countries, "countries"), *unsourced(cities, "cities"), *unsourced(countries, "countries"),
            findings(unknown, "known_country", "error", F.col("id"), F.col("country")),
            findings(inverted, "salary_bands", "error", F.col("id"), "salary", F.col("new_grad"), F.col("senior")),
            findings(fakes, "fake_null", "error", F.col("id"), F.col("f")),
            findings(tax, "tax_range", "error", F.col("id"), "net_pct", F.col("net_pct")),
        ]
    )


def check_envelope(datasets: DataFrame, prov: DataFrame) -> DataFrame:
    """Envelope and provenance complete; blocked sources explain themselves and hold no data.

    datasets: source_id, generated_at, meta_present, rows. prov: source_id, license, transforms, fetched_at, status, notes, output.
    """
    d = datasets.join(prov, "source_id", "left").withColumn("__prov", F.col("fetched_at").isNotNull() | F.col("status").isNotNull() | F.col("license").isNotNull())
    blocked = F.col("status").isin("blocked", "unavailable", "failed")
    empty = F.coalesce("rows", F.lit(0)) == 0
    rules = [
        ("envelope_key", "error", F.col("generated_at").isNull(), "generated_at"),
        ("envelope_key", "error", ~F.coalesce("meta_present", F.lit(False)), "meta"),
        ("provenance", "error", ~F.col("__prov"), "source_id"),
        ("license", "error", F.col("__prov") & (F.coalesce("license", F.lit("")) == ""), "license"),
        ("transforms", "error", F.col("__prov") & (F.coalesce(F.size("transforms"), F.lit(0)) <= 0), "transforms"),
        ("fetched_at", "error", F.col("__prov") & F.col("fetched_at").isNull(), "fetched_at"),
        ("blocked_notes", "error", blocked & (F.coalesce("notes", F.lit("")) == ""), "notes"),
        ("blocked_empty", "error", blocked & ~empty, "rows"),
        ("ok_but_empty", "warn", ~F.coalesce(blocked, F.lit(False)) & F.col("__prov") & empty, "rows"),
    ]
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(f).alias("field"))) for r, s, c, f in rules]))
    rows = d.select("source_id", F.explode(hits).alias("h"))
    out = rows.select(
        F.col("h.rule").alias("rule"), F.col("h.severity").alias("severity"), F.col("source_id").alias("entity"), F.col("h.field").alias("field"),
        F.lit(None).cast("double").alias("observed"), F.lit(None).cast("double").alias("bound"), F.lit(None).cast("string").alias("detail"),
    )
    orphan = prov.join(datasets.select("source_id"), "source_id", "left_anti")
    return out.unionByName(findings(orphan, "orphan_provenance", "warn", F.col("source_id"), "output"))


def check_forecasts(datasets: DataFrame) -> DataFrame:
    """Forecast datasets name their institution and attribution; at least one exists.

    datasets: source_id, kind, institution, attribution, status.
    """
    f = datasets.filter("kind = 'institutional_forecast'")
    open_ = ~F.coalesce(F.col("status").isin("blocked", "unavailable"), F.lit(False))
    none = datasets.agg(F.count_if(F.col("kind") == "institutional_forecast").alias("c")).filter("c = 0")
    return union(
        [
            findings(f.filter("institution IS NULL"), "forecast_institution", "error", F.col("source_id"), "institution"),
            findings(f.filter(F.col("attribution").isNull() & open_), "forecast_attribution", "error", F.col("source_id"), "attribution"),
            findings(none, "forecast_present", "error", F.lit("all"), "kind"),
        ]
    )


def check_field_separation(a: DataFrame, b: DataFrame, exempt: Sequence[str] = ()) -> DataFrame:
    """Wage statistics on one side and advertised pay on the other share no field name."""
    from paylens.operators.sets import shared_fields

    wage = lambda df: df.filter(text.field_family(F.element_at(F.split("path", r"\."), -1)).isNotNull())
    shared = shared_fields(wage(a), wage(b))
    if exempt:
        shared = shared.filter(~F.col("field").isin(*exempt))
    return findings(shared, "field_separation", "error", F.col("field"), F.col("field"))


def check_mixed_vocabulary(leaves: DataFrame) -> DataFrame:
    """Sources whose field names speak of advertised pay and of survey statistics at once."""
    name = F.element_at(F.split("path", r"\."), -1)
    d = leaves.groupBy("source_id").agg(
        F.max(name.rlike(ADVERTISED_WORDS).cast("int")).alias("a"), F.max(text.field_family(name).isNotNull().cast("int")).alias("s")
    )
    return findings(d.filter("a = 1 AND s = 1"), "survey_advertised", "error", F.col("source_id"), "path")


def check_seniority_names(leaves: DataFrame) -> DataFrame:
    """A percentile is not a seniority: names never say both."""
    name = F.element_at(F.split("path", r"\."), -1)
    bad = leaves.filter(name.rlike("(?i)(p10|p25|p75|p90|percentile)") & name.rlike(SENIORITY_WORDS))
    return findings(bad, "seniority_name", "error", F.col("path"), name)


def check_absence_explicit(df: DataFrame, entity: str, label: str, fields: dict[str, str]) -> DataFrame:
    """A wage record without percentiles says so in its label."""
    has = F.coalesce(*[F.when(F.col(fields[s]).isNotNull(), F.lit(True)) for s in ("p10", "p25", "p75", "p90") if s in fields], F.lit(False))
    central = F.coalesce(*[F.when(F.col(fields[s]).isNotNull(), F.lit(True)) for s in ("mean", "median") if s in fields], F.lit(False))
    bad = df.filter(central & ~has & ~F.coalesce(F.col(label).isin("central-tendency-only", "mean-only"), F.lit(False)))
    return findings(bad, "absence_explicit", "error", F.col(entity), label)


def check_no_series(datasets: DataFrame) -> DataFrame:
    """Records without a series agree on their status and give dated evidence or a reason.

    datasets: source_id, status, meta_status, evidence_date, explanation.
    """
    d = datasets.filter("status = 'no_series' OR meta_status = 'no_series'")
    return union(
        [
            findings(d.filter("NOT (status <=> meta_status)"), "no_series_status", "error", F.col("source_id"), "status"),
            findings(d.filter("evidence_date IS NULL AND coalesce(trim(explanation), '') = ''"), "no_series_evidence", "error", F.col("source_id"), "explanation"),
        ]
    )


def check_self_describe(df: DataFrame, entity: str) -> DataFrame:
    """Successful conversions carry their rate, year, source and steps. Needs ok, fx_rate, fx_year, fx_source, chain."""
    gaps = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("fx_rate", "fx_year", "fx_source")], F.when(F.coalesce(F.size("chain"), F.lit(0)) <= 0, F.lit("chain")))
    )
    bad = df.filter("ok").select(F.col(entity).alias("__e"), F.explode(gaps).alias("f"))
    return findings(bad, "self_describe", "error", F.col("__e"), F.col("f"))


def check_fx_year(df: DataFrame, entity: str, year: str) -> DataFrame:
    """The year named in a conversion step is the year of the figure. Needs chain of (op, detail)."""
    steps = df.select(F.col(entity).alias("__e"), F.col(year).alias("__y"), F.explode("chain").alias("s")).filter("s.op = 'fx_convert'")
    steps = steps.withColumn("__used", F.regexp_extract("s.detail", r"(?<!\d)((?:19|20)\d{2})(?!\d)(?!.*(?<!\d)(?:19|20)\d{2}(?!\d))", 1).try_cast("int"))
    return findings(steps.filter("NOT (__used <=> __y)"), "fx_year", "error", F.col("__e"), "chain", F.col("__used"), F.col("__y"))


def check_hours_sourced(df: DataFrame, hours: DataFrame, entity: str) -> DataFrame:
    """Hourly figures belong to an entity with sourced hours, or carry their own."""
    known = hours.select(entity).distinct()
    bad = df.filter("period = 'hour' AND own_hours IS NULL").join(known, entity, "left_anti")
    return findings(bad, "hours_sourced", "error", F.col(entity), "period")


def recompute_chain(df: DataFrame, entity: str, tol: float = 0.005) -> DataFrame:
    """Derived values worked out again from the numbers written in their own steps.

    Steps ``a x b``, ``a / b`` and ``a - b`` apply their second number to the running value.
    Needs start, value, chain of (op, detail).
    """
    num = r"(-?\d+(?:\.\d+)?)"

    def apply(acc: Column, s: Column) -> Column:
        second = lambda sign: F.regexp_extract(s["detail"], rf"{sign}\s*{num}", 1).try_cast("double")
        return (
            F.when(s["op"].isin("monthly_to_annual", "hourly_to_weekly", "weekly_to_annual"), acc * second("x"))
            .when(s["op"] == "fx_convert", acc / second("/"))
            .when(s["op"] == "subtract", acc - second(r"(?<=\d) -"))
            .otherwise(acc)
        )

    again = F.aggregate("chain", F.col("start").cast("double"), apply)
    d = df.withColumn("__again", again).filter(F.abs(F.col("__again") - F.col("value")) > F.abs(F.col("value")) * tol)
    return findings(d, "chain_recomputed", "error", F.col(entity), "chain", F.col("value"), F.col("__again"))


def check_reconcile(live: DataFrame, stored: DataFrame, keys: Sequence[str], tol: float = 0.005) -> DataFrame:
    """Findings of a live sample against what is stored; an empty comparison is itself one."""
    from paylens.operators.lookups import reconcile

    r = reconcile(live, stored, keys, tol)
    bad = findings(
        r.filter("class <> 'match'"), "reconcile", F.when(F.col("class") == "mismatch", "error").otherwise("flag"), F.concat_ws(":", *keys), keys[-1],
        F.col("live"), F.col("stored"), F.col("class"),
    )
    none = r.agg(F.count_if(F.col("class").isin("match", "mismatch")).alias("c")).filter("c = 0")
    return bad.unionByName(findings(none, "reconcile", "flag", F.lit("all"), "value", detail="nothing was compared"))


def drift(cur: DataFrame, prev: DataFrame, drop_pct: float = 15.0, growth_pct: float = 50.0, floor: int = 20) -> DataFrame:
    """Snapshot against the one before. Rows: scope (source, overall, provider, country), key, rows, stated_pay.

    A fall beyond ``drop_pct`` blocks (for countries only from ``floor`` rows on); growth beyond
    ``growth_pct`` is flagged for sources that are not postings; new sources are flagged.
    """
    p = prev.select("scope", "key", F.col("rows").alias("__rows"), F.col("stated_pay").alias("__pay"))
    d = cur.join(p, ["scope", "key"], "left")
    change = 100 * F.try_divide(F.col("rows") - F.col("__rows"), F.col("__rows"))
    rate = lambda pay, rows: F.try_divide(F.col(pay).cast("double"), F.col(rows))
    rate_change = 100 * F.try_divide(rate("stated_pay", "rows") - rate("__pay", "__rows"), rate("__pay", "__rows"))
    d = d.withColumns({"__c": change, "__rc": rate_change})
    scope, c, rc = F.col("scope"), F.col("__c"), F.col("__rc")
    counted = scope.isin("source", "provider", "country")
    small = (scope == "country") & (F.col("__rows") < floor)
    hits = F.array_compact(
        F.array(
            F.when((scope == "source") & F.col("__rows").isNull(), F.struct(F.lit("new").alias("w"), F.lit("flag").alias("s"), F.lit(None).cast("double").alias("v"))),
            F.when(counted & (c < -drop_pct), F.struct(F.lit("drop").alias("w"), F.when(small, "flag").otherwise("drop").alias("s"), c.alias("v"))),
            F.when((scope == "source") & ~F.col("key").startswith("postings") & (c > growth_pct), F.struct(F.lit("growth").alias("w"), F.lit("flag").alias("s"), c.alias("v"))),
            F.when((scope == "overall") & (F.abs(rc) > drop_pct), F.struct(F.lit("pay_rate").alias("w"), F.when(rc < 0, "drop").otherwise("flag").alias("s"), rc.alias("v"))),
        )
    )
    e = d.select("scope", "key", F.explode(hits).alias("h"))
    return findings(e, "drift", F.col("h.s"), F.concat_ws(":", "scope", "key"), F.col("h.w"), F.col("h.v"))


def snapshot(df: DataFrame, provider: str, country: str, paid: Column) -> DataFrame:
    """Counts and stated pay overall, by provider and by country, in one pass."""
    d = df.select(F.col(provider).alias("provider"), F.coalesce(country, F.lit("unresolved")).alias("country"), paid.cast("int").alias("paid"))
    g = d.groupingSets([[], ["provider"], ["country"]], "provider", "country").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("paid"), F.lit(0)).cast("long").alias("stated_pay"),
        F.grouping("provider").alias("gp"), F.grouping("country").alias("gc"),
    )
    return g.select(
        F.when(F.col("gp") == 0, "provider").when(F.col("gc") == 0, "country").otherwise("overall").alias("scope"),
        F.when(F.col("gp") == 0, F.col("provider")).when(F.col("gc") == 0, F.col("country")).otherwise("all").alias("key"),
        "rows", "stated_pay",
    )


def overall_status(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: errors, flags, checks that never ran, and the verdict.

    ``expected``: rule, ran. Any error or drop, or a check that did not run, is failing.
    """
    f = found.agg(
        F.count_if(F.col("severity").isin("error", "drop")).alias("errors"), F.count_if(F.col("severity").isin("flag", "warn")).alias("flags")
    )
    e = expected.agg(F.count_if(~F.coalesce("ran", F.lit(False))).alias("unrun"))
    return f.join(F.broadcast(e)).withColumn("status", F.when((F.col("errors") > 0) | (F.col("unrun") > 0), "FAILING").otherwise("PASSING"))


def split_status(df: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """(usable, the rest) by status."""
    usable = F.coalesce(F.col(status).isin("ok", "partial"), F.lit(False))
    return df.filter(usable), df.filter(~usable)


# ---------------------------------------------------------------- documents


def flatten_leaves(df: DataFrame, key: Sequence[str], payload: str) -> DataFrame:
    """Free-form JSON documents as (key, path, value), array positions collapsed to ``[]``.

    Levels are opened until none is left; each is checkpointed, so no level is parsed twice.
    """
    cur = df.select(*key, F.lit("").alias("path"), F.try_parse_json(F.col(payload)).alias("v")).filter("v IS NOT NULL")
    leaves = []
    while True:
        cur = cut_lineage(cur.select(*key, "path", "v", F.expr("schema_of_variant(v)").rlike("^(OBJECT|ARRAY)").alias("__deep")))
        nested = cur.filter("__deep")
        leaves.append(cur.filter("NOT __deep").select(*key, "path", F.expr("cast(v AS string)").alias("value")))
        if nested.isEmpty():
            return union(leaves)
        opened = nested.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        cur = opened.select(*key, step.alias("path"), F.col("value").alias("v"))


# Names that hold identifiers, places or dates, which are not measured.
NOT_MEASURED = (
    "^(id|ids|lat|lon|latitude|longitude|year|years_requested|period|month|rank|index_rank|position|code|iso|iso2|iso3|fips|zip|postcode)$"
)


def measured(leaves: DataFrame) -> DataFrame:
    """Leaves whose name is not an identifier or a calendar field."""
    name = F.regexp_replace(F.element_at(F.split("path", r"\."), -1), r"\[\]", "")
    return leaves.filter(~name.rlike(f"(?i){NOT_MEASURED}"))


