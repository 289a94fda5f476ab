"""Job boards of six shapes to one posting schema. Input rows are board documents already landed.

Pay is kept only where it is published as a positive number with a period that can be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import geo, text

PAY_TYPE = "struct<min:double,max:double,currency:string,period:string,raw_text:string,confidence:string>"


def pay(lo: Column, hi: Column, currency: Column, period: Column, raw: Column) -> Column:
    """Structured pay; a missing or zero minimum, or no period, is no pay."""
    usable = F.coalesce(lo, F.lit(0.0)) > 0
    top = F.when(F.coalesce(hi, F.lit(0.0)) != 0, hi).otherwise(lo)
    made = F.struct(
        lo.cast("double").alias("min"), top.cast("double").alias("max"), currency.alias("currency"), period.alias("period"),
        raw.alias("raw_text"), F.lit("structured").alias("confidence"),
    )
    return F.when(usable & period.isNotNull(), text.fix_period(made)).cast(PAY_TYPE)


def interval_period(col: Column) -> Column:
    """hour, month or year named in an interval; twice-monthly ones are none of them."""
    i = F.lower(F.coalesce(col, F.lit("")))
    return (
        F.when(i.contains("hour"), "hour")
        .when(i.contains("year"), "year")
        .when(i.contains("month") & ~i.contains("bi-") & ~i.contains("semi-"), "month")
    )


def posting(provider: str, token: Column, native: Column, **cols: Column) -> list[Column]:
    none = F.lit(None)
    place = cols.get("location_raw", none).cast("string")
    country = cols.get("country", geo.country_from_location(place))
    return [
        F.concat_ws(":", F.lit(provider), token, native.cast("string")).alias("id"), F.lit(provider).alias("provider"),
        cols.get("company", none).cast("string").alias("company"), cols.get("company_slug", token).cast("string").alias("company_slug"),
        cols.get("title", none).cast("string").alias("title"), place.alias("location_raw"), country.cast("string").alias("country"),
        cols.get("remote", none).cast("boolean").alias("remote"), cols.get("url", none).cast("string").alias("url"),
        cols.get("posted_at", none).cast("string").alias("posted_at"), cols.get("compensation", none).cast(PAY_TYPE).alias("compensation"),
        none.cast("struct<occupation_key:string,confidence:string>").alias("occupation"),
    ]


ASHBY = (
    "token string, organizationName string, jobs array<struct<id:string,title:string,location:string,isRemote:boolean,jobUrl:string,applyUrl:string,publishedAt:string,"
    "compensation:struct<compensationTierSummary:string,compensationTiers:array<struct<tierSummary:string,components:array<struct<minValue:double,maxValue:double,currencyCode:string,interval:string>>>>>>>"
)


def postings_ashby(df: DataFrame) -> DataFrame:
    """Board with a job list; the first usable pay component of a job counts."""
    d = df.select("token", F.col("organizationName").alias("org"), F.explode("jobs").alias("j"))
    tiers = F.coalesce("j.compensation.compensationTiers", F.array().cast("array<struct<tierSummary:string,components:array<struct<minValue:double,maxValue:double,currencyCode:string,interval:string>>>>"))
    parts = F.flatten(F.transform(tiers, lambda t: F.transform(t["components"], lambda c: F.struct(t["tierSummary"].alias("s"), c.alias("c")))))
    usable = F.filter(parts, lambda p: (F.coalesce(p["c"]["minValue"], F.lit(0.0)) != 0) & p["c"]["currencyCode"].isNotNull() & interval_period(p["c"]["interval"]).isNotNull())
    d = d.withColumn("p", F.get(usable, F.lit(0)))
    raw = F.coalesce(F.nullif("p.s", F.lit("")), "j.compensation.compensationTierSummary", F.lit(""))
    comp = pay(F.col("p.c.minValue"), F.col("p.c.maxValue"), F.col("p.c.currencyCode"), interval_period(F.col("p.c.interval")), raw)
    return d.select(
        *posting(
            "ashby", F.col("token"), F.col("j.id"), company=F.nullif("org", F.lit("")), title=F.col("j.title"), location_raw=F.coalesce("j.location", F.lit("")),
            remote=F.col("j.isRemote"), url=F.coalesce("j.jobUrl", "j.applyUrl"), posted_at=F.col("j.publishedAt"), compensation=comp,
        )
    )


def postings_greenhouse(jobs: DataFrame, detail: DataFrame, paid_jobs: int | None = None) -> DataFrame:
    """Job list joined with its detail; with ``paid_jobs`` only so many jobs of a company carry pay.

    jobs: token, pos, id, title, company_name, location, url, updated_at.
    detail: token, id, min_cents, max_cents, currency (first published range). Cents become units;
    a maximum under 1000 is an hourly figure, because the board does not say the period.
    """
    paid = detail
    if paid_jobs is not None:
        rn = F.row_number().over(Window.partitionBy("token").orderBy("pos"))
        paid = detail.join(jobs.select("token", "id", rn.alias("rn")).filter(F.col("rn") <= paid_jobs), ["token", "id"], "left_semi")
    d = jobs.join(paid, ["token", "id"], "left")
    lo, hi = F.col("min_cents") / 100, F.coalesce("max_cents", F.lit(0)) / 100
    period = F.when((hi > 0) & (hi < 1000), "hour").otherwise("year")
    made = F.struct(lo.cast("double").alias("min"), hi.cast("double").alias("max"), F.coalesce("currency", F.lit("USD")).alias("currency"), period.alias("period"),
                    F.concat_ws(" ", F.concat_ws("-", F.format_number(lo, 0), F.format_number(hi, 0)), "currency").alias("raw_text"), F.lit("structured").alias("confidence"))
    return d.select(
        *posting(
            "greenhouse", F.col("token"), F.col("id"), company=F.coalesce("company_name", "token"), title=F.col("title"), location_raw=F.coalesce("location", F.lit("")),
            url=F.col("url"), posted_at=F.nullif(F.substring("updated_at", 1, 10), F.lit("")), compensation=F.when(F.coalesce("min_cents", F.lit(0)) != 0, made),
        )
    )


def postings_lever(df: DataFrame) -> DataFrame:
    """Rows: token, id, title, location, workplace, url, salary struct(min, max, currency, interval)."""
    s = F.col("salary")
    raw = F.concat(F.concat_ws("-", s["min"], s["max"]), F.lit(" "), F.coalesce(s["currency"], F.lit("")), F.lit(" ("), F.coalesce(s["interval"], F.lit("")), F.lit(")"))
    comp = pay(s["min"], s["max"], F.coalesce(s["currency"], F.lit("USD")), interval_period(s["interval"]), raw)
    return df.select(*posting("lever", F.col("token"), F.col("id"), title=F.col("title"), location_raw=F.col("location"), remote=F.when(F.col("workplace").isNotNull(), F.col("workplace") == "remote"), url=F.col("url"), compensation=comp))


def postings_feed(df: DataFrame) -> DataFrame:
    """Schema.org feed rows: token, feed_title, id, title, url, published, locality, region, country_name,
    salary struct(min, max, currency, unit). Country from the whole address, else from its country part."""
    place = F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in ("locality", "region", "country_name")])
    s = F.col("salary")
    comp = pay(s["min"], s["max"], F.coalesce(s["currency"], F.lit("USD")), F.when(s["min"].isNotNull(), F.lower(F.coalesce(s["unit"], F.lit("YEAR")))), F.to_json(s))
    return df.select(
        *posting(
            "teamtailor", F.col("token"), F.col("id"), company=F.coalesce("feed_title", "token"), title=F.col("title"), location_raw=F.nullif(place, F.lit("")),
            country=F.coalesce(geo.country_from_location(place), geo.country_from_location(F.col("country_name"))), url=F.col("url"),
            posted_at=F.nullif(F.substring("published", 1, 10), F.lit("")), compensation=comp,
        )
    )


def postings_gov(df: DataFrame) -> DataFrame:
    """Government announcements: exact salary types, first location, the United States unless told otherwise.

    Rows: id, agency, department, department_code, title, opened, lo, hi, salary_type, locations array(struct(city, state)).
    """
    first = F.get("locations", F.lit(0))
    place = F.concat_ws(", ", F.nullif(first["city"], F.lit("")), F.nullif(first["state"], F.lit("")))
    kind = F.lower("salary_type")
    period = F.when(kind == "per year", "year").when(kind == "per hour", "hour")
    raw = F.concat(F.format_number("lo", 0), F.lit("-"), F.format_number("hi", 0), F.lit(" USD ("), F.coalesce("salary_type", F.lit("")), F.lit(")"))
    comp = F.when(F.col("hi").isNotNull(), pay(F.col("lo"), F.col("hi"), F.lit("USD"), period, raw))
    cols = posting(
        "usajobs", F.col("id").cast("string"), F.lit(None).cast("string"), company=F.coalesce("agency", "department"), company_slug=F.coalesce("department_code", F.lit("usajobs")),
        title=F.col("title"), location_raw=place, country=F.coalesce(geo.country_from_location(place), F.lit("US")), posted_at=F.col("opened"), compensation=comp,
    )
    return df.select(*cols)


def postings_forum(df: DataFrame, longest_title: int | None = None, longest_place: int | None = None) -> DataFrame:
    """Forum comments (id, text, deleted, dead): first line is the title, the first line with readable
    pay gives the pay, a place is looked for in the first three lines. The two lengths cut titles and places."""
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    d = df.filter(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False)) & (F.coalesce("text", F.lit("")) != ""))
    lines = F.filter(F.transform(F.split(text.strip_html(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.select("id", lines.alias("l")).filter("size(l) > 0")
    comp = F.get(F.filter(F.transform("l", text.parse_pay), lambda p: p.isNotNull()), F.lit(0))
    place_line = F.get(F.filter(F.slice("l", 1, 3), lambda x: F.lower(x).rlike(r"remote|onsite|hybrid|\|")), F.lit(0))
    d = d.withColumns({"comp": comp, "place": cut(place_line, longest_place), "all": F.lower(F.array_join("l", "\n"))})
    remote = F.when(F.contains("all", F.lit("remote")), True).when(F.contains("all", F.lit("onsite")), False)
    cols = posting("hn", F.col("id").cast("string"), F.lit(None).cast("string"), company_slug=F.lit("hn"), title=cut(F.get("l", F.lit(0)), longest_title), location_raw=F.col("place"), remote=remote, compensation=F.col("comp"))
    return d.select(*cols)
