"""Conversions that either give a value with its chain of steps or a reason why not.

Conversions return a struct column ``(ok, value, reason, chain)``; refusals are values. Beside each
stand its number and its reason alone: a chain is text that is built for every row that asks for
the struct, so sums and medians read the plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS_PER_YEAR = 12
WEEKS_PER_YEAR = 52

CHAIN_TYPE = "array<struct<op:string,detail:string>>"
RESULT_TYPE = f"struct<ok:boolean,value:double,reason:string,chain:{CHAIN_TYPE}>"

# Currency -> the country whose rate series is that currency's.
CURRENCY_COUNTRY = {
    "USD": "US", "EUR": "DE", "GBP": "GB", "CAD": "CA", "SGD": "SG", "JPY": "JP", "KHR": "KH",
    "INR": "IN", "AMD": "AM", "AUD": "AU", "SEK": "SE", "NOK": "NO", "DKK": "DK", "AED": "AE",
}

# The two sources whose bonus field is prose but whose basis is known.
BASIS_BY_SOURCE = {"bls_oews": "regular_pay", "salary_uk": "total_earnings"}


def step(op: str, detail: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), detail.alias("detail"))


def amount(value: Column) -> Column:
    return F.format_string("%.2f", value)


def success(value: Column, chain: Column) -> Column:
    return F.struct(
        F.lit(True).alias("ok"),
        value.cast("double").alias("value"),
        F.lit(None).cast("string").alias("reason"),
        chain.cast(CHAIN_TYPE).alias("chain"),
    )


def refusal(reason: Column) -> Column:
    return F.struct(
        F.lit(False).alias("ok"),
        F.lit(None).cast("double").alias("value"),
        reason.alias("reason"),
        F.array().cast(CHAIN_TYPE).alias("chain"),
    )


def at_rate(value: Column, rate: Column) -> Column:
    """The number of :func:`convert_at` alone."""
    return value / rate


def rate_refusal(rate: Column, country: Column, year: Column) -> Column:
    """The reason of :func:`convert_at` alone, null where it converts."""
    return F.when(rate.isNull(), F.concat(F.lit("no rate for "), country, F.lit(" in "), year.cast("string")))


def convert_at(value: Column, rate: Column, country: Column, year: Column) -> Column:
    """To USD at the rate found for exactly this country and year (null rate: refused)."""
    where = F.concat(country, F.lit(" in "), year.cast("string"))
    return F.when(rate.isNull(), refusal(rate_refusal(rate, country, year))).otherwise(
        success(
            at_rate(value, rate),
            F.array(step("fx_convert", F.concat(amount(value), F.lit(" / "), amount(rate), F.lit(" ("), where, F.lit(")")))),
        )
    )


def period_refusal(period: Column, hours: Column, place: Column) -> Column:
    """The reason of :func:`annualise` alone, null where it gives a number."""
    return (
        F.when(period.isin("year", "month") | ((period == "hour") & hours.isNotNull()), F.lit(None).cast("string"))
        .when(period == "hour", F.concat(F.lit("no sourced weekly hours for "), place))
        .otherwise(F.concat(F.lit("unknown period "), F.coalesce(period, F.lit("null"))))
    )


def annualise(value: Column, period: Column, hours: Column, place: Column) -> Column:
    """Yearly value. Hours per week must come from a source; nothing is assumed."""
    return (
        F.when(period == "year", success(value, F.array(step("identity", F.lit("already annual")))))
        .when(
            period == "month",
            success(value * MONTHS_PER_YEAR, F.array(step("monthly_to_annual", F.concat(amount(value), F.lit(" x 12"))))),
        )
        .when((period == "hour") & hours.isNull(), refusal(period_refusal(period, hours, place)))
        .when(
            period == "hour",
            success(
                value * hours * WEEKS_PER_YEAR,
                F.array(
                    step("hourly_to_weekly", F.concat(amount(value), F.lit(" x "), amount(hours), F.lit(" hours/week"))),
                    step("weekly_to_annual", F.lit("x 52 weeks/year")),
                ),
            ),
        )
        .otherwise(refusal(period_refusal(period, hours, place)))
    )


def yearly_value(value: Column, period: Column, hours: Column) -> Column:
    """The number of :func:`annualise` alone."""
    factor = (
        F.when(period == "year", F.lit(1.0))
        .when(period == "month", F.lit(float(MONTHS_PER_YEAR)))
        .when(period == "hour", hours * WEEKS_PER_YEAR)
    )
    return value * factor


def override_hours(given_hours: Column, given_source: Column, given: Column, looked_up: Column) -> Column:
    """Hours published beside the figure beat the table; an incomplete override refuses (null)."""
    complete = given_hours.isNotNull() & (given_hours != 0) & given_source.isNotNull() & (given_source != "")
    return F.when(given, F.when(complete, given_hours)).otherwise(looked_up)


def subtract_component(value: Column, published: Column, component: Column, part: Column) -> Column:
    """Take a component out only when the source itself publishes it."""
    listed = F.exists(F.coalesce(published, F.array().cast("array<string>")), lambda p: p.contains(component))
    return F.when(
        listed & part.isNotNull(),
        success(
            value - part,
            F.array(step("subtract", F.concat(amount(value), F.lit(" - "), amount(part), F.lit(" ("), component, F.lit(")")))),
        ),
    ).otherwise(refusal(F.concat(F.lit("source does not publish "), component)))


def shared_bases(left: Column, right: Column) -> Column:
    """Bases that both sides can be expressed in, in order; empty when the two are not comparable."""
    return F.array_sort(F.array_intersect(left, right))


def bases(source_id: Column, bonus: Column, contributions: Column) -> Column:
    """Bases a source can express. ``unknown`` and prose satisfy neither true nor false."""
    clean = contributions == "false"
    override = F.try_element_at(F.create_map(*[F.lit(x) for kv in BASIS_BY_SOURCE.items() for x in kv]), source_id)
    found = F.array_compact(
        F.array(
            F.when(clean & (bonus == "false"), "regular_pay"),
            F.when(clean & (bonus == "true"), "total_earnings"),
            F.when(clean, override),
        )
    )
    return F.array_sort(F.array_distinct(found))


def then(first: Column, second: Column) -> Column:
    """Two results in a row: the first refusal stays, chains are appended."""
    return F.when(~first["ok"], first).when(
        second["ok"], success(second["value"], F.concat(first["chain"], second["chain"]))
    ).otherwise(second)
