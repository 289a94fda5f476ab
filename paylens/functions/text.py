"""Column functions over free text: pay ranges, job keys, grams, markup, number cells."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that describe the form of a job, not the job.
FORM_WORDS = (
    "full[- ]?time|part[- ]?time|permanent|contract|remote|hybrid|onsite|on[- ]site|"
    "f/m/d|m/f/d|m/w/d|h/f|w/m/d|new|urgent|hiring|apply now"
)
# Currency codes read in pay text, and the symbols that stand for one.
PAY_CODES = "USD|CAD|EUR|GBP|AUD|NZD|SEK|NOK|DKK|CHF|SGD|INR"
SYMBOL_CURRENCY = {"$": "USD", "£": "GBP", "€": "EUR"}
# A maximum below this without a thousands mark is not pay.
MIN_PAY_MAX = 12.0
HOURLY_MAX_USD = 100.0
# Strings entered in place of a missing value.
FAKE_NULLS = ("n/a", "na", "none", "null", "unknown", "tbd", "-", "")

_LETTER = r"\p{L}\p{N}_"


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def norm(col: Column) -> Column:
    """Lower-case, form words and punctuation dropped, white space collapsed."""
    s = F.lower(F.coalesce(col, F.lit("")))
    s = F.regexp_replace(s, rf"(?<![{_LETTER}])(?:{FORM_WORDS})(?![{_LETTER}])", " ")
    s = F.regexp_replace(s, rf"[^{_LETTER}\s]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def job_key(*cols: Column) -> Column:
    return F.concat_ws(" | ", *[norm(c) for c in cols])


def padded_words(col: Column) -> Column:
    """Words of a text, lower-case, each with one space on both sides."""
    words = F.filter(F.split(F.lower(col), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(t: Column, pattern: str, n: int) -> Column:
    """The groups of the first match as an array, null without a match. ``n`` groups, none may hold U+0001."""
    marks = "\u0001".join(f"${i}" for i in range(1, n + 1))
    flat = F.regexp_replace(t, rf"^(?s:.*?)(?:{pattern})(?s:.*)$", marks)
    return F.when(t.rlike(pattern), F.split(flat, "\u0001"))


def parse_pay(col: Column) -> Column:
    """Pay range of a free text as struct(min, max, currency, period, raw_text, confidence), or null.

    Two numbers must touch a currency sign, or a code must follow the range. A code
    anywhere in the text beats the sign; a thousands mark on the upper number holds for both.
    """
    # How ranges and periods are written
    signed = r"([$£€])\s*([\d.]+)\s*([kK]?)\s*-\s*[$£€]?\s*([\d.]+)\s*([kK]?)"
    coded = rf"(?<![\d.])([\d.]+)\s*-\s*([\d.]+)\s*([kK]?)\s*({PAY_CODES})(?U:\b)"
    signs = F.create_map(*[F.lit(x) for kv in SYMBOL_CURRENCY.items() for x in kv])

    def reading(lo: Column, lo_mark: Column, hi: Column, hi_mark: Column, currency: Column) -> Column:
        many = lambda mark: F.when(mark != "", 1000.0).otherwise(1.0)
        numbers = F.struct(
            (lo.try_cast("double") * many(F.concat(lo_mark, hi_mark))).alias("min"),
            (hi.try_cast("double") * many(hi_mark)).alias("max"),
            currency.alias("currency"),
        )
        return let(
            numbers,
            lambda p: F.when(
                (p["min"] > 0) & (p["min"] <= p["max"]) & (p["max"] >= MIN_PAY_MAX) & p["currency"].isNotNull(), p
            ),
        )

    def whole(t: Column) -> Column:
        code = F.nullif(F.upper(F.regexp_extract(t, rf"(?i)(?U:\b)({PAY_CODES})(?U:\b)", 1)), F.lit(""))
        at = lambda g, i: F.get(g, F.lit(i))
        first = let(
            _groups(t, signed, 5),
            lambda g: reading(at(g, 1), at(g, 2), at(g, 3), at(g, 4), F.coalesce(code, F.try_element_at(signs, at(g, 0)))),
        )
        second = let(
            _groups(t, coded, 4), lambda g: reading(at(g, 0), F.lit(""), at(g, 1), at(g, 2), F.coalesce(code, at(g, 3)))
        )
        period = (
            F.when(t.rlike(r"(?i)/\s*hour|hourly|per\s*hour|(?U:\b)hr(?U:\b)"), "hour")
            .when(t.rlike(r"(?i)/\s*month|monthly|per\s*month"), "month")
            .otherwise("year")
        )
        return let(
            F.coalesce(first, second),
            lambda p: F.when(
                p.isNotNull(),
                F.struct(
                    p["min"].alias("min"),
                    p["max"].alias("max"),
                    p["currency"].alias("currency"),
                    period.alias("period"),
                    F.trim(col).alias("raw_text"),
                    F.lit("parsed_text").alias("confidence"),
                ),
            ),
        )

    return let(F.regexp_replace(F.regexp_replace(col, "[–—]", "-"), ",", ""), whole)


def fix_period(pay: Column) -> Column:
    """A yearly USD range that tops out below an hourly bound, with no thousands mark, is hourly.

    Only the period is changed; the numbers stay as published.
    """
    hourly = (
        (pay["period"] == "year")
        & (pay["currency"] == "USD")
        & (pay["max"] > 0)
        & (pay["max"] < HOURLY_MAX_USD)
        & ~F.coalesce(pay["raw_text"], F.lit("")).rlike(r"\d\s*[kK](?U:\b)")
    )
    return F.when(F.coalesce(hourly, F.lit(False)), pay.withField("period", F.lit("hour"))).otherwise(pay)


def _entity_table() -> Column:
    """Named entities from the standard library's table, as a map column."""
    names = {"apos": "'", **{name: chr(code) for name, code in name2codepoint.items()}}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _decode_entities(col: Column) -> Column:
    """Named and numeric character references, each decoded once.

    The text is cut before every ``&``; a piece that begins with a complete reference is
    replaced by its character (numeric ones through a UTF-32 byte sequence).
    """
    table = _entity_table()

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);", 1)
        hexed = F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]{1,6});", 1)
        dec = F.regexp_extract(piece, "^&#([0-9]{1,7});", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10).cast("int")).when(dec != "", dec.cast("int"))
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))
        named = F.when(name != "", F.try_element_at(table, name))
        rest = F.regexp_replace(piece, "^&[^;]*;", "")
        return F.coalesce(F.concat(F.coalesce(named, numeric), rest), piece)

    return F.when(F.instr(col, "&") > 0, F.array_join(F.transform(F.split(col, "(?=&)"), one), "")).otherwise(col)


def strip_html(col: Column) -> Column:
    """``<p>`` becomes a line break, other tags go, entities are decoded once."""
    return _decode_entities(F.regexp_replace(F.replace(col, F.lit("<p>"), F.lit("\n")), "<[^>]+>", ""))


def number(col: Column, style: str = "plain") -> Column:
    """Published number cells. Suppression marks and prose become null.

    ``plain`` 1,234.5; ``comma`` decimal comma with dotted thousands; ``paren`` also drops ``(n)``.
    """
    s = F.trim(col)
    if style == "comma":
        s = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    elif style == "paren":
        s = F.when(s.rlike(r"^\(.*\)$"), None).otherwise(F.replace(s, F.lit(","), F.lit("")))
    else:
        s = F.replace(s, F.lit(","), F.lit(""))
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def is_fake_null(col: Column) -> Column:
    return F.lower(F.trim(col)).isin(*FAKE_NULLS)


def experience_years(col: Column) -> Column:
    s = F.lower(F.trim(col))
    return F.when(s.startswith("less than"), 0.5).when(s.startswith("more than"), 51.0).otherwise(s.try_cast("double"))


def experience_band(col: Column) -> Column:
    years = experience_years(col)
    return F.when(years < 3, "new_grad").when(years < 6, "mid").when(years.isNotNull(), "senior")


def effective_year(*dates: Column) -> Column:
    """Year of the first text that begins with four digits."""
    return F.coalesce(*[F.substring(d, 1, 4).try_cast("int") for d in dates])


def level_of_title(col: Column) -> Column:
    """Seniority named by a title; the first rule that fires wins."""
    t = F.lower(col)
    edge = lambda words: rf"(?U:\b)(?:{words})(?U:\b)"
    return (
        F.when(t.rlike(edge("intern(?:ship)?")), "intern")
        .when(t.rlike(r"(?U:\b)(?:staff|principal|distinguished|director|head of|vp(?U:\b))"), "staff+")
        .when(t.rlike(edge(r"senior|sr|lead|iii|l3|l4")), "senior")
        .when(t.rlike(edge(r"junior|jr|entry|graduate|new grad|associate|i")), "junior")
    )


def company_label(company: Column, slug: Column) -> Column:
    """The published name, else the slug made readable: short lower-case parts in capitals."""
    parts = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    pretty = F.transform(
        parts,
        lambda w: F.when((F.length(w) <= 3) & (w == F.lower(w)), F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
        ),
    )
    return F.coalesce(F.nullif(company, F.lit("")), F.array_join(pretty, " "))


def month_to_x(col: Column) -> Column:
    """``YYYY-MM`` on a year axis."""
    parts = F.split(col, "-")
    return F.get(parts, F.lit(0)).try_cast("int") + (F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(1)) - 1) / 12.0


# The tokens that name a wage statistic, and names that only look like one.
STATISTIC_TOKENS = "p10|p25|p50|p75|p90|median|mean|average"
NOT_A_STATISTIC = "margin|ci95|ci_95|confidence|stderr|std_err|pct_change_yoy|paid_weekly_hours"
UNIT_CURRENCIES = "usd|eur|gbp|sek|nok|dkk|cad|aud|qar|aed"


def field_family(name: Column) -> Column:
    """struct(prefix, statistic, suffix) of a wage field name, null for other names."""
    pattern = rf"(?i)^(.*?)({STATISTIC_TOKENS})(.*)$"
    token = F.lower(F.regexp_extract(name, pattern, 2))
    statistic = F.when(token == "p50", "median").when(token == "average", "mean").otherwise(token)
    suffix = F.regexp_replace(F.regexp_extract(name, pattern, 3), "(?i)^_(low|high|q1|q3)(?=_|$)", "")
    return F.when(
        name.rlike(pattern) & ~name.rlike(f"(?i){NOT_A_STATISTIC}"),
        F.struct(F.regexp_extract(name, pattern, 1).alias("prefix"), statistic.alias("statistic"), suffix.alias("suffix")),
    )


def unit_in_text(text: Column) -> tuple[Column, Column]:
    """(currency, period) named inside a field or container name."""
    t = F.lower(F.coalesce(text, F.lit("")))
    period = (
        F.when(t.contains("hour"), "hour")
        .when(t.contains("month"), "month")
        .when(t.contains("annual") | t.contains("year"), "year")
    )
    currency = F.nullif(F.upper(F.regexp_extract(t, rf"(?:^|_)({UNIT_CURRENCIES})(?:_|$)", 1)), F.lit(""))
    return currency, period


def resolve_unit(name: Column, container_key: Column, *contexts: tuple[Column, Column]) -> tuple[Column, Column]:
    """Currency and period of a wage field, each on its own: the field's own name, the key of
    its container, then the (currency, period) pairs given, nearest first."""
    fam = field_family(name)
    own_c, own_p = unit_in_text(F.concat(fam["prefix"], fam["suffix"]))
    key_c, key_p = unit_in_text(container_key)
    return (
        F.coalesce(own_c, key_c, *[c for c, _ in contexts]),
        F.coalesce(own_p, key_p, *[p for _, p in contexts]),
    )
