"""Landed tables to long rows: indicator pages, CSV exports, wide years, sheets, arrays and surveys.

Readers take DataFrames of raw text cells, so each works on ``spark.read`` of a folder of any
size. Codes are resolved by a join on a code table or by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.functions import geo, text
from paylens.operators.quantiles import group_quantiles

SERIES = "entity string, metric string, year int, value double"
YEAR_CELL = r"^(19|20)\d{2}(\.0)?[fe]?$"


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """All cells as text; gzip is read as it is."""
    return spark.read.option("header", header).option("sep", sep).option("multiLine", False).csv(path)


def read_indicator(df: DataFrame, page: str, codes: DataFrame | None = None) -> DataFrame:
    """Indicator pages ``[meta, [rows]]`` to (entity, metric, year, value); unknown entities and nulls go.

    ``codes`` maps source codes (column ``code``) to entities; without it ISO codes resolve themselves.
    """
    row = "array<struct<countryiso3code:string,indicator:struct<id:string>,date:string,value:double>>"
    d = df.select(F.explode(F.from_json(F.get_json_object(page, "$[1]"), row)).alias("r"))
    d = d.select(F.col("r.countryiso3code").alias("code"), F.col("r.indicator.id").alias("metric"), F.col("r.date").try_cast("int").alias("year"), F.col("r.value").alias("value"))
    d = d.join(codes, "code") if codes is not None else d.withColumn("entity", geo.to_iso2(F.col("code")))
    return d.filter("entity IS NOT NULL AND value IS NOT NULL AND year IS NOT NULL").select("entity", "metric", "year", "value")


def read_rates(df: DataFrame, page: str, groups: dict[str, str]) -> DataFrame:
    """Indicator pages of exchange rates: as ``read_indicator``, with groups of countries, given by code, as further entities."""
    known = {three: code for code, (three, _) in geo.COVERED.items()} | groups
    codes = df.sparkSession.createDataFrame(sorted(known.items()), "code string, entity string")
    return read_indicator(df, page, F.broadcast(codes))  # covered countries and groups


def read_property(df: DataFrame, area: str, kind: str, unit: str, metrics: dict[tuple[str, str], str], time: str, value: str) -> DataFrame:
    """Quarterly property rows: kind and unit codes together name the series; pairs not listed go."""
    both = F.concat_ws("|", F.trim(F.col(kind)), F.trim(F.col(unit)))
    named = {f"{k}|{u}": name for (k, u), name in metrics.items()}
    return read_sdmx(df.withColumn("__metric", both), area, ["__metric"], time, value, labels={"__metric": named})


def read_sdmx(df: DataFrame, area: str, dims: Sequence[str], time: str, value: str, keep: Column | None = None, labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """SDMX rows to (entity, series, period, value). The series key joins the dimension codes that
    are not blank (``value`` when all are); ``labels`` renames codes and drops those it does not list."""
    d = df.filter(keep) if keep is not None else df
    parts = []
    for c in dims:
        code = text.blank_to_null(F.col(c))
        if labels and c in labels:
            code = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels[c].items() for x in kv]), code)
            d = d.filter(code.isNotNull())
        parts.append(code)
    key = F.nullif(F.concat_ws("_", *parts), F.lit(""))
    out = d.select(
        geo.to_iso2(F.col(area)).alias("entity"), F.coalesce(key, F.lit("value")).alias("series"), F.trim(F.col(time)).alias("period"), F.col(value).try_cast("double").alias("value")
    )
    return out.filter("entity IS NOT NULL AND value IS NOT NULL AND period <> ''")


def mark_projection(df: DataFrame, actuals: DataFrame) -> DataFrame:
    """``is_projection``: later than the last actual year of the same entity, else of all entities."""
    own = actuals.groupBy("entity").agg(F.max("year").alias("__own"))
    whole = F.broadcast(actuals.agg(F.max("year").alias("__all")))  # one row
    d = df.join(own, "entity", "left").join(whole)
    return d.withColumn("is_projection", F.col("year") > F.coalesce("__own", "__all")).drop("__own", "__all")


def read_population(df: DataFrame, variants: Sequence[str], start: int, end: int, last_estimate: int, order: str = "row_no") -> DataFrame:
    """Population export: variant and year filter, thousands to persons, first row of a year wins."""
    entity = F.coalesce(geo.to_iso2(text.blank_to_null(F.col("ISO2_code"))), geo.to_iso2(text.blank_to_null(F.col("ISO3_code"))))
    d = df.filter(F.col("Variant").isin(*variants)).select(
        entity.alias("entity"), F.col("Time").try_cast("double").cast("int").alias("year"), F.col("PopTotal").try_cast("double").alias("p"), F.col("PopDensity").try_cast("double").alias("density"), order
    )
    d = d.filter(F.col("entity").isNotNull() & F.col("p").isNotNull() & F.col("year").between(start, end))
    first = d.groupBy("entity", "year").agg(F.min_by(F.struct("p", "density"), order).alias("r"))
    rows = F.explode(F.array(F.struct(F.lit("total_population").alias("metric"), (F.col("r.p") * 1000).alias("value")), F.struct(F.lit("population_density").alias("metric"), F.col("r.density").alias("value"))))
    out = first.select("entity", "year", rows.alias("m")).select("entity", "m.metric", "year", "m.value")
    return out.filter("value IS NOT NULL").withColumn("is_projection", F.col("year") > last_estimate)


def year_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.strip().isdigit()]


def read_wide_years(df: DataFrame, entity: str, subject: str, subjects: dict[str, str], last_actual: str) -> DataFrame:
    """Every all-digit column is a year; blanks and marks are null; the row says its last actual year."""
    metric = F.try_element_at(F.create_map(*[F.lit(x) for kv in subjects.items() for x in kv]), F.trim(F.col(subject)))
    years = year_columns(df)
    d = df.select(geo.to_iso2(F.col(entity)).alias("entity"), metric.alias("metric"), F.trim(F.col(last_actual)).try_cast("int").alias("__last"), *years)
    long = d.filter("entity IS NOT NULL AND metric IS NOT NULL").unpivot(["entity", "metric", "__last"], years, "year", "cell")
    out = long.withColumns({"year": F.trim("year").cast("int"), "value": text.number(F.col("cell"))}).filter("value IS NOT NULL")
    return out.select("entity", "metric", "year", "value", F.coalesce(F.col("year") > F.col("__last"), F.lit(False)).alias("is_projection"))


def read_header_scan(df: DataFrame, sheet: str, row_no: str, cells: str) -> DataFrame:
    """Sheet rows (cells as an array) to (entity, year, value): the header in force is the last row
    with three or more year-like cells; the entity is the first of three cells that is a country.

    A sheet is one table on a page, so its rows fit one window.
    """
    years = F.transform(cells, lambda c, i: F.when(F.trim(c).rlike(YEAR_CELL), F.struct(i.alias("i"), F.substring(F.trim(c), 1, 4).cast("int").alias("year"))))
    found = F.array_compact(years)
    d = df.withColumn("__h", F.when(F.size(found) >= 3, found))
    w = Window.partitionBy(sheet).orderBy(row_no).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__head", F.last("__h", ignorenulls=True).over(w)).filter("__h IS NULL AND __head IS NOT NULL")
    label = F.get(F.filter(F.slice(cells, 1, 3), lambda c: F.coalesce(F.trim(c), F.lit("")) != ""), F.lit(0))
    d = d.withColumn("entity", geo.to_iso2(label)).filter("entity IS NOT NULL").select("entity", cells, F.explode("__head").alias("h"))
    return d.select("entity", F.col("h.year").alias("year"), F.get(cells, F.col("h.i")).try_cast("double").alias("value")).filter("value IS NOT NULL")


def read_migrant_matrix(df: DataFrame, total_code: int = 900, named_code: int = 364) -> tuple[DataFrame, DataFrame]:
    """Origin x destination stocks. Input (destination, origin_code, origin, year, value).

    Returns (per destination and year: total and the named origin), (origins of the newest year, largest first).
    """
    per = df.groupBy("destination", "year").agg(
        F.max(F.when(F.col("origin_code") == total_code, F.col("value"))).alias("total"), F.max(F.when(F.col("origin_code") == named_code, F.col("value"))).alias("named")
    )
    newest = df.groupBy("destination").agg(F.max("year").alias("year"))
    listed = df.filter((F.col("origin_code") < total_code) & (F.col("value") > 0)).join(newest, ["destination", "year"])
    w = Window.partitionBy("destination").orderBy(F.desc("value"), "origin")  # countries of origin
    return per, listed.withColumn("rank", F.row_number().over(w)).select("destination", "year", "origin", "value", "rank")


def read_rank_panel(df: DataFrame, country: str, year: str, rank: str, prefixes: dict[str, str]) -> DataFrame:
    """Ranked panel: columns found by header prefix, ``ranked_of`` taken over all countries before the filter."""
    found = {name: next(c for c in df.columns if c.lower().startswith(p.lower())) for p, name in prefixes.items() if any(c.lower().startswith(p.lower()) for c in df.columns)}
    d = df.select(F.col(country).alias("__c"), F.col(year).try_cast("double").cast("int").alias("year"), F.col(rank).try_cast("double").cast("int").alias("rank"), *[F.col(c).try_cast("double").alias(n) for n, c in found.items()])
    of = d.filter("year IS NOT NULL AND rank IS NOT NULL").groupBy("year").agg(F.max("rank").alias("ranked_of"))
    kept = d.withColumn("entity", geo.to_iso2(F.col("__c"))).filter("entity IS NOT NULL AND year IS NOT NULL")
    return kept.join(of, "year", "left").select("entity", "year", "rank", "ranked_of", *found)


def read_sections(df: DataFrame, sheet: str, row_no: str, cells: str) -> DataFrame:
    """Sheets with an overall part and a part by strand: (sheet, section, strand, year, score)."""
    first = F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    section = F.when(F.lower(first).startswith("overall scores"), "overall").when(F.lower(first).startswith("policy strand"), "strand")
    w = Window.partitionBy(sheet).orderBy(row_no).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({"__first": first, "__mark": section})
    d = d.withColumns({"section": F.last("__mark", ignorenulls=True).over(w), "__head": F.last(F.when(F.col("__mark") == "strand", F.col(cells)), ignorenulls=True).over(w)})
    d = d.filter(F.col("__first").rlike(r"^\d+$") & F.col("__mark").isNull() & F.col("section").isNotNull())
    scores = F.filter(F.transform(F.slice(cells, 2, F.size(cells)), lambda c, i: F.struct(i.alias("i"), c.try_cast("double").alias("v"))), lambda s: s["v"].isNotNull())
    shown = F.when(F.col("section") == "overall", F.slice(scores, 1, 1)).otherwise(scores)
    out = d.select(sheet, "section", F.col("__first").cast("int").alias("year"), "__head", F.explode(shown).alias("s"))
    return out.select(sheet, "section", F.when(F.col("section") == "strand", F.trim(F.get("__head", F.col("s.i") + 1))).alias("strand"), "year", F.round("s.v", 2).alias("score"))


def read_vintage_csv(df: DataFrame, year: int, iso: str, score: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """Edition whose column names carry the year: the first that exists is taken; decimal commas."""
    pick = lambda names: F.coalesce(*[F.col(f"`{n}`") for n in (x.replace("{year}", str(year)) for x in names) if n in df.columns], F.lit(None).cast("string"))
    d = df.select(F.col(iso).alias("__c"), text.number(pick(score), "comma").alias("score"), text.number(pick(rank), "comma").cast("int").alias("rank"))
    of = F.broadcast(d.agg(F.max("rank").alias("ranked_of")))  # one row
    return d.join(of).withColumn("entity", geo.to_iso2(F.col("__c"))).filter("entity IS NOT NULL").select("entity", F.lit(year).alias("year"), "score", "rank", "ranked_of")


def read_metro_hpi(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Headerless quarterly index (name, code, year, quarter, index, ...): the codes table says which
    city and role (primary, secondary) a code has; the two are never averaged."""
    d = df.select(F.col("_c0").alias("name"), F.col("_c1").alias("code"), F.col("_c2").try_cast("int").alias("year"), F.col("_c3").try_cast("int").alias("quarter"), text.number(F.col("_c4"), "paren").alias("value"))
    out = d.join(codes, "code").filter("value IS NOT NULL")
    return out.select("city", "role", "year", "quarter", "value", F.col("name").contains("(MSAD)").alias("sub_area"))


def read_uk_hpi(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Monthly prices dated dd/mm/yyyy; a row needs a price or an index."""
    d = df.join(regions, df["RegionName"] == regions["region"]).select(
        "city", F.date_format(F.try_to_date("Date", "dd/MM/yyyy"), "yyyy-MM").alias("month"), text.number(F.col("AveragePrice")).alias("avg_price"), text.number(F.col("Index")).alias("index")
    )
    return d.filter("month IS NOT NULL AND coalesce(avg_price, `index`) IS NOT NULL")


def read_month_arrays(df: DataFrame, entity: str, values: str, start: str) -> DataFrame:
    """Arrays that begin in a start month to monthly points; nulls before the first value go with the rest."""
    d = df.select(entity, F.to_date(F.concat(F.substring(start, 1, 7), F.lit("-01"))).alias("__s"), F.posexplode(values).alias("pos", "value"))
    return d.filter("value IS NOT NULL").select(entity, F.date_format(F.add_months("__s", F.col("pos")), "yyyy-MM").alias("month"), "value")


def daily_to_monthly(df: DataFrame, code: str, date: str, value: str, cities: DataFrame) -> DataFrame:
    """Daily index to monthly mean and day count; one code may stand for several cities."""
    m = df.groupBy(code, F.substring(date, 1, 7).alias("month")).agg(F.round(F.avg(value), 2).alias("value"), F.count(value).alias("days"))
    return m.join(cities, code).select("city", "month", "value", "days")


# Parts of a wage series id (industry, occupation, datatype code -> field).
BLS_INDUSTRY, BLS_OCCUPATION = "000000", "151252"


def bls_series_id(area_type: Column, area: Column, datatype: Column) -> Column:
    return F.concat(F.lit("OEU"), area_type, F.lpad(area, 7, "0"), F.lit(BLS_INDUSTRY + BLS_OCCUPATION), datatype)


def read_series_by_id(df: DataFrame, wanted: DataFrame, datatypes: dict[str, str]) -> DataFrame:
    """Responses (series_id, year, value) joined to the series asked for, fields as columns.

    ``wanted``: city, role, area_type, area.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("dt"), F.lit(v).alias("field")) for k, v in datatypes.items()])).alias("k")
    asked = wanted.select("*", kinds).withColumn("series_id", bls_series_id(F.col("area_type"), F.col("area"), F.col("k.dt")))
    d = df.join(asked, "series_id").select("city", "role", "year", F.col("k.field").alias("field"), text.number(F.col("value")).alias("value"))
    return d.groupBy("city", "role", "year").pivot("field", list(datatypes.values())).agg(F.first("value"))


def survey_pay(df: DataFrame, pay: Sequence[str], country: Sequence[str], experience: Sequence[str], role: Sequence[str], wave: str, floor: float = 5_000, ceiling: float = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Survey waves to (pay by band, pay by role). Column names differ by wave: the first present and
    filled wins. A row counts in its band and in ``all``, a row without a band in ``all`` once."""
    pick = lambda names: F.coalesce(*[text.blank_to_null(F.col(f"`{n}`")) for n in names if n in df.columns], F.lit(None).cast("string"))
    d = df.select(F.col(wave).alias("wave"), geo.to_iso2(pick(country)).alias("country"), pick(pay).try_cast("double").alias("pay"), text.experience_band(pick(experience)).alias("band"), pick(role).alias("role"))
    d = d.filter(F.col("country").isNotNull() & F.col("pay").between(floor, ceiling))
    stats = lambda x, key, min_n: _survey_stats(x, ["country", "wave", key], min_n)
    banded = d.withColumn("band", F.explode(F.array_compact(F.array(F.col("band"), F.lit("all")))))
    roles = d.withColumn("role", F.explode(F.filter(F.transform(F.split("role", ";"), lambda r: F.trim(r)), lambda r: r != "")))
    return stats(banded, "band", 1), stats(roles, "role", 3)


def _survey_stats(d: DataFrame, keys: list[str], min_n: int) -> DataFrame:
    med = group_quantiles(d, keys, "pay", {"median": 0.5})
    q = group_quantiles(d, keys, "pay", {"p25": 0.25, "p75": 0.75}, "exclusive").drop("n")
    enough = lambda c: F.when(F.col("n") >= 4, F.bround(c, 0))
    return med.join(q, keys).filter(F.col("n") >= min_n).select(*keys, "n", F.bround("median", 0).alias("median"), enough("p25").alias("p25"), enough("p75").alias("p75"), (F.col("n") < 5).alias("thin"))


def pick_place(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Gazetteer match: same country only, the most populous wins; coordinates already there never move.

    candidates: id, country, wanted_country, lat, lon, population. existing: id, lat, lon.
    """
    same = candidates.filter("country = wanted_country").groupBy("id").agg(F.max_by(F.struct("lat", "lon"), F.struct("population", "lat")).alias("p"))
    out = existing.join(same, "id", "full_outer")
    return out.select("id", F.coalesce("lat", "p.lat").alias("lat"), F.coalesce("lon", "p.lon").alias("lon"))


def table_rows(df: DataFrame, headers: str, cells: str) -> DataFrame:
    """Ranking table rows: the first of three cells that is a country; numeric cells by snake-case header."""
    entity = F.get(F.filter(F.transform(F.slice(cells, 1, 3), geo.to_iso2), lambda c: c.isNotNull()), F.lit(0))
    named = F.arrays_zip(F.transform(headers, lambda h: F.replace(F.lower(F.trim(h)), F.lit(" "), F.lit("_"))).alias("h"), F.col(cells).alias("c"))
    d = df.select(entity.alias("entity"), F.explode(named).alias("x")).filter("entity IS NOT NULL AND x.h <> ''")
    return d.select("entity", F.col("x.h").alias("field"), text.number(F.col("x.c")).alias("value")).filter("value IS NOT NULL")


def regex_pairs(df: DataFrame, key: str, page: str, lo: int = 2000, hi: int = 2099) -> DataFrame:
    """(key, year, value) pairs written close together in a page; the first value of a year wins. Pattern: fixed value."""
    pattern = r"\b(20\d{2})\b[^0-9]{0,40}?(\d{2,3}\.\d{1,2})"
    pairs = F.arrays_zip(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)).alias("y"), F.regexp_extract_all(page, F.lit(pattern), F.lit(2)).alias("v"))
    d = df.select(key, F.posexplode(pairs).alias("pos", "p")).select(key, "pos", F.col("p.y").cast("int").alias("year"), F.col("p.v").cast("double").alias("value"))
    return d.filter(F.col("year").between(lo, hi)).groupBy(key, "year").agg(F.min_by("value", "pos").alias("value"))


def table_numbers(df: DataFrame, row_no: str, cells: str) -> DataFrame:
    """First percentage and first count of four or more digits of each country's first row; notes in brackets dropped."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), " ", " "))
    pct = lambda c: F.regexp_extract(clean(c), r"(\d{1,3}(?:\.\d+)?)\s*%", 1).try_cast("double")
    count = lambda c: F.regexp_extract(F.regexp_replace(clean(c), r"[, ]", ""), r"^(\d{4,})", 1).try_cast("long")
    rest = F.slice(cells, 2, F.size(cells))
    d = df.filter(F.size(cells) >= 3).select(
        row_no, geo.to_iso2(clean(F.get(cells, F.lit(0)))).alias("entity"),
        F.get(F.filter(F.transform(rest, pct), lambda v: v.between(0, 100)), F.lit(0)).alias("pct"),
        F.get(F.filter(F.transform(rest, count), lambda v: v.isNotNull()), F.lit(0)).alias("count"),
    )
    d = d.filter("entity IS NOT NULL AND (pct IS NOT NULL OR `count` IS NOT NULL)")
    return d.groupBy("entity").agg(F.min_by(F.struct("pct", "count"), row_no).alias("r")).select("entity", "r.pct", "r.count")


#: Spellings of rankings besides the covered names.
OTHER_SPELLINGS = {"United Kingdom": "GB", "United States": "US", "United Arab Emirates": "AE"}


def trie_pattern(words: Sequence[str]) -> str:
    """A pattern for any of the words, longest first, that shares their beginnings: a text is walked once, however many there are."""
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [re.escape(ch) + written(below) for ch, below in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + ("?" if "" in node else "")

    return written(tree)


def scrape_lines(df: DataFrame, line_no: str, line: str, lo: float, hi: float, spellings: dict[str, str] | None = None) -> DataFrame:
    """Ranking lines ``rank Country score``, several to a line: the number after the name, in range;
    lines with a rank first, then decimal scores, then the earliest.

    ``spellings`` maps every way a name is written to its code; each line is matched once against all.
    A name inside a longer one that is written there too does not count.
    """
    codes = spellings if spellings is not None else {name: code for code, (_, name) in geo.COVERED.items()} | OTHER_SPELLINGS
    # the score is only looked at, because it can be the rank of the next name
    pattern = rf"(?:(\d{{1,3}})\s+)?({trie_pattern(list(codes))})(?=\s+(\d+(?:\.\d+)?))"
    group = lambda k: F.regexp_extract_all(line, F.lit(pattern), F.lit(k))
    hits = F.arrays_zip(group(1).alias("rank"), group(2).alias("name"), group(3).alias("score"))
    d = df.filter(~F.contains(line, F.lit("(cid:"))).select(line_no, line, F.posexplode(hits).alias("pos", "h"))
    entity = F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("h.name"))
    d = d.select(line_no, line, "pos", entity.alias("entity"), F.col("h.score").try_cast("double").alias("score"), F.nullif("h.rank", F.lit("")).try_cast("int").alias("rank"))
    d = d.filter(F.col("score").between(lo, hi))
    order = F.struct(F.col("rank").isNull().alias("a"), (F.col("score") == F.floor("score")).alias("b"), line_no, "pos")
    return d.groupBy("entity").agg(F.min_by(F.struct("score", "rank", line), order).alias("r")).select("entity", "r.score", "r.rank", F.col(f"r.{line}").alias("source_line"))


def read_capture(df: DataFrame, fx: DataFrame, cities: DataFrame) -> DataFrame:
    """Captured medians at pinned rates (per USD) to USD; a city without one gets its reason."""
    d = cities.join(df.select("city", "currency", "median"), "city", "left").join(fx, "currency", "left")
    usd = F.round(F.col("median") / F.col("rate"), 0)
    return d.select("city", "currency", F.col("median").alias("median_original"), usd.alias("median_usd"), F.when(F.col("median").isNull(), "not captured").when(F.col("rate").isNull(), "no pinned rate").alias("reason"))


# ------------------------------------------------------------- wage sources


def wages_es(df: DataFrame, occupation: str, sex: str = "Both genders") -> DataFrame:
    """Named series (name, points): those of one occupation and sex, newest point of each measure."""
    prefix = f"National Total. Base data. {sex}. {occupation}."
    d = df.withColumn("__n", F.trim("name")).filter(F.col("__n").startswith(prefix) & (F.size("points") > 0))
    newest = F.element_at("points", -1)
    return d.select(F.trim(F.expr(f"substring(__n, {len(prefix) + 1})")).alias("measure"), newest["value"].alias("value"), newest["year"].alias("year"))


def wages_nl(df: DataFrame, code: str, period: str) -> DataFrame:
    """Annual rows only: period codes that end in JJ00."""
    return df.filter(F.col(period).endswith("JJ00")).withColumns({"national_code": F.trim(F.col(code)), "year": F.substring(period, 1, 4).cast("int")})


def wages_de(df: DataFrame, code: str, wanted: str, cols: dict[str, str]) -> DataFrame:
    """One exact code row; suppressed cells are null, decimals use a comma."""
    return df.filter(F.trim(F.col(code)) == wanted).select(F.lit(wanted).alias("national_code"), *[text.number(F.col(c), "comma").alias(n) for c, n in cols.items()])


def wages_uk(values: DataFrame, cv: DataFrame, code: str, cols: Sequence[str]) -> DataFrame:
    """Values beside the quality figure of the same cell."""
    v = values.select(F.trim(F.col(code)).alias("national_code"), *[text.number(F.col(c)).alias(f"{c}_gbp_year") for c in cols])
    q = cv.select(F.trim(F.col(code)).alias("national_code"), *[text.number(F.col(c)).alias(f"{c}_cv_pct") for c in cols])
    return v.join(q, "national_code", "left")


def wages_ca(df: DataFrame, code: str, region: str, national: str, cols: dict[str, str]) -> DataFrame:
    out = df.select(F.regexp_replace(F.trim(F.col(code)), "^NOC_", "").alias("national_code"), F.trim(F.col(region)).alias("region"), *[text.number(F.col(c)).alias(n) for c, n in cols.items()])
    return out.withColumn("is_national", F.col("region") == national)


def wages_au(df: DataFrame, label: str, sex: str, total: str, concepts: dict[str, tuple[str, str]]) -> DataFrame:
    """Total-sex rows; ``code title`` split; one row per income concept (mean column, median column)."""
    d = df.filter(F.trim(F.col(sex)) == total).withColumn("__l", F.trim(F.col(label)))
    rows = [F.struct(F.lit(k).alias("concept"), text.number(F.col(m)).alias("mean_aud_year"), text.number(F.col(md)).alias("median_aud_year")) for k, (m, md) in concepts.items()]
    d = d.select(F.regexp_extract("__l", r"^(\d+)\s+(.*)$", 1).alias("national_code"), F.regexp_extract("__l", r"^(\d+)\s+(.*)$", 2).alias("title"), F.explode(F.array(*rows)).alias("c"))
    return d.filter("national_code <> ''").select("national_code", "title", "c.*")


def wages_qa(df: DataFrame, year: str, sex: str, sexes: Sequence[str], wage: str, workers: str) -> DataFrame:
    """Wage and workers by sex side by side, with their weighted mean."""
    a, b = sexes
    at = lambda col, s: F.max(F.when(F.col(sex) == s, F.col(col).try_cast("double")))
    d = df.groupBy(year).agg(at(wage, a).alias("wa"), at(wage, b).alias("wb"), F.coalesce(at(workers, a), F.lit(0.0)).alias("na"), F.coalesce(at(workers, b), F.lit(0.0)).alias("nb"))
    return d.withColumn("weighted_mean_qar_month", F.try_divide(F.col("wa") * F.col("na") + F.col("wb") * F.col("nb"), F.col("na") + F.col("nb")))


def without_series(df: DataFrame) -> DataFrame:
    """Countries without a series (country, source_id, evidence_date, explanation) with their status."""
    return df.withColumn("status", F.lit("no_series"))


def no_series_rows(spark: SparkSession, rows: Sequence[tuple[str, str, str | None, str | None]]) -> DataFrame:
    """As ``without_series``, of literal rows."""
    return without_series(spark.createDataFrame(list(rows), "country string, source_id string, evidence_date string, explanation string"))


def read_items(cells: DataFrame, dim: str, items: dict[str, str], entity: str, year: str) -> DataFrame:
    """Cube cells to an annual series: item codes to metric names, EU code taken out of the country list by the caller."""
    metric = F.try_element_at(F.create_map(*[F.lit(x) for kv in items.items() for x in kv]), F.try_element_at("coords", F.lit(dim)))
    geo_code = F.try_element_at("coords", F.lit(entity))
    return cells.select(
        F.when(geo_code == "UK", "GB").otherwise(geo_code).alias("entity"), metric.alias("metric"), F.try_element_at("coords", F.lit(year)).try_cast("int").alias("year"), "value"
    ).filter("metric IS NOT NULL")


def split_benchmark(series: DataFrame, code: str = "EU27_2020") -> tuple[DataFrame, DataFrame]:
    """(countries, the union's own rows)."""
    return series.filter(F.col("entity") != code), series.filter(F.col("entity") == code)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Curated part files, each a document with ``records``."""
    return spark.read.schema(f"records array<{schema}>").option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")
