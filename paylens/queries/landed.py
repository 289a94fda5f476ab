"""The remaining readers, each over rows of its shape made of whole tables, with all of its columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.plans import wages
from paylens.queries.boards import ISO2, ISO3, PLACE, PLACE_CODE, YEARLY, yearly
from paylens.queries.common import WITH, r, table
from paylens.queries.registry import query
from paylens.sources import cubes, sinks, tables
from paylens.sources import postings as boards

OWNED = "owned AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey)"


def owned(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey)


@query(
    "board_job_list",
    WITH(OWNED)
    + f"""SELECT 'ashby:c' || o_custkey || ':' || o_orderkey AS id, 'ashby' AS provider, CASE WHEN o_custkey % 9 <> 0 THEN c_name END AS company, 'c' || o_custkey AS company_slug, 'Job ' || o_orderkey AS title, {PLACE} AS location_raw,
  {PLACE_CODE} AS country, o_orderkey % 3 = 0 AS remote, CASE WHEN o_orderkey % 2 = 0 THEN 'job' ELSE 'apply' END || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS posted_at,
  CASE k WHEN 0 THEN o_totalprice WHEN 1 THEN 25.0 WHEN 4 THEN o_totalprice END AS min, CASE k WHEN 0 THEN o_totalprice + 10 WHEN 1 THEN 25.0 WHEN 4 THEN o_totalprice END AS max, CASE WHEN k IN (0, 1, 4) THEN 'EUR' END AS currency,
  CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'hour' WHEN 4 THEN 'month' END AS period, CASE k WHEN 0 THEN 'tier one' WHEN 1 THEN 'tier two' WHEN 4 THEN 'whole' END AS raw_text FROM (SELECT *, o_orderkey % 5 AS k FROM owned)""",
)
def board_job_list(spark, sf):
    """First component unusable, twice-monthly pay, no pay at all, a tier without a summary of its own."""
    k = F.col("o_orderkey") % 5
    part = lambda lo, hi, interval: F.struct(F.lit(lo).cast("double").alias("minValue") if not hasattr(lo, "cast") else lo.alias("minValue"), hi.cast("double").alias("maxValue"), F.lit("EUR").alias("currencyCode"), F.lit(interval).alias("interval"))
    pay, none = F.col("o_totalprice"), F.lit(None)
    tier = lambda summary, *parts: F.struct(F.lit(summary).alias("tierSummary"), F.array(*parts).alias("components"))
    yearly_, hourly = tier("tier one", part(pay, pay + 10, "1 YEAR")), tier("tier two", part(25.0, none, "1 HOUR"))
    tiers = (
        F.when(k == 0, F.array(yearly_, hourly))
        .when(k == 1, F.array(tier("tier one", part(0.0, pay, "1 YEAR")), hourly))
        .when(k == 2, F.array(tier("tier one", part(pay, pay, "semi-month"))))
        .when(k == 4, F.array(tier("", part(pay, none, "1 MONTH"))))
    )
    job = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Job "), "o_orderkey").alias("title"), F.expr(PLACE).alias("location"), (F.col("o_orderkey") % 3 == 0).alias("isRemote"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("job"), "o_orderkey")).alias("jobUrl"), F.concat(F.lit("apply"), "o_orderkey").alias("applyUrl"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("publishedAt"),
        F.when(k != 3, F.struct(F.lit("whole").alias("compensationTierSummary"), tiers.alias("compensationTiers"))).alias("compensation"),
    )
    name = F.when(F.col("o_custkey") % 9 != 0, F.col("c_name")).otherwise("")
    d = owned(spark, sf).groupBy(F.concat(F.lit("c"), "o_custkey").alias("token"), name.alias("organizationName")).agg(F.collect_list(job).alias("jobs"))  # jobs of one company
    p = boards.postings_ashby(d)
    c = F.col("compensation")
    names = ("min", "max", "currency", "period", "raw_text")
    return p.select("id", "provider", "company", "company_slug", "title", "location_raw", "country", "remote", "url", "posted_at", *[c[n].alias(n) for n in names])


STOCK = f"""{OWNED}, stock AS (SELECT c_nationkey AS destination, CASE o_custkey % 40 WHEN 0 THEN 900 WHEN 1 THEN 364 ELSE 100 + o_custkey % 40 END AS origin_code, 'o' || (o_custkey % 40) AS origin, year(o_orderdate)::INTEGER AS year, count(*) AS value FROM owned GROUP BY ALL)"""


def stock(spark, sf):
    at = F.col("o_custkey") % 40
    code = F.when(at == 0, 900).when(at == 1, 364).otherwise(100 + at)
    d = owned(spark, sf)
    return d.groupBy(F.col("c_nationkey").alias("destination"), code.alias("origin_code"), F.concat(F.lit("o"), at).alias("origin"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("value"))


@query("migrant_totals", WITH(STOCK) + "SELECT destination, year, max(value) FILTER (origin_code = 900) AS total, max(value) FILTER (origin_code = 364) AS named FROM stock GROUP BY ALL")
def migrant_totals(spark, sf):
    return tables.read_migrant_matrix(stock(spark, sf))[0].select("destination", "year", "total", "named")


@query(
    "migrant_origins",
    WITH(STOCK)
    + """SELECT destination, year, origin, value, row_number() OVER (PARTITION BY destination ORDER BY value DESC, origin)::INTEGER AS rank FROM (SELECT *, max(year) OVER (PARTITION BY destination) AS newest FROM stock) WHERE origin_code < 900 AND value > 0 AND year = newest""",
)
def migrant_origins(spark, sf):
    return tables.read_migrant_matrix(stock(spark, sf))[1]


COUNTRY = "CASE {k} % 4 WHEN 0 THEN 'Sweden' WHEN 1 THEN 'Norway' WHEN 2 THEN 'Germany' ELSE 'Atlantis' END"
COUNTRY_CODE = "CASE {k} % 4 WHEN 0 THEN 'SE' WHEN 1 THEN 'NO' WHEN 2 THEN 'DE' END"


@query(
    "rank_panel",
    f"""WITH p AS (SELECT {COUNTRY_CODE.format(k="c_nationkey")} AS entity, (2000 + c_custkey % 9)::INTEGER AS year, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 147)::INTEGER END AS rank, c_acctbal AS score, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 8 END AS gdp FROM customer)
SELECT entity, p.year, rank, ranked_of, score, gdp FROM p JOIN (SELECT year, max(rank) AS ranked_of FROM p GROUP BY year) USING (year) WHERE entity IS NOT NULL""",
)
def rank_panel(spark, sf):
    """The largest rank of a year counts countries that are not covered as well."""
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(
        F.expr(COUNTRY.format(k="c_nationkey")).alias("Country name"), (2000 + k % 9).cast("double").cast("string").alias("Year"), F.when(k % 11 != 0, (k % 147).cast("string")).otherwise("").alias("Rank"),
        F.col("c_acctbal").cast("string").alias("Ladder score (mean)"), F.when(k % 5 != 0, (F.col("c_acctbal") / 8).cast("string")).otherwise("").alias("Explained by: GDP"),
    )
    return tables.read_rank_panel(d, "Country name", "Year", "Rank", {"ladder score": "score", "explained by": "gdp"})


@query(
    "series_by_id",
    """SELECT s_suppkey AS city, 'dev' AS role, y::VARCHAR AS year, CASE WHEN s_suppkey % 7 <> 0 THEN round(s_acctbal + y, 2) END AS mean, round(s_acctbal - 1, 2) AS median FROM supplier, (VALUES (2023), (2024)) t(y)""",
)
def series_by_id(spark, sf):
    s = table(spark, sf, "supplier")
    wanted = s.select(F.col("s_suppkey").alias("city"), F.lit("dev").alias("role"), F.lit("M").alias("area_type"), F.col("s_suppkey").cast("string").alias("area"))
    years = s.select("s_suppkey", "s_acctbal", F.explode(F.array(F.lit(2023), F.lit(2024))).alias("y"))
    number = F.concat(F.lit("OEUM"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"), F.lit(tables.BLS_INDUSTRY + tables.BLS_OCCUPATION))
    mean = F.when(F.col("s_suppkey") % 7 != 0, F.format_string("%.2f", F.col("s_acctbal") + F.col("y"))).otherwise("-")
    rows = F.explode(F.array(F.struct(F.lit("04").alias("dt"), mean.alias("value")), F.struct(F.lit("13").alias("dt"), F.format_string("%.2f", F.col("s_acctbal") - 1).alias("value")), F.struct(F.lit("99").alias("dt"), F.lit("1").alias("value"))))
    d = years.select(number.alias("n"), F.col("y").cast("string").alias("year"), rows.alias("r")).select(F.concat("n", "r.dt").alias("series_id"), "year", "r.value")
    return tables.read_series_by_id(d, wanted, {"04": "mean", "13": "median"})


@query(
    "gazetteer",
    """WITH c AS (SELECT c_custkey % 500 AS id, c_acctbal AS lat, -c_acctbal AS lon, row_number() OVER (PARTITION BY c_custkey % 500 ORDER BY c_custkey % 97 DESC, c_acctbal DESC) AS n FROM customer WHERE c_nationkey % 3 = c_custkey % 3),
e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 1.5 END AS lat, CASE WHEN s_suppkey % 2 = 0 THEN 2.5 END AS lon FROM supplier)
SELECT id, coalesce(e.lat, c.lat)::DOUBLE AS lat, coalesce(e.lon, c.lon)::DOUBLE AS lon FROM e FULL JOIN (FROM c WHERE n = 1) c USING (id)""",
)
def gazetteer(spark, sf):
    """The most populous of the same country; coordinates that are there stay."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select((k % 500).alias("id"), (F.col("c_nationkey") % 3).alias("country"), (k % 3).alias("wanted_country"), F.col("c_acctbal").alias("lat"), (-F.col("c_acctbal")).alias("lon"), (k % 97).alias("population"))
    there = F.col("s_suppkey") % 2 == 0
    e = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(there, 1.5).alias("lat"), F.when(there, 2.5).alias("lon"))
    return tables.pick_place(c, e)


@query(
    "ranking_rows",
    f"""SELECT entity, field, value FROM (SELECT {COUNTRY_CODE.format(k="s_suppkey")} AS entity, unnest(['cost_index', 'rent_index']) AS field, unnest([s_acctbal, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal + 1 END]) AS value FROM supplier)
WHERE entity IS NOT NULL AND value IS NOT NULL""",
)
def ranking_rows(spark, sf):
    """The country stands in the second or the third cell; a word is no number."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    name, text_of = F.expr(COUNTRY.format(k="s_suppkey")), lambda c: F.format_string("%.2f", c)
    second = F.when(k % 5 != 0, text_of(bal + 1)).otherwise("n/a")
    cells = F.when(k % 2 == 0, F.array(F.lit("x"), name, text_of(bal), second)).otherwise(F.array(F.lit("y"), name, text_of(bal), second))
    headers = F.array(F.lit(""), F.lit("Country"), F.lit(" Cost Index"), F.lit("Rent Index"))
    return tables.table_rows(table(spark, sf, "supplier").select(headers.alias("h"), cells.alias("c")), "h", "c").filter("field <> 'country'")


PAIRS = r"\b(20\d{2})\b[^0-9]{0,40}?(\d{2,3}\.\d{1,2})"


@query(
    "text_pairs",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') || ' 20' || lpad((doc_id % 30)::VARCHAR, 2, '0') || ' stood at ' || (10 + doc_id % 90) || '.5, 2024 and then 77.25' AS page FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(page, '{PAIRS}', 1)) AS y, unnest(regexp_extract_all(page, '{PAIRS}', 2)) AS v, generate_subscripts(regexp_extract_all(page, '{PAIRS}', 1), 1) AS pos FROM d)
SELECT doc_id, y::INTEGER AS year, arg_min(v::DOUBLE, pos) AS value FROM p GROUP BY ALL""",
)
def text_pairs(spark, sf):
    n = F.col("doc_id")
    page = F.concat(F.coalesce("text", F.lit("")), F.lit(" 20"), F.lpad((n % 30).cast("string"), 2, "0"), F.lit(" stood at "), (10 + n % 90).cast("string"), F.lit(".5, 2024 and then 77.25"))
    return tables.regex_pairs(table(spark, sf, "documents").select("doc_id", page.alias("page")), "doc_id", "page")


@query(
    "table_numbers",
    f"""WITH t AS (SELECT c_custkey, {COUNTRY_CODE.format(k="c_custkey")} AS entity, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 100) + 0.5::DOUBLE END AS pct, CASE WHEN c_custkey % 5 <> 0 THEN 1000 + c_custkey END AS count FROM customer)
SELECT entity, arg_min(pct, c_custkey) AS pct, arg_min("count", c_custkey)::BIGINT AS count FROM (SELECT entity, c_custkey, {{'p': pct}} AS x, pct, "count", min(c_custkey) OVER (PARTITION BY entity) AS first FROM t WHERE entity IS NOT NULL AND (pct IS NOT NULL OR "count" IS NOT NULL)) WHERE c_custkey = first GROUP BY entity""",
)
def table_numbers(spark, sf):
    """Each country's first row that holds a number; notes in brackets and thousands' commas go."""
    k = F.col("c_custkey")
    cells = F.array(F.concat(F.expr(COUNTRY.format(k="c_custkey")), F.lit("[a]")), F.when(k % 5 != 0, F.concat(F.format_number(1000 + k, 0), F.lit("[1]"))).otherwise("12"), F.when(k % 6 != 0, F.concat(F.format_string("%.1f", (k % 100) + 0.5), F.lit(" %"))).otherwise("none"))
    return tables.table_numbers(table(spark, sf, "customer").select(k.alias("n"), cells.alias("c")), "n", "c")


RANKED = ("Germany", "Sweden", "Norway", "United Kingdom", "Finland", "Canada", "Ireland", "United States")
RANKED_CODES = ("DE", "SE", "NO", "GB", "FI", "CA", "IE", "US")
NAMED = "CASE {k} % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(RANKED)) + " END"


@query(
    "ranking_lines",
    f"""WITH l AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 150) || ' ' ELSE '' END || {NAMED.format(k="o_custkey")} || ' ' || (o_custkey % 90) || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END || ' '
    || {NAMED.format(k="(o_custkey + o_orderkey)")} || ' chart' || CASE WHEN o_orderkey % 13 = 0 THEN ' (cid:7)' ELSE '' END AS line FROM orders),
names AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{n}')" for c, n in zip(RANKED_CODES, RANKED))}) t(entity, name)),
h AS (SELECT entity, n, line, regexp_extract(line, '(?:(\\d{{1,3}})\\s+)?' || name || '\\s+(\\d+(?:\\.\\d+)?)', 1) AS rank, regexp_extract(line, '(?:(\\d{{1,3}})\\s+)?' || name || '\\s+(\\d+(?:\\.\\d+)?)', 2) AS score FROM l, names WHERE NOT contains(line, '(cid:'))
SELECT entity, score::DOUBLE AS score, nullif(rank, '')::INTEGER AS rank, line AS source_line FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rank = '', NOT contains(score, '.'), n) AS best FROM h WHERE score <> '' AND score::DOUBLE BETWEEN 20 AND 80) WHERE best = 1""",
)
def ranking_lines(spark, sf):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.concat(
        F.when(n % 3 != 0, F.concat((n % 150).cast("string"), F.lit(" "))).otherwise(""), F.expr(NAMED.format(k="o_custkey")), F.lit(" "), (c % 90).cast("string"), F.when(n % 2 == 0, ".5").otherwise(""), F.lit(" "),
        F.expr(NAMED.format(k="(o_custkey + o_orderkey)")), F.lit(" chart"), F.when(n % 13 == 0, " (cid:7)").otherwise(""),
    )
    return tables.scrape_lines(table(spark, sf, "orders").select(n.alias("n"), line.alias("line")), "n", "line", 20, 80)


MONEY = "CASE c_nationkey % 4 WHEN 0 THEN 'SEK' WHEN 1 THEN 'EUR' WHEN 2 THEN 'NOK' ELSE 'XXX' END"


@query(
    "captured_medians",
    f"""WITH c AS (SELECT c_custkey AS city, CASE WHEN c_custkey % 3 <> 0 THEN {MONEY} END AS currency, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS median FROM customer), f AS (SELECT * FROM (VALUES ('SEK', 10.0::DOUBLE), ('EUR', 0.8::DOUBLE), ('NOK', 11.0::DOUBLE)) t(currency, rate))
SELECT city, c.currency, median AS median_original, round(median / rate) AS median_usd, CASE WHEN median IS NULL THEN 'not captured' WHEN rate IS NULL THEN 'no pinned rate' END AS reason FROM c LEFT JOIN f USING (currency)""",
)
def captured_medians(spark, sf):
    c = table(spark, sf, "customer")
    captured = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("city"), F.expr(MONEY).alias("currency"), F.col("c_acctbal").alias("median"))
    fx = spark.createDataFrame([("SEK", 10.0), ("EUR", 0.8), ("NOK", 11.0)], "currency string, rate double")
    return tables.read_capture(captured, fx, c.select(F.col("c_custkey").alias("city")))


@query("wage_table_es", "SELECT 'M' || s_suppkey AS measure, s_acctbal + 2 AS value, 2022 AS year FROM supplier WHERE s_suppkey % 4 NOT IN (0, 1)")
def wage_table_es(spark, sf):
    """Other sexes and series without points go; the newest point counts."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    point = lambda y, v: F.struct(F.lit(y).alias("year"), v.alias("value"))
    points = F.when(k % 4 == 1, F.array().cast("array<struct<year:int,value:double>>")).otherwise(F.array(point(2018, bal), point(2022, bal + 2)))
    name = F.concat(F.when(k % 4 == 0, "National Total. Base data. Men. IT. ").otherwise(" National Total. Base data. Both genders. IT. "), F.lit("M"), k.cast("string"))
    return tables.wages_es(table(spark, sf, "supplier").select(name.alias("name"), points.alias("points")), "IT")


@query(
    "hours_fallback",
    WITH(YEARLY) + "SELECT c_nationkey, y, CASE WHEN c_nationkey % 3 <> 0 THEN v ELSE n::DOUBLE END AS v, CASE WHEN c_nationkey % 3 <> 0 THEN 'sector' ELSE 'all sectors' END AS sector FROM y",
)
def hours_fallback(spark, sf):
    """Nations without a series of their own sector take that of all sectors."""
    d = yearly(spark, sf)
    primary = d.filter("c_nationkey % 3 <> 0").select("c_nationkey", "y", "v")
    return cubes.with_fallback(primary, d.select("c_nationkey", "y", F.col("n").cast("double").alias("v")), "c_nationkey", "sector", "sector", "all sectors")


ITEMS = {"1": "urgent_pay", "5": "low_pay"}
ITEM_CELLS = """cell AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'UK' WHEN 1 THEN 'EU27_2020' ELSE 'SE' END AS geo, left(o_orderpriority, 1) AS item, year(o_orderdate)::INTEGER AS year, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
items AS (SELECT CASE geo WHEN 'UK' THEN 'GB' ELSE geo END AS entity, CASE item WHEN '1' THEN 'urgent_pay' WHEN '5' THEN 'low_pay' END AS metric, year, value FROM cell WHERE item IN ('1', '5'))"""


def item_cells(spark, sf):
    geo = F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'UK' WHEN 1 THEN 'EU27_2020' ELSE 'SE' END")
    d = owned(spark, sf).groupBy(geo.alias("geo"), F.substring("o_orderpriority", 1, 1).alias("item"), F.year("o_orderdate").cast("string").alias("time")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return d.select(F.create_map(F.lit("geo"), "geo", F.lit("na_item"), "item", F.lit("time"), "time").alias("coords"), "value")


@query("employment_items", WITH(ITEM_CELLS) + "SELECT entity, metric, year, value FROM items")
def employment_items(spark, sf):
    return tables.read_items(item_cells(spark, sf), "na_item", ITEMS, "geo", "time")


@query("union_benchmark", WITH(ITEM_CELLS) + "SELECT i.entity, i.metric, i.year, i.value, b.value AS benchmark FROM items i LEFT JOIN (FROM items WHERE entity = 'EU27_2020') b USING (metric, year) WHERE i.entity <> 'EU27_2020'")
def union_benchmark(spark, sf):
    """Countries beside the union's own row of the same metric and year."""
    countries, union = tables.split_benchmark(tables.read_items(item_cells(spark, sf), "na_item", ITEMS, "geo", "time"))
    return countries.join(union.select("metric", "year", F.col("value").alias("benchmark")), ["metric", "year"], "left")


GROUPS = {"EMU": "EA", "EUU": "EU", "OED": "OECD", "WLD": "WORLD", "HIC": "HIGH_INCOME"}


@query(
    "fx_pages",
    WITH(YEARLY) + "SELECT CASE c_nationkey % 8 WHEN 0 THEN 'EA' WHEN 1 THEN 'EU' WHEN 2 THEN 'OECD' WHEN 3 THEN 'WORLD' WHEN 4 THEN 'HIGH_INCOME' WHEN 5 THEN 'SE' WHEN 6 THEN 'NO' END AS entity, 'PA.NUS.FCRF' AS metric, y AS year, round(v / n, 4) AS value FROM y WHERE c_nationkey % 8 <> 7",
)
def fx_pages(spark, sf):
    """Indicator pages of exchange rates: groups of countries count as entities of their own, codes nobody knows go."""
    code = F.expr("CASE c_nationkey % 8 WHEN 0 THEN 'EMU' WHEN 1 THEN 'EUU' WHEN 2 THEN 'OED' WHEN 3 THEN 'WLD' WHEN 4 THEN 'HIC' WHEN 5 THEN 'SWE' WHEN 6 THEN 'NOR' ELSE 'QQQ' END")
    row = F.struct(code.alias("countryiso3code"), F.struct(F.lit("PA.NUS.FCRF").alias("id")).alias("indicator"), F.col("y").cast("string").alias("date"), F.round(F.col("v") / F.col("n"), 4).alias("value"))
    pages = yearly(spark, sf).groupBy("c_nationkey").agg(F.to_json(F.collect_list(row)).alias("rows"))
    return tables.read_rates(pages.select(F.concat(F.lit('[{"page":1},'), "rows", F.lit("]")).alias("page")), "page", GROUPS)


@query(
    "property_rows",
    f"WITH {YEARLY} SELECT {ISO2} AS entity, CASE WHEN n % 2 = 0 THEN 'nominal_index' ELSE 'real_change' END AS series, y || '-Q' || (1 + n % 4) AS period, v AS value FROM y WHERE n % 5 <> 0",
)
def property_rows(spark, sf):
    """Quarterly property prices: value and unit codes together name the metric; other pairs go."""
    n = F.col("n")
    d = yearly(spark, sf).select(
        F.expr(ISO3).alias("REF_AREA"), F.when(n % 5 == 0, "Z").when(n % 2 == 0, "N").otherwise("R").alias("VALUE"), F.when(n % 2 == 0, "628").otherwise("771").alias("UNIT_MEASURE"),
        F.concat(F.col("y").cast("string"), F.lit("-Q"), (1 + n % 4).cast("string")).alias("TIME_PERIOD"), F.format_string("%.2f", "v").alias("OBS_VALUE"),
    )
    return tables.read_property(d, "REF_AREA", "VALUE", "UNIT_MEASURE", {("N", "628"): "nominal_index", ("R", "771"): "real_change"}, "TIME_PERIOD", "OBS_VALUE")


@query(
    "no_series",
    "SELECT s_name AS country, 'salary_' || s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN '2024-01' END AS evidence_date, 'not published' AS explanation, 'no_series' AS status FROM supplier",
)
def no_series(spark, sf):
    k = F.col("s_suppkey")
    d = table(spark, sf, "supplier").select(F.col("s_name").alias("country"), F.concat(F.lit("salary_"), k).alias("source_id"), F.when(k % 2 == 0, "2024-01").alias("evidence_date"), F.lit("not published").alias("explanation"))
    return tables.without_series(d)


@query(
    "payload_digests",
    """SELECT c_custkey, sha256('c_name=' || coalesce('''' || c_name || '''', 'null') || chr(10) || 'c_mktsegment=' || coalesce('''' || CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END || '''', 'null')) AS digest FROM customer""",
)
def payload_digests(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return d.select("c_custkey", sinks.payload_digest(["c_name", "c_mktsegment"]).alias("digest"))


YEARS_OF_SOURCE = (2020, 2021)


def published(k: int) -> dict[str, str]:
    """Value of each field of the ``k``-th source, as SQL of both engines: some are not published by every supplier."""
    return {
        "mean": f"s_acctbal + y + {k}", "median": f"CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + {k} END", "p10": "CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal - 500 END",
        "p25": "CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal - 100 END", "p75": "CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal + 100 END", "p90": "CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 500 END",
    }


def extractor_sql() -> str:
    """Every source's newest year, its fields under common names, and the spread that they make."""
    parts = []
    for k, (source, (country, period, currency, _)) in enumerate(wages.SOURCES.items()):
        fields = ", ".join(f"round(({v})::DOUBLE, 4) AS {f}" for f, v in published(k).items())
        parts.append(f"SELECT '{country}' AS country, '{source}' AS source_id, s_suppkey::VARCHAR AS national_code, y AS year, '{period}' AS period, '{currency}' AS currency, {fields}, s_suppkey::DOUBLE AS n_employees FROM supplier, (SELECT {YEARS_OF_SOURCE[1]} AS y)")
    spread = "CASE WHEN p10 IS NOT NULL AND p90 IS NOT NULL THEN 'full' WHEN p25 IS NOT NULL AND p75 IS NOT NULL THEN 'quartile-only' WHEN median IS NOT NULL THEN 'central-tendency-only' ELSE 'mean-only' END"
    return f"SELECT *, {spread} AS distribution FROM ({' UNION ALL '.join(parts)})"


@query("wage_extractors", extractor_sql())
def wage_extractors(spark, sf):
    """Fourteen sources with their own field names, two years each, and fields of like names that are not theirs."""
    s = table(spark, sf, "supplier").withColumn("y", F.explode(F.array(*map(F.lit, YEARS_OF_SOURCE))))
    out = []
    for k, (source, (_, _, _, unit)) in enumerate(wages.SOURCES.items()):
        names = wages.FIELD_NAMES.get(source, {})
        columns = [f"{v} AS {names.get(f, f'{f}_{unit}')}" for f, v in published(k).items()]
        rows = s.selectExpr("CAST(s_suppkey AS STRING) AS national_code", "y AS year", "CAST(s_suppkey AS DOUBLE) AS n_employees", f"1.0D AS agreed_mean_{unit}", *columns)
        out.append(wages.extract_source(rows, source))
    all_ = out[0]
    for d in out[1:]:
        all_ = all_.unionByName(d)
    return all_.select("country", "source_id", "national_code", "year", "period", "currency", *[r(f).alias(f) for f in wages.FIELDS], "n_employees", "distribution")


@query(
    "absent_countries",
    """WITH t AS (SELECT DISTINCT n_name AS country FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 0), a AS (SELECT n_name AS country, 'no series since ' || (2000 + n_nationkey) AS reason FROM nation WHERE n_nationkey % 2 = 0)
SELECT country, NULL::VARCHAR AS reason, true AS published FROM t UNION ALL SELECT country, reason, false FROM a WHERE country NOT IN (SELECT country FROM t)""",
)
def absent_countries(spark, sf):
    """A country with figures is not absent, whatever the list says."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    there = n.join(c.filter("c_custkey % 50 = 0"), F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("country")).distinct()
    absent = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("country"), F.concat(F.lit("no series since "), F.col("n_nationkey") + 2000).alias("reason"))
    return wages.with_absent(there, absent)
