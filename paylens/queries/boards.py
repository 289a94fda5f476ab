"""Readers of indicator pages, national wage tables, price series and job boards, on rows of their shapes made of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.queries.common import r, table
from paylens.queries.registry import query
from paylens.sources import postings as boards
from paylens.sources import tables

ISO3 = "CASE c_nationkey % 3 WHEN 0 THEN 'SWE' WHEN 1 THEN 'NOR' ELSE 'DEU' END"
ISO2 = "CASE c_nationkey % 3 WHEN 0 THEN 'SE' WHEN 1 THEN 'NO' ELSE 'DE' END"
#: A cell as text: a mark for every seventh customer, else the balance.
CELL = "CASE WHEN c_custkey % 7 = 0 THEN '{mark}' ELSE format_string('%.2f', c_acctbal + {plus}) END"
CELL_SQL = "CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal + {plus}, 2) END"


def cell(plus: float = 0, mark: str = "x") -> str:
    return CELL.format(mark=mark, plus=f"{plus}D")


def customers(spark, sf):
    return table(spark, sf, "customer")


def yearly(spark, sf):
    o, c = table(spark, sf, "orders"), customers(spark, sf)
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count(F.lit(1)).alias("n"))


YEARLY = "y AS (SELECT c_nationkey, year(o_orderdate)::INTEGER AS y, round(sum(o_totalprice), 2) AS v, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


@query("indicator_pages", f"WITH {YEARLY} SELECT {ISO2} AS entity, 'PAY.TOTL' AS metric, y AS year, v AS value FROM y WHERE n % 5 <> 0")
def indicator_pages(spark, sf):
    row = F.struct(F.expr(ISO3).alias("countryiso3code"), F.struct(F.lit("PAY.TOTL").alias("id")).alias("indicator"), F.col("y").cast("string").alias("date"), F.when(F.col("n") % 5 != 0, F.col("v")).alias("value"))
    pages = yearly(spark, sf).groupBy("c_nationkey").agg(F.to_json(F.collect_list(row)).alias("rows"))
    return tables.read_indicator(pages.select(F.concat(F.lit('[{"page":1},'), "rows", F.lit("]")).alias("page")), "page")


@query(
    "sdmx_rows",
    f"WITH {YEARLY} SELECT {ISO2} AS entity, CASE WHEN n % 2 = 0 THEN CASE WHEN n % 3 = 0 THEN 'value' ELSE 'ADJ' END WHEN n % 3 = 0 THEN 'A' ELSE 'A_ADJ' END AS series, y::VARCHAR AS period, v AS value FROM y WHERE n % 7 <> 0",
)
def sdmx_rows(spark, sf):
    n = F.col("n")
    d = yearly(spark, sf).select(
        F.expr(ISO3).alias("REF_AREA"), F.when(n % 2 == 0, " ").otherwise("A").alias("FREQ"), F.when(n % 3 == 0, "").otherwise("ADJ").alias("ADJUST"),
        F.concat(F.lit(" "), F.col("y").cast("string")).alias("TIME_PERIOD"), F.when(n % 7 == 0, "NaN?").otherwise(F.format_string("%.2f", "v")).alias("OBS_VALUE"),
    )
    return tables.read_sdmx(d, "REF_AREA", ["FREQ", "ADJUST"], "TIME_PERIOD", "OBS_VALUE")


@query(
    "population_export",
    f"WITH {YEARLY}, e AS (SELECT {ISO2} AS entity, y, min(c_nationkey) AS k FROM y GROUP BY ALL), f AS (SELECT e.entity, e.y AS year, v, n FROM e JOIN y ON y.c_nationkey = e.k AND y.y = e.y) "
    "SELECT entity, 'total_population' AS metric, year, round(v * 1000, 2) AS value, year > 1998 AS is_projection FROM f UNION ALL SELECT entity, 'population_density', year, n::DOUBLE, year > 1998 FROM f",
)
def population_export(spark, sf):
    d = yearly(spark, sf).select(
        F.when(F.col("c_nationkey") % 2 == 0, F.substring(F.expr(ISO2), 1, 2)).otherwise("").alias("ISO2_code"), F.expr(ISO3).alias("ISO3_code"), F.lit("Medium").alias("Variant"),
        F.col("y").cast("string").alias("Time"), F.format_string("%.2f", "v").alias("PopTotal"), F.col("n").cast("string").alias("PopDensity"), F.col("c_nationkey").alias("row_no"),
    )
    d = d.unionByName(d.withColumns({"Variant": F.lit("High"), "PopTotal": F.lit("1")}))
    out = tables.read_population(d, ["Medium"], 1900, 2100, 1998)
    return out.withColumn("value", r("value", 2))


@query("outlook_projections", f"WITH {YEARLY}, a AS (SELECT {ISO2} AS entity, y, v FROM y WHERE n % 2 = 0), own AS (SELECT entity, max(y) AS own FROM a GROUP BY 1) SELECT {ISO2} AS entity, y AS year, v AS value, y > coalesce(own, (SELECT max(y) FROM a)) AS is_projection FROM y LEFT JOIN own ON own.entity = {ISO2}")
def outlook_projections(spark, sf):
    d = yearly(spark, sf).select(F.expr(ISO2).alias("entity"), F.col("y").alias("year"), F.col("v").alias("value"), "n")
    return tables.mark_projection(d.drop("n"), d.filter("n % 2 = 0")).select("entity", "year", "value", "is_projection")


@query("wage_table_de", f"SELECT 'BUILDING' AS national_code, {CELL_SQL.format(plus=0)} AS mean, {CELL_SQL.format(plus=10)} AS p90 FROM customer WHERE c_mktsegment = 'BUILDING'")
def wage_table_de(spark, sf):
    comma = lambda plus: F.replace(F.expr(cell(plus, "/")), F.lit("."), F.lit(","))
    d = customers(spark, sf).select(F.concat(F.lit(" "), "c_mktsegment").alias("code"), comma(0).alias("a"), comma(10).alias("b"))
    return tables.wages_de(d, "code", "BUILDING", {"a": "mean", "b": "p90"})


@query("wage_table_nl", "SELECT c_custkey::VARCHAR AS national_code, 2000 + c_custkey::INTEGER % 20 AS year, c_acctbal AS wage FROM customer WHERE c_custkey % 2 = 0")
def wage_table_nl(spark, sf):
    period = F.concat((F.lit(2000) + F.col("c_custkey") % 20).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "JJ00").otherwise("KW01"))
    d = customers(spark, sf).select(F.concat(F.col("c_custkey").cast("string"), F.lit("  ")).alias("code"), period.alias("period"), F.col("c_acctbal").alias("wage"))
    return tables.wages_nl(d, "code", "period").select("national_code", "year", "wage")


@query("wage_table_uk", f"SELECT c_custkey::VARCHAR AS national_code, {CELL_SQL.format(plus=0)} AS median_gbp_year, {CELL_SQL.format(plus=1)} AS p90_gbp_year, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey::DOUBLE END AS median_cv_pct, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey + 1::DOUBLE END AS p90_cv_pct FROM customer")
def wage_table_uk(spark, sf):
    c = customers(spark, sf)
    values = c.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("code"), F.expr(cell(0)).alias("median"), F.expr(cell(1)).alias("p90"))
    quality = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("code"), F.col("c_nationkey").cast("string").alias("median"), (F.col("c_nationkey") + 1).cast("string").alias("p90"))
    return tables.wages_uk(values, quality, "code", ["median", "p90"])


@query("wage_table_ca", f"SELECT c_custkey::VARCHAR AS national_code, c_mktsegment AS region, {CELL_SQL.format(plus=0)} AS mean, c_mktsegment = 'BUILDING' AS is_national FROM customer")
def wage_table_ca(spark, sf):
    d = customers(spark, sf).select(F.concat(F.lit("NOC_"), F.col("c_custkey").cast("string")).alias("code"), F.concat("c_mktsegment", F.lit(" ")).alias("region"), F.expr(cell(0, "")).alias("w"))
    return tables.wages_ca(d, "code", "region", "BUILDING", {"w": "mean"})


@query(
    "wage_table_au",
    f"""SELECT c_custkey::VARCHAR AS national_code, c_name AS title, concept, CASE concept WHEN 'total' THEN {CELL_SQL.format(plus=0)} ELSE {CELL_SQL.format(plus=2)} END AS mean_aud_year,
  CASE concept WHEN 'total' THEN {CELL_SQL.format(plus=1)} ELSE {CELL_SQL.format(plus=3)} END AS median_aud_year FROM customer, (VALUES ('total'), ('salary')) t(concept) WHERE c_nationkey % 2 = 0""",
)
def wage_table_au(spark, sf):
    label = F.when(F.col("c_custkey") % 1 == 0, F.concat_ws("  ", F.col("c_custkey").cast("string"), "c_name"))
    d = customers(spark, sf).select(label.alias("label"), F.when(F.col("c_nationkey") % 2 == 0, " Persons").otherwise("Males").alias("sex"), *[F.expr(cell(k)).alias(f"v{k}") for k in range(4)])
    return tables.wages_au(d, "label", "sex", "Persons", {"total": ("v0", "v1"), "salary": ("v2", "v3")})


@query(
    "wage_table_qa",
    """WITH g AS (SELECT year(o_orderdate)::INTEGER AS year, o_custkey % 2 AS s, round(avg(o_totalprice), 2) AS w, count(*)::DOUBLE AS n FROM orders WHERE o_custkey % 2 = 0 OR year(o_orderdate) <> 1997 GROUP BY ALL),
p AS (SELECT year, max(w) FILTER (s = 0) AS wa, max(w) FILTER (s = 1) AS wb, coalesce(max(n) FILTER (s = 0), 0) AS na, coalesce(max(n) FILTER (s = 1), 0) AS nb FROM g GROUP BY year)
SELECT *, round((wa * na + wb * nb) / (na + nb), 4) AS weighted_mean_qar_month FROM p""",
)
def wage_table_qa(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).filter("o_custkey % 2 = 0 OR year <> 1997")
    g = o.groupBy("year", F.when(F.col("o_custkey") % 2 == 0, "Male").otherwise("Female").alias("sex")).agg(F.format_string("%.2f", F.round(F.avg("o_totalprice"), 2)).alias("wage"), F.count(F.lit(1)).cast("string").alias("workers"))
    return tables.wages_qa(g, "year", "sex", ["Male", "Female"], "wage", "workers").withColumn("weighted_mean_qar_month", r("weighted_mean_qar_month", 4))


@query("month_arrays", "SELECT s_suppkey AS entity, '2020-11' AS month, s_acctbal AS value FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, '2021-01', s_acctbal + 1 FROM supplier")
def month_arrays(spark, sf):
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.array(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")), F.lit(None).cast("double"), F.col("s_acctbal") + 1).alias("values"), F.lit("2020-11-15").alias("start"))
    return tables.read_month_arrays(d, "entity", "values", "start")


@query("metro_quarters", "SELECT CASE s_nationkey % 3 WHEN 0 THEN 'Oslo' ELSE 'Lyon' END AS city, CASE s_nationkey % 3 WHEN 2 THEN 'secondary' ELSE 'primary' END AS role, 2000 + s_suppkey::INTEGER % 20 AS year, 1 + s_suppkey::INTEGER % 4 AS quarter, s_acctbal AS value, s_suppkey % 2 = 0 AS sub_area FROM supplier WHERE s_suppkey % 5 <> 0")
def metro_quarters(spark, sf):
    s = F.col("s_suppkey")
    d = table(spark, sf, "supplier").select(
        F.when(s % 2 == 0, "Area (MSAD)").otherwise("Area").alias("_c0"), (F.col("s_nationkey") % 3).cast("string").alias("_c1"), (2000 + s % 20).cast("string").alias("_c2"), (1 + s % 4).cast("string").alias("_c3"),
        F.when(s % 10 == 0, "-").when(s % 5 == 0, "(x)").otherwise(F.format_string("%.2f", "s_acctbal")).alias("_c4"),
    )
    codes = spark.createDataFrame([("0", "Oslo", "primary"), ("1", "Lyon", "primary"), ("2", "Lyon", "secondary")], "code string, city string, role string")
    return tables.read_metro_hpi(d, codes)


@query("price_months", "SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'London' ELSE 'Leeds' END AS city, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS avg_price, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::DOUBLE END AS index FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2') AND (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)")
def price_months(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("RegionName"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"),
        F.when(k % 3 != 0, F.format_string("%.2f", "o_totalprice")).alias("AveragePrice"), F.when(k % 2 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("Index"),
    )
    return tables.read_uk_hpi(d, spark.createDataFrame([("1", "London"), ("2", "Leeds")], "region string, city string"))


@query("daily_months", "WITH m AS (SELECT event_type, strftime(ts, '%Y-%m') AS month, round(avg(value), 2) AS value, count(value) AS days FROM events GROUP BY ALL) SELECT event_type || c AS city, month, value, days FROM m, (VALUES ('-a'), ('-b')) t(c)")
def daily_months(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "value")
    cities = e.select("code").distinct().select("code", F.explode(F.array(F.concat("code", F.lit("-a")), F.concat("code", F.lit("-b")))).alias("city"))
    return tables.daily_to_monthly(e, "code", "date", "value", cities)


@query("vintage_edition", f"SELECT {ISO2} AS entity, 2024 AS year, round(c_acctbal, 2) AS score, c_custkey::INTEGER AS rank, (SELECT max(c_custkey)::INTEGER FROM customer) AS ranked_of FROM customer")
def vintage_edition(spark, sf):
    d = customers(spark, sf).select(F.expr(ISO3).alias("ISO"), F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(",")).alias("Score 2024"), F.col("c_custkey").cast("string").alias("Rank"))
    return tables.read_vintage_csv(d, 2024, "ISO", ["Score_{year}", "Score {year}"], ["Rank {year}", "Rank"])


def pay_columns(df):
    p = F.col("compensation")
    return df.select("id", "country", "remote", p["min"].alias("min"), p["max"].alias("max"), p["currency"].alias("currency"), p["period"].alias("period"))


PLACE = "CASE o_custkey % 4 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Paris, France' WHEN 2 THEN 'Austin, TX' ELSE 'nowhere' END"
PLACE_CODE = "CASE o_custkey % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' WHEN 2 THEN 'US' END"


@query(
    "board_lever",
    f"""WITH d AS (SELECT *, o_orderkey % 5 AS k FROM orders)
SELECT 'lever:t:' || o_orderkey AS id, {PLACE_CODE} AS country, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS remote, CASE WHEN k IN (0, 1) THEN o_totalprice END AS min,
  CASE WHEN k IN (0, 1) THEN o_totalprice + 10 END AS max, CASE WHEN k IN (0, 1) THEN 'EUR' END AS currency, CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' END AS period FROM d""",
)
def board_lever(spark, sf):
    """Twice-monthly pay, a zero minimum and a missing salary are no pay."""
    k = F.col("o_orderkey") % 5
    interval = F.when(k == 0, "per-year-salary").when(k == 1, "per-month-salary").when(k == 2, "semi-month-salary").otherwise("per-hour-wage")
    salary = F.struct(F.when(k == 3, 0.0).otherwise(F.col("o_totalprice")).alias("min"), (F.col("o_totalprice") + 10).alias("max"), F.lit("EUR").alias("currency"), interval.alias("interval"))
    d = table(spark, sf, "orders").select(
        F.lit("t").alias("token"), F.col("o_orderkey").cast("string").alias("id"), F.lit("T").alias("title"), F.expr(PLACE).alias("location"),
        F.when(F.col("o_orderkey") % 3 == 0, "remote").when(F.col("o_orderkey") % 3 == 1, "on-site").alias("workplace"), F.lit("u").alias("url"), F.when(k != 4, salary).alias("salary"),
    )
    return pay_columns(boards.postings_lever(d))


@query(
    "board_government",
    f"""SELECT 'usajobs:' || o_orderkey AS id, coalesce({PLACE_CODE}, 'US') AS country, NULL::BOOLEAN AS remote, CASE WHEN o_orderkey % 3 <> 2 THEN o_totalprice END AS min,
  CASE WHEN o_orderkey % 3 <> 2 THEN o_totalprice + 10 END AS max, CASE WHEN o_orderkey % 3 <> 2 THEN 'USD' END AS currency, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_totalprice + 10 < 1000 THEN 'hour' ELSE 'year' END WHEN 1 THEN 'hour' END AS period FROM orders""",
)
def board_government(spark, sf):
    k = F.col("o_orderkey") % 3
    place = F.split(F.expr(PLACE), ", ")
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("A").alias("agency"), F.lit("D").alias("department"), F.lit("d").alias("department_code"), F.lit("T").alias("title"), F.lit("2026-01-01").alias("opened"),
        F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 10).alias("hi"), F.when(k == 0, "Per Year").when(k == 1, "Per Hour").otherwise("Fee Basis").alias("salary_type"),
        F.array(F.struct(F.get(place, F.lit(0)).alias("city"), F.get(place, F.lit(1)).alias("state"))).alias("locations"),
    )
    return pay_columns(boards.postings_gov(d))


@query(
    "board_feed",
    f"""SELECT 'teamtailor:t:' || o_orderkey AS id, {PLACE_CODE} AS country, NULL::BOOLEAN AS remote, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS min, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 10 ELSE o_totalprice END END AS max,
  CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' END AS currency, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'month' ELSE 'year' END END AS period FROM orders""",
)
def board_feed(spark, sf):
    k, place = F.col("o_orderkey"), F.split(F.expr(PLACE), ", ")
    salary = F.struct(F.col("o_totalprice").alias("min"), F.when(k % 4 == 0, F.col("o_totalprice") + 10).alias("max"), F.lit("EUR").alias("currency"), F.when(k % 4 == 0, "MONTH").alias("unit"))
    d = table(spark, sf, "orders").select(
        F.lit("t").alias("token"), F.lit(None).cast("string").alias("feed_title"), k.cast("string").alias("id"), F.lit("T").alias("title"), F.lit("u").alias("url"), F.lit("2026-01-01T00:00").alias("published"),
        F.get(place, F.lit(0)).alias("locality"), F.get(place, F.lit(1)).alias("region"), F.lit("").alias("country_name"), F.when(k % 2 == 0, salary).alias("salary"),
    )
    return pay_columns(boards.postings_feed(d))


@query(
    "board_list_detail",
    f"""SELECT 'greenhouse:' || o_custkey || ':' || o_orderkey AS id, {PLACE_CODE} AS country, NULL::BOOLEAN AS remote, CASE WHEN o_orderkey % 2 = 0 AND o_custkey > 0 THEN o_custkey * 10.0::DOUBLE END AS min, CASE WHEN o_orderkey % 2 = 0 AND o_custkey > 0 THEN o_custkey * 10.0::DOUBLE + 5 END AS max,
  CASE WHEN o_orderkey % 2 = 0 AND o_custkey > 0 THEN 'USD' END AS currency, CASE WHEN o_orderkey % 2 = 0 AND o_custkey > 0 THEN CASE WHEN o_custkey * 10 + 5 < 1000 THEN 'hour' ELSE 'year' END END AS period FROM orders""",
)
def board_list_detail(spark, sf):
    o = table(spark, sf, "orders").withColumns({"token": F.col("o_custkey").cast("string"), "id": F.col("o_orderkey").cast("string")})
    jobs = o.select("token", F.col("o_orderkey").alias("pos"), "id", F.lit("T").alias("title"), F.lit("C").alias("company_name"), F.expr(PLACE).alias("location"), F.lit("u").alias("url"), F.lit("2026-01-01").alias("updated_at"))
    detail = o.filter("o_orderkey % 2 = 0").select("token", "id", (F.col("o_custkey") * 1000).alias("min_cents"), (F.col("o_custkey") * 1000 + 500).alias("max_cents"), F.lit("USD").alias("currency"))
    return pay_columns(boards.postings_greenhouse(jobs, detail))
