"""Readers run on documents and sheets that Spark assembles from the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paylens.queries.common import WITH, table
from paylens.queries.registry import query
from paylens.session import cut_lineage
from paylens.sources import cubes, postings, tables


def order_cubes(spark, sf, nested: bool = False):
    """One cube per customer nation: priority x year, dense for even nations and sparse for odd ones."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    d = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", F.substring("o_orderpriority", 1, 1).alias("p"), F.year("o_orderdate").alias("y"), "o_totalprice")
    cell = d.groupBy("c_nationkey", "p", "y").agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count(F.lit(1)).alias("n"))
    cell = cut_lineage(cell)
    lo, hi = cell.agg(F.min("y"), F.max("y")).first()  # two numbers
    years = list(range(lo, hi + 1)) if lo else []
    cell = cell.withColumn("idx", (F.col("p").cast("int") - 1) * len(years) + F.col("y") - (lo or 0))
    text_of = F.concat(F.lit('"'), F.col("idx").cast("string"), F.lit('":'), F.format_string("%.2f", "v"))
    flag_of = F.when(F.col("n") < 10, F.concat(F.lit('"'), F.col("idx").cast("string"), F.lit('":"u"')))
    per = cell.groupBy("c_nationkey").agg(
        F.array_join(F.collect_list(text_of), ",").alias("sparse"),  # priorities times years
        F.array_join(F.collect_list(flag_of), ",").alias("flags"),
        F.map_from_entries(F.collect_list(F.struct("idx", F.format_string("%.2f", "v").alias("v")))).alias("m"),
    )
    dense = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(max(0, 5 * len(years) - 1))), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit("null"))), ",")
    head = '{"id":["pri","time"],"size":[5,%d],' % len(years) if not nested else "{"
    inner = "" if not nested else '"id":["pri","time"],"size":[5,%d],' % len(years)
    dims = (
        f'{head}"dimension":{{{inner}"pri":{{"category":{{"index":{{"1":0,"2":1,"3":2,"4":3,"5":4}},"label":{{"1":"urgent","2":"high","3":"medium","4":"open","5":"low"}}}}}},'
        '"time":{"category":{"index":%s}}},"value":' % json.dumps([str(y) for y in years])
    )
    value = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("["), dense, F.lit("]"))).otherwise(F.concat(F.lit("{"), "sparse", F.lit("}")))
    doc = F.concat(F.lit(dims), value, F.lit(',"status":{'), "flags", F.lit("}}"))
    return per.select(F.col("c_nationkey").alias("cube"), doc.alias("doc"))


CUBE = """cell AS (SELECT c_nationkey AS cube, left(o_orderpriority, 1) AS pri, year(o_orderdate)::VARCHAR AS time, round(sum(o_totalprice), 2) AS value, CASE WHEN count(*) < 10 THEN 'u' END AS flag
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


@query("cube_flatten", WITH(CUBE) + "SELECT cube, pri, time, value, flag FROM cell")
def cube_flatten(spark, sf):
    return cubes.cube_table(cubes.flatten_cube(order_cubes(spark, sf), ["cube"]), ["cube"], ["pri", "time"])


@query("cube_flatten_nested", WITH(CUBE) + "SELECT cube, pri, time, value, flag FROM cell")
def cube_flatten_nested(spark, sf):
    return cubes.cube_table(cubes.flatten_cube(order_cubes(spark, sf, nested=True), ["cube"]), ["cube"], ["pri", "time"])


@query("cube_labels", "SELECT c_nationkey AS cube, code, label FROM (SELECT DISTINCT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey), (VALUES ('1', 'urgent'), ('2', 'high'), ('3', 'medium'), ('4', 'open'), ('5', 'low')) t(code, label)")
def cube_labels(spark, sf):
    return cubes.cube_labels(order_cubes(spark, sf), ["cube"], "pri")


@query("cube_pivot", WITH(CUBE) + "SELECT cube::VARCHAR AS national_code, time::INTEGER AS year, max(value) FILTER (pri = '1') AS urgent, max(value) FILTER (pri = '5') AS low FROM cell WHERE pri IN ('1', '5') GROUP BY ALL")
def cube_pivot(spark, sf):
    cells = cubes.flatten_cube(order_cubes(spark, sf), ["cube"])
    cells = cells.withColumn("coords", F.map_concat("coords", F.create_map(F.lit("code"), F.col("cube").cast("string"))))
    return cubes.wage_cube(cells, "code", "time", "pri", {"1": "urgent", "5": "low"})


@query(
    "unpivot_years",
    """SELECT iso AS entity, 'total' AS metric, y AS year, v AS value, y > 1998 AS is_projection FROM (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'SE' WHEN 1 THEN 'NO' ELSE 'DE' END AS iso, year(o_orderdate)::INTEGER AS y, c_custkey, round(sum(o_totalprice), 2) AS v
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) WHERE c_custkey % 5 <> 0""",
)
def unpivot_years(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    iso = F.when(F.col("c_nationkey") % 3 == 0, "SWE").when(F.col("c_nationkey") % 3 == 1, "NOR").otherwise("DEU")
    d = o.join(c, o.o_custkey == c.c_custkey).select("c_custkey", iso.alias("ISO"), F.year("o_orderdate").cast("string").alias("y"), "o_totalprice")
    wide = d.groupBy("c_custkey", "ISO").pivot("y").agg(F.format_number(F.round(F.sum("o_totalprice"), 2), 2))
    wide = wide.withColumns({"subject": F.when(F.col("c_custkey") % 5 == 0, "OTHER").otherwise(" NGDP "), "Estimates Start After": F.lit("1998")})
    return tables.read_wide_years(wide.na.fill("--"), "ISO", "subject", {"NGDP": "total"}, "Estimates Start After")


@query(
    "header_scan",
    """SELECT CASE c_nationkey % 2 WHEN 0 THEN 'SE' ELSE 'NO' END AS entity, y AS year, c_acctbal + (y - 2020) + 0.125::DOUBLE AS value FROM customer, (VALUES (2024), (2025), (2026)) t(y)""",
)
def header_scan(spark, sf):
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_nationkey") % 2 == 0, " Sweden ").otherwise("Norway")
    sheet = F.col("c_custkey").alias("sheet")
    bal = lambda y: (F.col("c_acctbal") + (y - 2020) + 0.125).cast("string")
    rows = F.array(
        F.struct(F.lit(1).alias("n"), F.array(F.lit("Table"), F.lit("notes"), F.lit(""), F.lit(None).cast("string")).alias("cells")),
        F.struct(F.lit(2).alias("n"), F.array(F.lit(""), F.lit("2024"), F.lit("2025e"), F.lit("2026f")).alias("cells")),
        F.struct(F.lit(3).alias("n"), F.array(name, bal(2024), bal(2025), bal(2026)).alias("cells")),
        F.struct(F.lit(4).alias("n"), F.array(F.lit("World"), F.lit("1"), F.lit("2"), F.lit("3")).alias("cells")),
    )
    d = c.select(sheet, F.explode(rows).alias("r")).select("sheet", "r.n", "r.cells")
    return tables.read_header_scan(d, "sheet", "n", "cells")


@query(
    "section_scan",
    """SELECT s_suppkey AS sheet, 'overall' AS section, NULL::VARCHAR AS strand, 2020 AS year, round(s_acctbal, 2) AS score FROM supplier
UNION ALL SELECT s_suppkey, 'strand', 'Labour', 2020, round(s_acctbal + 1, 2) FROM supplier UNION ALL SELECT s_suppkey, 'strand', 'Health', 2020, round(s_acctbal + 2, 2) FROM supplier""",
)
def section_scan(spark, sf):
    a = lambda k: (F.col("s_acctbal") + k).cast("string")
    none = F.lit(None).cast("string")
    rows = F.array(
        F.struct(F.lit(1).alias("n"), F.array(F.lit("Overall scores (with)"), none, none).alias("cells")),
        F.struct(F.lit(2).alias("n"), F.array(F.lit("Year"), F.lit("Score"), none).alias("cells")),
        F.struct(F.lit(3).alias("n"), F.array(F.lit("2020"), a(0), F.lit("9")).alias("cells")),
        F.struct(F.lit(4).alias("n"), F.array(F.lit("Policy strand"), F.lit("Labour"), F.lit(" Health")).alias("cells")),
        F.struct(F.lit(5).alias("n"), F.array(F.lit("2020"), a(1), a(2)).alias("cells")),
    )
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sheet"), F.explode(rows).alias("r")).select("sheet", "r.n", "r.cells")
    return tables.read_sections(d, "sheet", "n", "cells")


def survey_waves(spark, sf):
    """Survey rows: a wave per order year, bands by customer."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    k = F.col("c_custkey") % 4
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.year("o_orderdate").cast("string").alias("wave"), F.when(F.col("c_nationkey") % 2 == 0, "Sweden").otherwise("DEU").alias("Country"), F.col("o_totalprice").cast("string").alias("ConvertedCompYearly"),
        F.when(k == 0, "Less than 1 year").when(k == 1, "4").when(k == 2, "12").otherwise("NA").alias("YearsCodePro"), F.lit("dev;").alias("DevType"),
    )


SURVEY = (["CompTotal", "ConvertedCompYearly"], ["Country"], ["YearsCodePro"], ["DevType"], "wave")


SURVEY_SQL = """s AS (SELECT year(o_orderdate)::VARCHAR AS wave, CASE c_nationkey % 2 WHEN 0 THEN 'SE' ELSE 'DE' END AS country, o_totalprice AS pay, CASE c_custkey % 4 WHEN 0 THEN 'new_grad' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' END AS band, 'dev' AS role
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice BETWEEN 5000 AND 1000000), b AS (SELECT wave, country, pay, unnest(['all', band]) AS band FROM s)"""


def survey_sql(rows: str, key: str, least: int) -> str:
    """Median half to even, quartiles at p(n + 1) from four rows on, thin below five."""
    at = lambda p: f"greatest(1, least(floor({p}::DOUBLE * (n + 1)), n - 1))::BIGINT"
    quartile = lambda p: f"CASE WHEN n >= 4 THEN round_even(v[{at(p)}] + (v[{at(p)} + 1] - v[{at(p)}]) * ({p}::DOUBLE * (n + 1) - {at(p)}), 0) END"
    mid = "v[floor(0.5::DOUBLE * (n - 1))::BIGINT + 1] + (v[least(floor(0.5::DOUBLE * (n - 1)) + 1, n - 1)::BIGINT + 1] - v[floor(0.5::DOUBLE * (n - 1))::BIGINT + 1]) * (0.5::DOUBLE * (n - 1) - floor(0.5::DOUBLE * (n - 1)))"
    return f"""SELECT country, wave, {key}, n, round_even({mid}, 0) AS median, {quartile(0.25)} AS p25, {quartile(0.75)} AS p75, n < 5 AS thin
FROM (SELECT country, wave, {key}, count(*) AS n, list(pay ORDER BY pay) AS v FROM {rows} WHERE {key} IS NOT NULL GROUP BY ALL) WHERE n >= {least}"""


@query("survey_pay", WITH(SURVEY_SQL) + f"SELECT country, wave, band, n, median FROM ({survey_sql('b', 'band', 1)})")
def survey_pay(spark, sf):
    return survey_pay_bands(spark, sf).select("country", "wave", "band", "n", "median")


@query("survey_pay_bands", WITH(SURVEY_SQL) + survey_sql("b", "band", 1))
def survey_pay_bands(spark, sf):
    """The reader's own medians, quartiles and thin flag, by band."""
    return tables.survey_pay(survey_waves(spark, sf), *SURVEY)[0]


@query("survey_pay_roles", WITH(SURVEY_SQL) + survey_sql("s", "role", 3))
def survey_pay_roles(spark, sf):
    """The same, by role."""
    return tables.survey_pay(survey_waves(spark, sf), *SURVEY)[1]


def forum_rows(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit(False).alias("deleted"), F.lit(None).cast("boolean").alias("dead"))
    return postings.postings_forum(c)


@query(
    "forum_postings",
    """SELECT 'hn:' || conv_id || '-' || turn AS id, trim(string_split(trim(text, chr(10) || ' '), chr(10))[1]) AS title FROM conversations WHERE trim(text, chr(10) || ' ') <> ''""",
)
def forum_postings(spark, sf):
    return forum_rows(spark, sf).select("id", "title")


@query("forum_postings_fields")
def forum_postings_fields(spark, sf):
    """All fields of the reader's postings."""
    return forum_rows(spark, sf)
