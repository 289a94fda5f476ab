"""Stand-ins that give the driver's tables the shapes of the domain, in Spark and in SQL.

posting     one order: country of its customer, posted date, pay range, pay period by priority
rates       one rate per nation and year 1995-2000, so that 2001 is honestly missing
hours       weekly hours of nations for a few years; nations of region 4 have none
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.session import table

__all__ = ["hours", "nation_years", "postings", "rates", "table", "POSTING", "RATES", "HOURS", "WITH", "r", "YEARLY"]


def r(col, digits: int = 4):
    """Rounded double, the form in which results are compared."""
    return F.round(col.cast("double") if hasattr(col, "cast") else F.col(col).cast("double"), digits)


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return df.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("provider"),
        F.col("c_name").alias("company"),
        F.lower(F.concat_ws("-", F.col("c_mktsegment"), F.col("n_name"))).alias("company_slug"),
        F.col("n_name").alias("country"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_at"),
        F.year("o_orderdate").alias("year"),
        (F.lit(0.9) * F.col("o_totalprice")).alias("min"),
        (F.lit(1.1) * F.col("o_totalprice")).alias("max"),
        F.col("o_totalprice").alias("pay"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "month")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "hour")
        .when(F.col("o_orderpriority") == "5-LOW", "week")
        .otherwise("year")
        .alias("period"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_custkey").alias("custkey"),
    )


POSTING = """posting AS (
  SELECT o_orderkey AS id, o_orderpriority AS provider, c_name AS company,
    lower(c_mktsegment || '-' || n_name) AS company_slug, n_name AS country,
    strftime(o_orderdate, '%Y-%m-%d') AS posted_at, CAST(year(o_orderdate) AS INTEGER) AS year,
    0.9::DOUBLE * o_totalprice AS min, 1.1::DOUBLE * o_totalprice AS max, o_totalprice AS pay,
    CASE o_orderpriority WHEN '3-MEDIUM' THEN 'month' WHEN '4-NOT SPECIFIED' THEN 'hour'
      WHEN '5-LOW' THEN 'week' ELSE 'year' END AS period,
    o_orderstatus AS status, c_mktsegment AS segment, o_custkey AS custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def rates(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf).select("n_name", "n_nationkey", F.explode(F.sequence(F.lit(1995), F.lit(2000))).alias("year"))
    return n.select(
        F.col("n_name").alias("country"),
        "year",
        (F.lit(1.0) + F.col("n_nationkey") / F.lit(10.0) + (F.col("year") - 1995) / F.lit(100.0)).alias("rate"),
    )


RATES = """rates AS (
  SELECT n_name AS country, CAST(y AS INTEGER) AS year,
    1.0::DOUBLE + n_nationkey / 10.0::DOUBLE + (y - 1995) / 100.0::DOUBLE AS rate
  FROM nation, range(1995, 2001) t(y))"""


def hours(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf).filter("n_regionkey <> 4")
    n = n.select("n_name", "n_regionkey", F.explode(F.array(*[F.lit(y) for y in (1996, 1998, 2000)])).alias("year"))
    return n.select(
        F.col("n_name").alias("country"),
        "year",
        (F.lit(35.0) + F.col("n_regionkey") + (F.col("year") - 1996) * F.lit(0.25)).alias("hours"),
    )


HOURS = """hours AS (
  SELECT n_name AS country, y AS year, 35.0::DOUBLE + n_regionkey + (y - 1996) * 0.25::DOUBLE AS hours
  FROM nation, (VALUES (1996), (1998), (2000)) t(y) WHERE n_regionkey <> 4)"""


def nation_years(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly order total per nation: the annual series of the series operators."""
    p = postings(spark, sf)
    return p.groupBy(F.col("country").alias("entity"), "year").agg(
        F.round(F.sum("pay"), 2).alias("value"), F.count(F.lit(1)).alias("n")
    )


YEARLY = """yearly AS (
  SELECT country AS entity, year, round(sum(pay), 2) AS value, count(*) AS n FROM posting GROUP BY ALL)"""


def WITH(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
