"""Derived money, composites, ranks, limits and lookups over customers, nations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.operators import ranking
from paylens.plans import core, metrics
from paylens.plans import postings as plans_postings
from paylens.queries.common import POSTING, RATES, WITH, YEARLY, nation_years, postings, r, rates, table
from paylens.queries.registry import query

CITY = """city AS (SELECT c_custkey AS id, c_name AS name, n_name AS country, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal * 10 END AS gross, CASE WHEN c_custkey % 13 <> 0 THEN 70.0::DOUBLE - c_nationkey END AS net_pct,
    CASE WHEN c_custkey % 17 <> 0 THEN 400.0::DOUBLE + c_nationkey * 60 END AS rent, CASE WHEN c_custkey % 19 <> 0 THEN 300.0::DOUBLE + c_custkey % 500 END AS living,
    CASE WHEN c_custkey % 23 <> 0 THEN 1000.0::DOUBLE + c_nationkey * 100 END AS price_m2 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
MONEY = """money AS (SELECT *, net - 12 * (rent + living) AS savings FROM (SELECT *, gross * net_pct / 100 AS net FROM city))"""


def cities(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"),
        F.when(k % 11 != 0, F.col("c_acctbal") * 10).alias("gross"), F.when(k % 13 != 0, F.lit(70.0) - nk).alias("net_pct"),
        F.when(k % 17 != 0, F.lit(400.0) + nk * 60).alias("rent"), F.when(k % 19 != 0, F.lit(300.0) + k % 500).alias("living"),
        F.when(k % 23 != 0, F.lit(1000.0) + nk * 100).alias("price_m2"),
    )


STABLE = """CASE WHEN savings > 0 AND price_m2 IS NOT NULL THEN CASE WHEN savings - 240 <= 0 OR abs(90 * price_m2 / (savings + 240) - 90 * price_m2 / savings) / (90 * price_m2 / savings) > 0.25
  OR abs(90 * price_m2 / (savings - 240) - 90 * price_m2 / savings) / (90 * price_m2 / savings) > 0.25 THEN 'unstable' ELSE 'stable' END END"""
DERIVED = f"""id, round(net, 4) AS net, round(savings, 4) AS savings, round(CASE WHEN savings > 0 THEN 90 * price_m2 / savings END, 4) AS years_to_home, round(CASE WHEN savings IS NOT NULL THEN greatest(savings, 0) / price_m2 END, 9) AS m2_per_year,
  {STABLE} AS stability, savings <= 0 AND price_m2 IS NOT NULL AS never,
  concat_ws(',', CASE WHEN gross IS NULL THEN 'salary' END, CASE WHEN net_pct IS NULL THEN 'tax rate' END, CASE WHEN rent IS NULL THEN 'rent' END, CASE WHEN living IS NULL THEN 'living costs' END,
  CASE WHEN price_m2 IS NULL THEN 'apartment price' END) AS missing"""


def derived(df):
    return df.select(
        "id", r("net").alias("net"), r("savings").alias("savings"), r("years_to_home").alias("years_to_home"), r("m2_per_year", 9).alias("m2_per_year"),
        "stability", "never", F.array_join("missing_inputs", ",").alias("missing"),
    )


@query("derive_money", WITH(CITY, MONEY) + f", d AS (SELECT {DERIVED} FROM money) SELECT * FROM d")
def derive_money(spark, sf):
    out = ranking.derive_money(cities(spark, sf))
    return derived(out)


@query(
    "derive_money_with_budget",
    WITH(CITY)
    + f""", b AS (SELECT id, name, country, gross, net_pct, rent * 1.25::DOUBLE AS rent, 900.0::DOUBLE AS living, price_m2 FROM city), money AS (SELECT *, net - 12 * (rent + living) AS savings FROM (SELECT *, gross * net_pct / 100 AS net FROM b)),
d AS (SELECT {DERIVED} FROM money) SELECT * FROM d""",
)
def derive_money_with_budget(spark, sf):
    return derived(ranking.derive_money(cities(spark, sf), {"rent_factor": 1.25, "living": 900.0}))


@query(
    "pay_vs_cost",
    WITH(POSTING, CITY)
    + f""", e AS (SELECT country, median(pay) AS estimate FROM posting WHERE country <> 'NATION_7' GROUP BY country),
b AS (SELECT id, name, coalesce(estimate, gross) AS gross, net_pct, rent, living, price_m2 FROM city LEFT JOIN e USING (country)), money AS (SELECT *, net - 12 * (rent + living) AS savings FROM (SELECT *, gross * net_pct / 100 AS net FROM b)),
d AS (SELECT {DERIVED} FROM money) SELECT * FROM d""",
)
def pay_vs_cost(spark, sf):
    from paylens.operators.quantiles import group_median

    e = group_median(postings(spark, sf).filter("country <> 'NATION_7'"), ["country"], "pay", "estimate")
    return derived(core.pay_vs_cost(e, cities(spark, sf), "country"))


@query(
    "by_lens",
    WITH(CITY, MONEY) + "SELECT country, lens, count(v) AS n, round(avg(v), 4) AS mean FROM (SELECT country, lens, CASE lens WHEN 'gross' THEN gross WHEN 'net' THEN net ELSE savings END AS v FROM money, (VALUES ('gross'), ('net'), ('after')) t(lens)) GROUP BY ALL",
)
def by_lens(spark, sf):
    d = ranking.derive_money(cities(spark, sf)).withColumn("lens", F.explode(F.array(F.lit("gross"), F.lit("net"), F.lit("after"))))
    d = d.select("country", "lens", ranking.by_lens(F.col("lens")).alias("v"))
    return d.groupBy("country", "lens").agg(F.count("v").alias("n"), r(F.avg("v")).alias("mean"))


@query(
    "vs_average",
    WITH(CITY) + "SELECT id, round(CASE WHEN a > 0 THEN gross / a END, 6) AS ratio FROM city JOIN (SELECT country, avg(gross) AS a FROM city GROUP BY country) USING (country)",
)
def vs_average(spark, sf):
    c = cities(spark, sf)
    a = c.groupBy("country").agg(F.avg("gross").alias("a"))
    return c.join(a, "country").select("id", r(ranking.vs_average(F.col("gross"), F.col("a")), 6).alias("ratio"))


@query(
    "budget_split",
    WITH(CITY, MONEY)
    + """SELECT id, round(greatest(0, m - rent - living), 7) AS left_over, round(rent / greatest(m, rent + living), 6) AS rent_share, round(living / greatest(m, rent + living), 6) AS living_share
FROM (SELECT *, net / 12 AS m FROM money WHERE net IS NOT NULL AND rent IS NOT NULL AND living IS NOT NULL)""",
)
def budget_split(spark, sf):
    d = ranking.derive_money(cities(spark, sf)).filter("net IS NOT NULL AND rent IS NOT NULL AND living IS NOT NULL")
    s = ranking.budget_split(F.col("net") / 12, F.col("rent"), F.col("living"))
    return d.select("id", r(s["left_over"], 7).alias("left_over"), r(s["rent_share"], 6).alias("rent_share"), r(s["living_share"], 6).alias("living_share"))


@query(
    "staleness",
    """SELECT m AS as_of, months, months > lim AS stale, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, (2001 - year(o_orderdate)) * 12 + (8 - month(o_orderdate)) AS months,
  CASE WHEN o_orderpriority < '3' THEN 12 ELSE 36 END AS lim FROM orders) GROUP BY ALL""",
)
def staleness(spark, sf):
    m = F.date_format("o_orderdate", "yyyy-MM")
    lim = F.when(F.col("o_orderpriority") < "3", 12).otherwise(36)
    d = table(spark, sf, "orders").select(m.alias("as_of"), lim.alias("lim"))
    d = d.select("as_of", ranking.months_old(F.col("as_of"), "2001-08-15").cast("long").alias("months"), ranking.is_stale(F.col("as_of"), "2001-08-15", F.col("lim")).alias("stale"))
    return d.groupBy("as_of", "months", "stale").agg(F.count(F.lit(1)).alias("n"))


METRICS_SQL = """long AS (SELECT id, country, unnest(['savings', 'rent', 'living', 'gross']) AS metric, unnest([savings, rent, living, gross]) AS value, unnest(['higher', 'lower', 'lower', 'higher']) AS direction,
  STABILITY = 'unstable' AS shaky FROM money)""".replace("STABILITY", STABLE)


def metric_registry():
    spec = lambda c, d, t, q: {"value": F.col(c), "direction": d, "theme": t, "confidence": q}
    return {
        "savings": spec("savings", "higher", "money", "official"),
        "rent": spec("rent", "lower", "housing", "crowd"),
        "living": spec("living", "lower", "life", "crowd"),
        "gross": spec("gross", "higher", "money", "crowd"),
    }


#: Columns of a place that the registry reads besides those of ``city``: SQL that both engines read.
PLACE_COLUMNS = {
    "employer_pay": "CASE WHEN id % 5 = 0 THEN gross * 1.5 END", "rent_centre": "rent * 1.3", "pr_years": "CASE WHEN id % 7 <> 0 THEN 2.0 + id % 9 END", "citizenship_years": "CASE WHEN id % 6 <> 0 THEN 4.0 + id % 8 END",
    "tuition": "CASE WHEN id % 3 <> 0 THEN 1000.0 + id % 40000 END", "post_study_months": "CASE WHEN id % 4 <> 0 THEN 6.0 + id % 30 END", "ict_thousands": "CASE WHEN id % 8 <> 0 THEN (id % 2000) / 2.0 END",
    "ict_share": "(id % 100) / 10.0", "foreign_born_share": "CASE WHEN id % 9 <> 0 THEN (id % 450) / 10.0 END", "diaspora": "CASE WHEN id % 10 <> 0 THEN id % 90000 END",
    "happiness_rank": "CASE WHEN id % 3 = 0 THEN 1 + id % 147 END", "happiness_rank_old": "CASE WHEN id % 2 = 0 THEN 1 + id % 143 END", "peace_rank": "1 + id % 163", "healthcare": "40.0 + id % 50", "hdi": "0.5 + (id % 480) / 1000.0",
    "sunshine": "CASE WHEN id % 4 <> 0 THEN 1200.0 + id % 2000 END", "summer_high": "15.0 + id % 25", "winter_low": "-15.0 + id % 30", "rainy_days": "20.0 + id % 180", "travel_hours": "CASE WHEN id % 12 <> 0 THEN 2.0 + (id % 200) / 10.0 END",
}
ENGLISH = "CASE id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'unknown' END"
PLACE = f"place AS (SELECT *, {ENGLISH} AS english_work, " + ", ".join(f"({e.replace('.0', '.0::DOUBLE').replace('1.5', '1.5::DOUBLE').replace('1.3', '1.3::DOUBLE').replace('0.5 ', '0.5::DOUBLE ')})::DOUBLE AS {n}" for n, e in PLACE_COLUMNS.items()) + " FROM city)"
REGISTRY_SQL = f"""registry AS (SELECT * FROM (VALUES {", ".join(f"('{m.key}', '{m.direction}', '{m.theme}', '{m.confidence}', '{m.unit}')" for m in metrics.METRICS)}) t(metric, direction, theme, confidence, unit)),
money AS (SELECT *, CASE WHEN savings > 0 THEN 90 * price_m2 / savings END AS years_to_home, CASE WHEN savings IS NOT NULL AND price_m2 > 0 THEN greatest(savings, 0) / price_m2 END AS m2_per_year
  FROM (SELECT *, gross * net_pct / 100 AS salary_net, gross * net_pct / 100 - 12 * (rent + living) AS savings FROM place)),
m AS (SELECT country, unnest(['salary_gross', 'salary_top_employers', 'salary_net', 'savings', 'net_pct', 'pr_years', 'citizenship_years', 'tuition', 'post_study_months', 'ict_specialists', 'ict_share', 'rent_outside', 'rent_centre', 'living_costs', 'total_monthly', 'apt_m2', 'years_to_home',
    'm2_per_year', 'foreign_born', 'own_diaspora', 'english_work', 'happiness_rank', 'peace_rank', 'healthcare', 'hdi', 'sunshine', 'summer_high', 'winter_low', 'rainy_days', 'travel_hours']) AS metric,
  unnest([gross, employer_pay, salary_net, savings, net_pct, pr_years, citizenship_years, tuition, post_study_months, ict_thousands, ict_share, rent, rent_centre, living, rent + living, price_m2, years_to_home,
    m2_per_year, foreign_born_share, diaspora, CASE english_work WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END, coalesce(happiness_rank, happiness_rank_old), peace_rank, healthcare, hdi, sunshine, summer_high, winter_low, rainy_days, travel_hours]) AS value FROM money)"""


def places(spark, sf):
    return cities(spark, sf).selectExpr("*", f"{ENGLISH} AS english_work", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in PLACE_COLUMNS.items()])


@query(
    "metric_long",
    WITH(CITY, PLACE, REGISTRY_SQL)
    + """SELECT country, metric, direction, theme, confidence, unit, count(value) AS n, round(sum(value), 4) AS total FROM m JOIN registry USING (metric) GROUP BY ALL""",
)
def metric_long(spark, sf):
    d = metrics.metric_rows(places(spark, sf), ["id", "country"])
    return d.groupBy("country", "metric", "direction", "theme", "confidence", "unit").agg(F.count("value").alias("n"), r(F.sum("value")).alias("total"))


@query(
    "metric_census",
    WITH(CITY, PLACE, REGISTRY_SQL) + "SELECT theme, count(DISTINCT metric) AS metrics, count(value) AS present, count(*) - count(value) AS missing FROM m JOIN registry USING (metric) GROUP BY theme",
)
def metric_census(spark, sf):
    d = metrics.metric_rows(places(spark, sf), ["id"])
    return d.groupBy("theme").agg(F.countDistinct("metric").alias("metrics"), F.count("value").alias("present"), F.count_if(F.col("value").isNull()).alias("missing"))


@query(
    "composite",
    WITH(CITY, MONEY, METRICS_SQL)
    + """, w AS (SELECT *, CASE metric WHEN 'savings' THEN 3 WHEN 'rent' THEN 2 WHEN 'living' THEN 1 END::DOUBLE AS weight FROM long WHERE metric <> 'gross'),
b AS (SELECT metric, min(value) FILTER (NOT coalesce(shaky, false)) AS lo, max(value) FILTER (NOT coalesce(shaky, false)) AS hi FROM w GROUP BY metric),
s AS (SELECT w.*, CASE WHEN hi <> lo THEN CASE direction WHEN 'higher' THEN (value - lo) / (hi - lo) ELSE 1 - (value - lo) / (hi - lo) END END AS score FROM w JOIN b USING (metric))
SELECT id, round(sum(score * weight) / sum(weight) FILTER (score IS NOT NULL), 6) AS score, coalesce(sum(weight) FILTER (score IS NOT NULL), 0)::DOUBLE AS used_weight,
  coalesce(sum(weight) FILTER (score IS NULL), 0)::DOUBLE AS missing_weight, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (score IS NULL), '') AS missing FROM s GROUP BY id""",
)
def composite(spark, sf):
    d = ranking.derive_money(cities(spark, sf)).withColumn("shaky", F.col("stability") == "unstable")
    long = ranking.metric_long(d, ["id", "shaky"], metric_registry())
    out = ranking.composite(long, ["id"], {"savings": 3, "rent": 2, "living": 1, "gross": 0}, "shaky")
    return out.select("id", r("score", 6).alias("score"), "used_weight", "missing_weight", F.array_join("missing", ",").alias("missing"))


@query(
    "climate_match",
    """WITH m AS (SELECT o_custkey AS city, month(o_orderdate) AS m, avg(o_totalprice) / 20000 - 15 AS low, avg(o_totalprice) / 10000 + 5 AS high FROM orders GROUP BY ALL),
c AS (SELECT city, count(*) AS k, min(low) AS lo12, max(high) AS hi12, arg_min(low, m) AS lo1, arg_max(high, m) AS hi1, CASE WHEN city % 4 <> 0 THEN sum(high) * 10 END AS sunshine FROM m GROUP BY city),
d AS (SELECT *, CASE WHEN k = 12 THEN lo12 ELSE lo1 END AS low, CASE WHEN k = 12 THEN hi12 ELSE hi1 END AS high, max(sunshine) OVER () AS sunmax FROM c)
SELECT city, round(greatest(0, 1 - (greatest(0, -5 - low) / 25 + greatest(0, high - 30) / 25 + coalesce(1 - sunshine / sunmax, 0)) / (2 + CASE WHEN sunshine IS NULL THEN 0 ELSE 1 END)), 6) AS match,
  CASE WHEN sunshine IS NULL THEN 'sunshine' ELSE '' END AS missing FROM d""",
)
def climate_match(spark, sf):
    o = table(spark, sf, "orders")
    m = o.groupBy(F.col("o_custkey").alias("city"), F.month("o_orderdate").alias("m")).agg(
        (F.avg("o_totalprice") / 20000 - 15).alias("low"), (F.avg("o_totalprice") / 10000 + 5).alias("high")
    )
    c = m.groupBy("city").agg(
        F.collect_list(F.struct("low", "high")).alias("monthly"),  # at most 12 months
        F.min_by("low", "m").alias("winter_low"), F.max_by("high", "m").alias("summer_high"),
        F.when(F.col("city") % 4 != 0, F.sum("high") * 10).alias("sunshine"),
    )
    out = ranking.climate_match(c, -5.0, 30.0, True)
    return out.select("city", r("match", 6).alias("match"), F.array_join("missing", ",").alias("missing"))


@query(
    "rank_of",
    WITH(POSTING, YEARLY)
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY value DESC, entity) AS rank FROM yearly)
SELECT year, entity, rank::INTEGER AS rank, (max(rank) OVER (PARTITION BY year))::INTEGER AS ranked_of FROM k QUALIFY entity IN ('NATION_1', 'NATION_2', 'NATION_3')""",
)
def rank_of(spark, sf):
    from pyspark.sql import Window

    y = nation_years(spark, sf)
    k = y.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("value"), "entity")))  # nations of one year
    members = y.select("entity").distinct().filter(F.col("entity").isin("NATION_1", "NATION_2", "NATION_3"))
    return ranking.rank_of(k, "year", "rank", "entity", members).select("year", "entity", "rank", "ranked_of")


@query(
    "top_k_per_group",
    WITH(POSTING) + "SELECT country, id, pay, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY pay DESC, id) AS rank FROM posting) WHERE rank <= 12",
)
def top_k_per_group(spark, sf):
    return ranking.top_k(postings(spark, sf), ["country"], [F.desc("pay"), F.col("id")], 12).select("country", "id", "pay", "rank")


@query(
    "capped_per_company",
    WITH(POSTING)
    + "SELECT segment, count(*) AS n, count(*) FILTER (rn <= 40) AS with_pay, round(sum(pay) FILTER (rn <= 40), 2) AS paid FROM (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY id) AS rn FROM posting) GROUP BY segment",
)
def capped_per_company(spark, sf):
    """Only the first 40 postings of a company carry pay; all postings stay."""
    p = postings(spark, sf)
    carry = ranking.top_k(p.select("company_slug", "id"), ["company_slug"], [F.col("id")], 40).select("id", F.lit(True).alias("carries"))
    d = p.join(carry, "id", "left")
    paid = F.when(F.col("carries"), F.col("pay"))
    return d.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count(paid).alias("with_pay"), r(F.sum(paid), 2).alias("paid"))


@query(
    "nulls_last",
    WITH(CITY) + "SELECT id, name, gross FROM city ORDER BY gross ASC NULLS LAST, id",
)
def nulls_last(spark, sf):
    return ranking.order_nulls_last(cities(spark, sf), "gross", "id").select("id", "name", "gross")


@query(
    "order_comparable",
    WITH(POSTING) + "SELECT country, round(median(pay), 4) AS median, round(avg(pay), 4) AS mean FROM posting GROUP BY country ORDER BY median DESC, country",
)
def order_comparable(spark, sf):
    from paylens.operators.quantiles import group_median

    p = postings(spark, sf)
    d = group_median(p, ["country"], "pay").join(p.groupBy("country").agg(F.avg("pay").alias("mean")), "country")
    return ranking.order_comparable(d, "median", "mean", "country", True).select("country", r("median").alias("median"), r("mean").alias("mean"))


@query(
    "stratified_sample",
    "SELECT p_type, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('15|' || p_name), p_name) AS rn FROM (SELECT DISTINCT p_type, p_name FROM part)) WHERE rn <= 10",
)
def stratified_sample(spark, sf):
    return ranking.stratified_sample(table(spark, sf, "part"), "p_type", "p_name", 10, 15)


@query(
    "probe_order",
    """WITH c AS (SELECT c_custkey AS pos, c_name AS token, c_custkey % 5 = 0 AS cached, c_custkey % 3 = 0 AS verified FROM customer), b AS (SELECT *, CASE WHEN cached THEN 1 WHEN verified THEN 2 ELSE 3 END AS bucket FROM c)
SELECT token, bucket FROM b WHERE bucket < 3 UNION ALL (SELECT token, bucket FROM b WHERE bucket = 3 ORDER BY pos LIMIT 250)""",
)
def probe_order(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pos"), F.col("c_name").alias("token"), (F.col("c_custkey") % 5 == 0).alias("cached"), (F.col("c_custkey") % 3 == 0).alias("verified")
    )
    return ranking.probe_order(c, "token", "pos", "cached", "verified", 250).select("token", "bucket")


@query("result_cap", WITH(POSTING) + "SELECT id, country, pay FROM posting WHERE pay IS NOT NULL ORDER BY pay DESC, id LIMIT 500")
def result_cap(spark, sf):
    """The list view shows its first 500 rows."""
    return ranking.shown(postings(spark, sf).select("id", "country", "pay"), "list", F.desc("pay"), "id")


@query("name_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001') ORDER BY c_name LIMIT 6")
def name_search(spark, sf):
    return ranking.search_names(table(spark, sf, "customer"), "c_name", " #00000001 ", 6).select("c_custkey", "c_name")


@query(
    "place_search",
    WITH(CITY)
    + "SELECT country, count(*) AS places, min(name) AS first_place FROM city WHERE contains(lower(name), '00012') OR contains(lower(country), '00012') GROUP BY country",
)
def place_search(spark, sf):
    hits = ranking.search_places(cities(spark, sf), "name", "country", "00012")
    return hits.groupBy("country").agg(F.count(F.lit(1)).alias("places"), F.min("name").alias("first_place"))


@query(
    "origins",
    WITH(POSTING, YEARLY)
    + """, o AS (SELECT entity AS origin, sum(n)::DOUBLE AS value FROM yearly GROUP BY entity) SELECT origin, value, round(value / (SELECT max(value) FROM o), 6) AS share_of_max FROM o ORDER BY value DESC, origin LIMIT 6""",
)
def origins(spark, sf):
    o = nation_years(spark, sf).groupBy(F.col("entity").alias("origin")).agg(F.sum("n").cast("double").alias("value"))
    return ranking.origins(o, "origin", "value", 6).select("origin", "value", r("share_of_max", 6).alias("share_of_max"))


@query(
    "rule_chips",
    """SELECT c_custkey, concat_ws(',', CASE WHEN k % 4 = 0 THEN 'no_citizenship' WHEN k % 3 = 0 THEN 'citizenship_dual' ELSE 'citizenship' END, CASE WHEN k % 5 = 0 THEN 'free_tuition' WHEN k % 5 = 1 THEN 'high_tuition' END,
  CASE WHEN k % 7 = 0 THEN 'extra_checks' END) AS chips FROM (SELECT c_custkey, c_custkey + c_nationkey AS k FROM customer)""",
)
def rule_chips(spark, sf):
    k = F.col("c_custkey") + F.col("c_nationkey")
    chips = ranking.rule_chips(
        F.when(k % 4 != 0, 5), F.when(k % 3 == 0, True), F.when(k % 5 == 0, 0).when(k % 5 == 1, 40000).when(k % 5 == 2, 9000), F.when(k % 7 == 0, "high").otherwise("low")
    )
    return table(spark, sf, "customer").select("c_custkey", F.array_join(chips, ",").alias("chips"))


@query(
    "residency_order",
    "SELECT s_name, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey % 10)::INTEGER END AS years, s_suppkey % 6 = 0 AS no_path FROM supplier ORDER BY coalesce(years, 999), s_name",
)
def residency_order(spark, sf):
    s = table(spark, sf, "supplier").select("s_name", F.when(F.col("s_suppkey") % 6 != 0, (F.col("s_suppkey") % 10).cast("int")).alias("years"))
    return ranking.residency_order(s, "years", "s_name")


@query(
    "salary_thresholds",
    "SELECT s_name, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS amount, s_suppkey % 6 <> 0 AS has FROM supplier",
)
def salary_thresholds(spark, sf):
    s = table(spark, sf, "supplier").select("s_name", F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal")).alias("amount"))
    has, without = ranking.thresholds(s, "amount", "s_name")
    return has.withColumn("has", F.lit(True)).unionByName(without.withColumn("has", F.lit(False)))


@query(
    "compare_view",
    WITH(CITY, MONEY, METRICS_SQL)
    + """, a AS (SELECT country, metric, direction, avg(value) AS v FROM long WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3') AND metric IN ('savings', 'rent') GROUP BY ALL)
SELECT metric, round(max(v) FILTER (country = 'NATION_1'), 4) AS NATION_1, round(max(v) FILTER (country = 'NATION_2'), 4) AS NATION_2, round(max(v) FILTER (country = 'NATION_3'), 4) AS NATION_3, round(max(v), 4) AS row_max,
  CASE any_value(direction) WHEN 'higher' THEN arg_max(country, v) ELSE arg_min(country, v) END AS best FROM a GROUP BY metric""",
)
def compare_view(spark, sf):
    long = ranking.metric_long(ranking.derive_money(cities(spark, sf)), ["id", "country"], metric_registry())
    mean = long.groupBy("country", "metric", "direction").agg(F.avg("value").alias("value"))
    places = ["NATION_1", "NATION_2", "NATION_3"]
    out = ranking.compare_view(mean, "country", places, ["savings", "rent"])
    return out.select("metric", *[r(p).alias(p) for p in places], r("row_max").alias("row_max"), "best")


@query(
    "status_split",
    """SELECT s, st IN ('ok', 'partial') AS usable, count(*) AS n FROM (SELECT o_orderpriority AS s, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'partial' ELSE 'blocked' END AS st FROM orders) GROUP BY ALL""",
)
def status_split(spark, sf):
    from paylens.operators.quality import split_status

    st = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "partial").otherwise("blocked")
    usable, rest = split_status(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("s"), st.alias("status")), "status")
    both = usable.withColumn("usable", F.lit(True)).unionByName(rest.withColumn("usable", F.lit(False)))
    return both.groupBy("s", "usable").agg(F.count(F.lit(1)).alias("n"))


@query(
    "enrich_core",
    WITH(POSTING, YEARLY, RATES, CITY)
    + """SELECT c.country, count(*) AS cities, round(avg(gross), 4) AS mean_gross, max(t.value) AS total, max(t.year) AS total_year, round(max(q.rate), 6) AS rate, max(q.year) AS rate_year, any_value(r_name) AS region
FROM city c LEFT JOIN (SELECT n_name AS country, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) k USING (country)
LEFT JOIN (SELECT entity AS country, arg_max(value, year) AS value, max(year) AS year FROM yearly GROUP BY 1) t USING (country)
LEFT JOIN (SELECT country, arg_max(rate, year) AS rate, max(year) AS year FROM rates GROUP BY 1) q USING (country) GROUP BY c.country""",
)
def enrich_core(spark, sf):
    n, reg = table(spark, sf, "nation"), table(spark, sf, "region")
    countries = n.join(reg, n.n_regionkey == reg.r_regionkey).select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    fx = rates(spark, sf).select(F.col("country").alias("entity"), "year", F.col("rate").alias("value"))
    c = core.build_core(cities(spark, sf), countries, {"total": nation_years(spark, sf).drop("n"), "rate": fx}, "country")
    return c.groupBy("country").agg(
        F.count(F.lit(1)).alias("cities"), r(F.avg("gross")).alias("mean_gross"), F.max("total").alias("total"), F.max("total_year").alias("total_year"),
        r(F.max("rate"), 6).alias("rate"), F.max("rate_year").alias("rate_year"), F.min("region").alias("region"),
    )


@query(
    "fan_out",
    """WITH m AS (SELECT n_nationkey AS code, unnest(['a', 'b', 'c'][:n_nationkey % 3 + 1]) AS city FROM nation), d AS (SELECT s_nationkey AS code, strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_quantity), 9) AS value, count(l_quantity) AS days
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT code, city, month, value, days FROM d JOIN m USING (code)""",
)
def fan_out(spark, sf):
    from paylens.operators.series import monthly_mean

    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    d = monthly_mean(li.join(s, li.l_suppkey == s.s_suppkey).withColumnRenamed("s_nationkey", "code"), ["code"], F.date_format("l_shipdate", "yyyy-MM"), "l_quantity", 9)
    cities_of = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.col("n_nationkey") % 3 + 1)
    m = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.explode(cities_of).alias("city"))
    return d.join(m, "code").select("code", "city", "month", "value", "days")


@query(
    "map_dots",
    WITH(POSTING) + "SELECT country, count(*) AS n, any_value(n_nationkey * 3.0::DOUBLE - 30) AS lat FROM posting JOIN nation ON n_name = country WHERE status = 'F' AND n_nationkey % 4 <> 0 GROUP BY country",
)
def map_dots(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey % 4 <> 0").select(F.col("n_name").alias("country"), (F.col("n_nationkey") * 3.0 - 30).alias("lat"))
    return plans_postings.map_dots(postings(spark, sf).filter("status = 'F'"), n).select("country", "n", "lat")


@query("seed_companies", WITH(POSTING) + "SELECT provider, company_slug, count(*) AS jobs FROM posting GROUP BY ALL ORDER BY jobs DESC, provider, company_slug")
def seed_companies(spark, sf):
    return plans_postings.companies(postings(spark, sf))


@query(
    "weighted_mean",
    """SELECT p_brand, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_mean, sum(l_quantity) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def weighted_mean(spark, sf):
    from paylens.plans.wages import weighted_mean as f

    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return f(li.join(p, li.l_partkey == p.p_partkey), ["p_brand"], "l_extendedprice", "l_quantity").withColumn("weighted_mean", r("weighted_mean"))


@query(
    "denominators",
    WITH(POSTING) + "SELECT year, max(k)::BIGINT AS ranked_of FROM (SELECT year, country, count(*) AS k FROM posting GROUP BY ALL) GROUP BY year",
)
def denominators(spark, sf):
    k = postings(spark, sf).groupBy("year", "country").agg(F.count(F.lit(1)).alias("k"))
    return ranking.rank_of(k, "year", "k", "country").select("year", "ranked_of").distinct()
