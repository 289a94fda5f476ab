"""Series queries: yearly order totals per nation, monthly and daily points."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.operators import lookups, ranking, series
from paylens.plans import core, wages
from paylens.queries.common import POSTING, WITH, YEARLY, nation_years, postings, r, table
from paylens.queries.registry import query


@query(
    "yoy",
    WITH(POSTING, YEARLY)
    + "SELECT entity, year, round((value / prev - 1) * 100, 6) AS change_pct FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY year) AS prev FROM yearly) WHERE prev IS NOT NULL",
)
def yoy(spark, sf):
    return series.yoy(nation_years(spark, sf), ["entity"], "year", "value").select("entity", "year", r("change_pct", 6).alias("change_pct"))


@query(
    "rebase",
    WITH(POSTING, YEARLY)
    + """, y AS (SELECT * FROM yearly WHERE NOT (entity = 'NATION_3' AND year = 1997))
SELECT entity, year, round(100 * value / coalesce(max(CASE WHEN year = 1997 THEN value END) OVER (PARTITION BY entity), arg_min(value, year) OVER (PARTITION BY entity)), 6) AS "index" FROM y""",
)
def rebase(spark, sf):
    y = nation_years(spark, sf).filter("NOT (entity = 'NATION_3' AND year = 1997)")
    return series.rebase(y, ["entity"], "year", "value", 1997).select("entity", "year", r("index", 6).alias("index"))


@query(
    "compound_growth",
    WITH(POSTING, YEARLY)
    + """, act AS (SELECT * FROM yearly WHERE year <= 1998), g AS (SELECT entity, year, CASE WHEN n % 17 = 0 THEN -100 ELSE (n % 9 - 3) / 2.0 END::DOUBLE AS rate FROM yearly WHERE year >= 1998),
b AS (SELECT entity, max(year) AS last, arg_max(value, year) AS base FROM act GROUP BY entity),
w AS (SELECT g.entity, g.year, base, sum(CASE WHEN rate > -100 THEN ln(CASE WHEN rate > -100 THEN rate / 100 + 1 END) END) OVER x AS l, max(CASE WHEN rate <= -100 THEN 1 ELSE 0 END) OVER x AS gone
  FROM g JOIN b USING (entity) WHERE g.year > last WINDOW x AS (PARTITION BY g.entity ORDER BY g.year))
SELECT entity, year, round(CASE WHEN gone = 1 THEN 0 ELSE base * exp(l) END, 2) AS value FROM w""",
)
def compound_growth(spark, sf):
    y = nation_years(spark, sf)
    rate = F.when(F.col("n") % 17 == 0, -100.0).otherwise((F.col("n") % 9 - 3) / 2.0)
    g = y.filter("year >= 1998").select("entity", "year", rate.alias("rate"))
    out = series.compound(y.filter("year <= 1998"), g, ["entity"], "year", "value", "rate")
    return out.select("entity", "year", r("value", 2).alias("value"))


EXTRA = """, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC) AS rn FROM yearly),
e AS (SELECT entity, min(year) AS t0, arg_min(value, year) AS v0, max(year) AS t1, arg_max(value, year) AS v1 FROM r WHERE rn <= {k} GROUP BY entity HAVING max(year) > min(year))
SELECT entity, y::INTEGER AS year, round(v1 + (v1 - v0) / (t1 - t0) * (y - t1), 2) AS value FROM e, range(1990, 2007) q(y) WHERE y > t1 - {a}"""


@query("extrapolate", WITH(POSTING, YEARLY) + EXTRA.format(k=4, a=0))
def extrapolate(spark, sf):
    return series.extrapolate(nation_years(spark, sf), ["entity"], "year", "value", 2006, points=4).withColumn("value", r("value", 2))


@query("extrapolate_anchored", WITH(POSTING, YEARLY) + EXTRA.format(k=10, a=1))
def extrapolate_anchored(spark, sf):
    return series.extrapolate(nation_years(spark, sf), ["entity"], "year", "value", 2006, anchor=True).withColumn("value", r("value", 2))


@query(
    "apply_trend",
    WITH(POSTING, YEARLY)
    + """, l AS (SELECT entity, arg_max(value, year) AS latest FROM yearly GROUP BY entity), c AS (SELECT s_name AS place, n_name AS entity, s_acctbal AS now FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT place, entity, year, round(now * (value / latest), 4) AS value, true AS is_estimate FROM c JOIN yearly USING (entity) JOIN l USING (entity)""",
)
def apply_trend(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    c = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("place"), F.col("n_name").alias("entity"), F.col("s_acctbal").alias("value"))
    return series.apply_trend(c, nation_years(spark, sf), "place", "entity", "year", "value").withColumn("value", r("value"))


@query(
    "monthly_mean",
    """SELECT event_type, strftime(ts, '%Y-%m') AS month, round(avg(value), 4) AS value, count(value) AS days FROM events GROUP BY ALL""",
)
def monthly_mean(spark, sf):
    e = table(spark, sf, "events")
    return series.monthly_mean(e, ["event_type"], F.date_format("ts", "yyyy-MM"), "value", 4)


@query(
    "last_per_year",
    WITH(POSTING)
    + "SELECT country, year, floor(arg_max(pay, posted_at || '|' || lpad(id::VARCHAR, 20, '0')) * 10 + 0.5) / 10 AS value FROM posting GROUP BY ALL",
)
def last_per_year(spark, sf):
    p = postings(spark, sf).withColumn("t", F.concat_ws("|", "posted_at", F.lpad(F.col("id").cast("string"), 20, "0")))
    return series.last_per_year(p, ["country"], "year", "t", "pay")


@query("mean_per_year", WITH(POSTING) + "SELECT country, year, floor(avg(pay) * 10 + 0.5) / 10 AS value FROM posting GROUP BY ALL")
def mean_per_year(spark, sf):
    return series.mean_per_year(postings(spark, sf), ["country"], "year", "pay")


@query(
    "climate_normals",
    """WITH m AS (SELECT o_custkey % 60 AS city, month(o_orderdate)::INTEGER AS month, avg(o_totalprice / 10000) AS h, avg(o_totalprice / 20000) AS l FROM orders GROUP BY ALL),
f AS (SELECT city FROM m GROUP BY city HAVING count(*) = 12)
SELECT city, month, round(h, 1) AS avg_high, round(l, 1) AS avg_low, round((h + l) / 2, 1) AS mean FROM m JOIN f USING (city)""",
)
def climate_normals(spark, sf):
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 60).alias("city"), F.col("o_orderdate").alias("d"), (F.col("o_totalprice") / 10000).alias("h"), (F.col("o_totalprice") / 20000).alias("l")
    )
    return series.climate_normals(o, "city", "d", "h", "l")


@query("latest_observation", WITH(POSTING, YEARLY) + "SELECT entity, max(year) AS year, arg_max(value, year) AS value, arg_max(n, year) AS n FROM yearly GROUP BY entity")
def latest_observation(spark, sf):
    return lookups.latest(nation_years(spark, sf), ["entity"], "year", ["value", "n"])


@query("first_period", "SELECT l_suppkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_period FROM lineitem GROUP BY ALL")
def first_period(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"))
    return series.first_period(li, ["l_suppkey"], "d")


@query(
    "year_spread",
    """WITH o AS (SELECT c_nationkey AS g, year(o_orderdate)::INTEGER AS year, o_orderkey AS pos, c_name AS label FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT g, max(year) - min(year) AS spread, min(year) AS oldest_year, arg_min(label, (year, pos)) AS oldest, max(year) AS newest_year, arg_min(label, (-year, pos)) AS newest FROM o GROUP BY g HAVING count(*) >= 2""",
)
def year_spread(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    d = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("g"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("pos"), F.col("c_name").alias("label")
    )
    return series.year_spread(d, ["g"], "year", "label", "pos")


@query(
    "thin_series",
    WITH(POSTING, YEARLY)
    + "SELECT entity, year, value, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year) AS rn, count(*) OVER (PARTITION BY entity) AS k FROM yearly) WHERE rn % 2 = 1 OR rn = k",
)
def thin_series(spark, sf):
    return series.thin(nation_years(spark, sf), ["entity"], "year")


@query(
    "axis_domain",
    """SELECT p_brand, count(v) FILTER (NOT off) AS in_scale, CASE WHEN count(v) FILTER (NOT off) >= 2 THEN min(v) FILTER (NOT off) ELSE min(v) END AS lo,
  CASE WHEN count(v) FILTER (NOT off) >= 2 THEN max(v) FILTER (NOT off) ELSE max(v) END AS hi FROM (SELECT p_brand, p_retailprice AS v, p_size > 3 OR p_brand = 'Brand#7' AS off FROM part) GROUP BY p_brand""",
)
def axis_domain(spark, sf):
    p = table(spark, sf, "part").withColumn("off", (F.col("p_size") > 3) | (F.col("p_brand") == "Brand#7"))
    return series.domain(p, ["p_brand"], "p_retailprice", "off")


@query(
    "monotone_breaks",
    WITH(POSTING, YEARLY)
    + "SELECT entity, year, value, n, previous FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY year) AS previous FROM yearly) WHERE value < previous - 1000",
)
def monotone_breaks(spark, sf):
    return series.monotone(nation_years(spark, sf), ["entity"], "year", "value", 1000.0)


@query(
    "headline",
    WITH(POSTING, YEARLY)
    + """, p AS (SELECT entity, min(year) AS "from", max(year) AS "to", arg_min(value, year) AS first, arg_max(value, year) AS last FROM yearly GROUP BY entity)
SELECT entity, "from", "to", first, last, round((last / first - 1) * 100, 6) AS change_pct, last = max(last) OVER () AS is_highest, last = min(last) OVER () AS is_lowest FROM p""",
)
def headline(spark, sf):
    return series.headline(nation_years(spark, sf), "entity", "year", "value").withColumn("change_pct", r("change_pct", 6))


@query(
    "periods_at_top",
    WITH(POSTING, YEARLY)
    + "SELECT entity, count(*) AS periods_at_top FROM (SELECT year, arg_min(entity, (-value, entity)) AS entity FROM yearly GROUP BY year) GROUP BY entity",
)
def periods_at_top(spark, sf):
    return series.periods_at_top(nation_years(spark, sf), "entity", "year", "value")


@query(
    "theme_table",
    WITH(POSTING)
    + """SELECT country AS entity, year, round(avg(pay), 2) AS mean_pay, count(*) AS postings, round(100 * count(*) FILTER (status = 'F') / count(*), 4) AS filled_pct FROM posting GROUP BY ALL""",
)
def theme_table(spark, sf):
    p = postings(spark, sf).groupBy(F.col("country").alias("entity"), "year").agg(
        F.avg("pay").alias("a"), F.count(F.lit(1)).alias("n"), (100 * F.count_if(F.col("status") == "F") / F.count(F.lit(1))).alias("f")
    )
    return core.theme_table(p, {"mean_pay": r("a", 2), "postings": F.col("n"), "filled_pct": r("f")}, "entity", "year")


BANDS = """band AS (SELECT n_name AS entity, s_suppkey % 4 AS b, avg(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
  UNION ALL SELECT n_name, -1, avg(s_acctbal) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
curve AS (SELECT x.entity, x.b, 25 + 10.0::DOUBLE * x.b AS age, round((x.v / t.v - 1) * 100, 2) AS premium_pct FROM band x JOIN band t ON t.entity = x.entity AND t.b = -1 WHERE x.b >= 0)"""


def bands(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    d = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("entity"), (F.col("s_suppkey") % 4).cast("int").alias("b"), "s_acctbal")
    per = d.groupBy("entity", "b").agg(F.avg("s_acctbal").alias("v"))
    return per.unionByName(d.groupBy("entity").agg(F.avg("s_acctbal").alias("v")).withColumn("b", F.lit(-1)))


def curve(spark, sf):
    c = wages.premium_curve(bands(spark, sf), "entity", "b", "v", -1)
    return c.withColumn("age_midpoint", F.lit(25.0) + 10.0 * F.col("b"))


@query("premium_curve", WITH(BANDS) + "SELECT entity, b, age AS age_midpoint, premium_pct FROM curve")
def premium_curve(spark, sf):
    return curve(spark, sf).select("entity", F.col("b").cast("long").alias("b"), "age_midpoint", "premium_pct")


@query(
    "experience_gradient",
    WITH(BANDS) + "SELECT entity, b, premium_pct, coalesce(premium_pct < lag(premium_pct) OVER (PARTITION BY entity ORDER BY b) - 0.01, false) AS falls FROM curve",
)
def experience_gradient(spark, sf):
    g = wages.experience_gradient(bands(spark, sf), "entity", "b", "v", -1, "b")
    return g.select("entity", F.col("b").cast("long").alias("b"), "premium_pct", "falls")


CURVE_AT = """seg AS (SELECT entity, age AS x0, premium_pct AS y0, lead(age) OVER w AS x1, lead(premium_pct) OVER w AS y1, first_value(age) OVER w AS lo,
    first_value(premium_pct) OVER w AS ylo FROM curve WINDOW w AS (PARTITION BY entity ORDER BY age)),
ends AS (SELECT entity, min(age) AS lo, arg_min(premium_pct, age) AS ylo, max(age) AS hi, arg_max(premium_pct, age) AS yhi FROM curve GROUP BY entity)"""


@query(
    "curve_lookup",
    WITH(BANDS, CURVE_AT)
    + """, p AS (SELECT c_custkey, n_name AS entity, 20.0::DOUBLE + c_custkey % 45 AS age FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, p.entity, age, round(CASE WHEN age <= lo THEN ylo WHEN age >= hi THEN yhi
  ELSE (SELECT max(y0 + (age - x0) / (x1 - x0) * (y1 - y0)) FROM seg WHERE seg.entity = p.entity AND age >= x0 AND age < x1) END, 6) AS premium,
  CASE WHEN age < lo THEN 'low' WHEN age > hi THEN 'high' END AS clamped FROM p LEFT JOIN ends e ON e.entity = p.entity""",
)
def curve_lookup(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    p = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("entity"), (F.lit(20.0) + F.col("c_custkey") % 45).alias("age"))
    out = lookups.curve_lookup(p, curve(spark, sf), ["entity"], "age", "age_midpoint", "premium_pct", "premium")
    return out.withColumn("premium", r("premium", 6))


DIST = """dist AS (SELECT country AS entity, avg(pay) AS mean, median(pay) AS median, quantile_cont(pay, 0.1) AS p10, quantile_cont(pay, 0.25) AS p25, quantile_cont(pay, 0.75) AS p75, quantile_cont(pay, 0.9) AS p90
  FROM posting GROUP BY country),
pts AS (SELECT entity, unnest([p10, p25, median, p75, p90]) AS v, unnest([10.0, 25.0, 50.0, 75.0, 90.0])::DOUBLE AS pct FROM dist)"""


def distribution(spark, sf):
    from paylens.operators.quantiles import group_quantiles

    p = postings(spark, sf).withColumnRenamed("country", "entity")
    q = group_quantiles(p, ["entity"], "pay", {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    return q.drop("n").join(p.groupBy("entity").agg(F.avg("pay").alias("mean")), "entity")


RANKED = """CASE WHEN {v} <= p10 THEN 10 WHEN {v} >= p90 THEN 90 WHEN {v} < p25 THEN 10 + ({v} - p10) / (p25 - p10) * 15 WHEN {v} < median THEN 25 + ({v} - p25) / (median - p25) * 25
  WHEN {v} < p75 THEN 50 + ({v} - median) / (p75 - median) * 25 ELSE 75 + ({v} - p75) / (p90 - p75) * 15 END"""


@query(
    "rank_within",
    WITH(POSTING, DIST)
    + f"""SELECT id, round({RANKED.format(v="pay")}, 6) AS pct, CASE WHEN pay < p10 THEN 'low' WHEN pay > p90 THEN 'high' END AS clamped FROM posting JOIN dist ON entity = country""",
)
def rank_within(spark, sf):
    p = postings(spark, sf).select("id", F.col("country").alias("entity"), "pay").join(distribution(spark, sf), "entity")
    k = p.withColumn("points", wages.known_points(F.col)).withColumn("r", wages.rank_within(F.col("pay"), F.col("points")))
    return k.select("id", r("r.pct", 6).alias("pct"), "r.clamped")


@query(
    "estimate_and_position",
    WITH(POSTING, BANDS, CURVE_AT, DIST)
    + f""", p AS (SELECT c_custkey, n_name AS entity, (c_custkey % 30)::INTEGER AS years, c_nationkey % 5 <> 0 AS comparable, CASE WHEN c_nationkey % 2 = 0 THEN 'mean' ELSE 'median' END AS premium_basis
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT p.*, d.*, 22.0::DOUBLE + years AS age, lo, ylo, hi, yhi FROM p JOIN dist d ON d.entity = p.entity LEFT JOIN ends e ON e.entity = p.entity),
c AS (SELECT c_custkey, floor(CASE WHEN age <= lo THEN ylo WHEN age >= hi THEN yhi ELSE (SELECT max(y0 + (age - x0) / (x1 - x0) * (y1 - y0)) FROM seg WHERE seg.entity = a.entity AND age >= x0 AND age < x1) END * 10 + 0.5) / 10 AS premium,
  comparable, premium_basis, mean, median, p10, p25, p75, p90 FROM a),
s AS (SELECT *, CASE WHEN premium IS NOT NULL THEN (CASE WHEN premium_basis = 'mean' THEN mean ELSE median END) * (1 + premium / 100) END AS shifted FROM c)
SELECT c_custkey, premium, CASE WHEN comparable THEN round(CASE WHEN shifted IS NULL THEN median ELSE greatest(p10, least(p90, shifted)) END, 7) END AS estimate,
  CASE WHEN comparable THEN round(CASE WHEN shifted IS NULL THEN 50 ELSE {RANKED.format(v="shifted")} END, 6) END AS position, CASE WHEN comparable THEN shifted IS NOT NULL END AS personalised,
  CASE WHEN comparable THEN CASE WHEN shifted < p10 THEN 'low' WHEN shifted > p90 THEN 'high' END END AS clamped, CASE WHEN NOT comparable THEN 'not comparable' END AS reason FROM s""",
)
def estimate_and_position(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    p = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", F.col("n_name").alias("entity"), (F.col("c_custkey") % 30).cast("int").alias("years"), (F.col("c_nationkey") % 5 != 0).alias("comparable"),
        F.when(F.col("c_nationkey") % 2 == 0, "mean").otherwise("median").alias("premium_basis"),
    )
    rows = p.join(distribution(spark, sf), "entity")
    out = wages.position_and_estimate(rows, curve(spark, sf), "entity", "years")
    return out.select("c_custkey", "premium", r("estimate", 7).alias("estimate"), r("position", 6).alias("position"), "personalised", "clamped", "reason")


@query(
    "month_to_x",
    "SELECT month, round(split_part(month, '-', 1)::INTEGER + (split_part(month, '-', 2)::INTEGER - 1) / 12.0, 6) AS x, n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)",
)
def month_to_x(spark, sf):
    from paylens.functions.text import month_to_x as f

    m = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("x", r(f(F.col("month")), 6))


@query(
    "axis_years",
    """SELECT o_orderkey, round(greatest(2, least(97, CASE WHEN v >= 130 THEN 95 WHEN v <= 30 THEN 4 + (v - 2) / 28 * 70 ELSE 74 + (v - 30) / 100 * 18 END)), 9) AS x FROM (SELECT o_orderkey, o_totalprice / 2000 AS v FROM orders)""",
)
def axis_years(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r(ranking.axis_years(F.col("o_totalprice") / 2000), 9).alias("x"))
