"""Data-quality findings over orders, lineitem, part, customer, supplier and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.functions import money, text
from paylens.operators import crosswalk, lookups, quality, sets
from paylens.operators.quantiles import group_quantiles
from paylens.plans import core
from paylens.queries.common import HOURS, POSTING, RATES, WITH, YEARLY, hours, nation_years, postings, r, rates, table
from paylens.queries.pay import ANNUAL, MAPPINGS, annual, mappings
from paylens.queries.registry import query

# One wage record per brand: percentiles of the price of its parts, some of them spoilt on purpose
# by a rule over the brand number.
WAGE = """wage AS (SELECT p_brand AS brand, k, count(*) AS n, round(avg(v), 4) AS mean, round(CASE WHEN k % 7 = 0 THEN quantile_cont(v, 0.9) ELSE quantile_cont(v, 0.1) END, 4) AS p10,
    round(quantile_cont(v, 0.25), 4) AS p25, round(CASE WHEN k % 5 = 0 THEN 0 ELSE median(v) END, 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75, round(CASE WHEN k % 3 = 0 THEN NULL ELSE quantile_cont(v, 0.9) END, 4) AS p90
  FROM (SELECT p_brand, regexp_extract(p_brand, '[0-9]+')::INTEGER AS k, p_retailprice AS v FROM part) GROUP BY p_brand, k)"""


def wage(spark, sf):
    p = table(spark, sf, "part").withColumn("k", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int"))
    keys = ["p_brand", "k"]
    q = group_quantiles(p, keys, "p_retailprice", {"a": 0.1, "p25": 0.25, "m": 0.5, "p75": 0.75, "z": 0.9})
    q = q.join(p.groupBy(*keys).agg(F.avg("p_retailprice").alias("avg")), keys)
    return q.select(
        F.col("p_brand").alias("brand"), "k", "n", r("avg").alias("mean"), r(F.when(F.col("k") % 7 == 0, F.col("z")).otherwise(F.col("a"))).alias("p10"),
        r("p25").alias("p25"), r(F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.col("m"))).alias("median"), r("p75").alias("p75"),
        r(F.when(F.col("k") % 3 != 0, F.col("z"))).alias("p90"),
    )


FIELDS = {s: s for s in ("mean", "p10", "p25", "median", "p75", "p90")}


@query(
    "findings_percentiles",
    WITH(WAGE)
    + """, l AS (SELECT brand, unnest(['p10', 'p25', 'median', 'p75', 'p90']) AS s, unnest([p10, p25, median, p75, p90]) AS v, unnest([1, 2, 3, 4, 5]) AS o FROM wage),
x AS (SELECT brand, s, v, lead(s) OVER w AS s2, lead(v) OVER w AS v2 FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY brand ORDER BY o))
SELECT 'percentiles_ordered' AS rule, 'error' AS severity, brand AS entity, s || '<=' || s2 AS field, v AS observed, v2 AS bound FROM x WHERE v > v2""",
)
def findings_percentiles(spark, sf):
    return quality.check_percentiles(wage(spark, sf), "brand", FIELDS).drop("detail")


@query(
    "findings_mean_range",
    WITH(WAGE) + "SELECT 'mean_in_range' AS rule, brand AS entity, mean AS observed, CASE WHEN mean < p10 THEN p10 ELSE p90 END AS bound FROM wage WHERE mean < p10 OR mean > p90",
)
def findings_mean_range(spark, sf):
    return quality.check_mean_in_range(wage(spark, sf), "brand", "mean", "p10", "p90").select("rule", "entity", "observed", "bound")


LONG = """long AS (SELECT brand AS entity, 'sek' AS unit, unnest(['mean_sek_month', 'p10_sek_month', 'p25_sek_month', 'median_sek_month', 'p75_sek_month', 'p90_sek_month']) AS field,
  unnest([mean, p10, p25, median, p75, p90]) AS value FROM wage)"""


def wage_long(spark, sf):
    w = wage(spark, sf)
    names = {s: f"{s}_sek_month" for s in ("mean", "p10", "p25", "median", "p75", "p90")}
    w = w.select(F.col("brand").alias("entity"), *[F.col(s).alias(n) for s, n in names.items()])
    return quality.unpivot_wages(w, ["entity"], list(names.values()))


@query(
    "field_grammar",
    WITH(WAGE, LONG)
    + "SELECT entity, field, value, '' AS prefix, split_part(field, '_', 1) AS statistic, '_sek_month' AS suffix, 'SEK' AS currency, 'month' AS period FROM long WHERE value IS NOT NULL",
)
def field_grammar(spark, sf):
    long = wage_long(spark, sf)
    cur, per = text.resolve_unit(F.col("field"), F.lit("data"))
    return long.withColumns({"currency": cur, "period": per})


@query(
    "findings_positive_pay",
    WITH(WAGE, LONG) + "SELECT entity, field, value AS observed, 'zero in place of a missing value' AS detail FROM long WHERE value = 0",
)
def findings_positive_pay(spark, sf):
    long = wage_long(spark, sf).withColumns({"currency": F.lit("SEK"), "period": F.lit("month")})
    return quality.check_positive_pay(long, "entity").select("entity", "field", "observed", "detail")


@query(
    "unit_resolve",
    """WITH x AS (SELECT p_brand, CASE p_size % 5 WHEN 0 THEN 'total_mean' WHEN 1 THEN 'median_eur' WHEN 2 THEN 'p25_q1_cad_hour' WHEN 3 THEN 'annual_p50_usd' ELSE 'mean_paid_weekly_hours' END AS field,
  CASE WHEN p_partkey % 3 = 0 THEN 'age_bands_eur_year' ELSE 'plain' END AS container, CASE WHEN p_partkey % 2 = 0 THEN 'SEK' END AS c, CASE WHEN p_partkey % 4 = 0 THEN 'month' END AS p FROM part WHERE p_size % 5 <> 4),
y AS (SELECT field, coalesce(CASE WHEN field LIKE '%eur%' THEN 'EUR' WHEN field LIKE '%cad%' THEN 'CAD' WHEN field LIKE '%usd%' THEN 'USD' END, CASE container WHEN 'plain' THEN NULL ELSE 'EUR' END, c) AS currency,
  coalesce(CASE WHEN field LIKE '%hour%' THEN 'hour' WHEN field LIKE '%annual%' THEN 'year' END, CASE container WHEN 'plain' THEN NULL ELSE 'year' END, p) AS period FROM x)
SELECT field, currency, period, count(*) AS n FROM y GROUP BY ALL""",
)
def unit_resolve(spark, sf):
    cur, per = text.resolve_unit(F.col("field"), F.col("container"), (F.col("currency"), F.col("period")))
    d = unit_leaves(spark, sf).filter("field <> 'mean_paid_weekly_hours'").withColumns({"__c": cur, "__p": per})
    return d.groupBy("field", F.col("__c").alias("currency"), F.col("__p").alias("period")).agg(F.count(F.lit(1)).alias("n"))


def unit_leaves(spark, sf):
    s, k = F.col("p_size") % 5, F.col("p_partkey")
    field = F.get(F.array(*[F.lit(x) for x in ("total_mean", "median_eur", "p25_q1_cad_hour", "annual_p50_usd", "mean_paid_weekly_hours")]), s)
    return table(spark, sf, "part").select(
        k.cast("string").alias("entity"), field.alias("field"), F.when(k % 3 == 0, "age_bands_eur_year").otherwise("plain").alias("container"),
        F.when(k % 2 == 0, "SEK").alias("currency"), F.when(k % 4 == 0, "month").alias("period"),
    )


@query(
    "findings_unit_disclosed",
    """WITH x AS (SELECT p_partkey AS k, p_size % 5 AS s FROM part WHERE p_size % 5 <> 4), y AS (SELECT k, s, s IN (1, 2, 3) OR k % 3 = 0 OR k % 2 = 0 AS hc, s IN (2, 3) OR k % 3 = 0 OR k % 4 = 0 AS hp FROM x)
SELECT k::VARCHAR AS entity, CASE WHEN NOT hc AND NOT hp THEN 'currency and period' WHEN NOT hc THEN 'currency' ELSE 'period' END AS detail FROM y WHERE NOT (hc AND hp)""",
)
def findings_unit_disclosed(spark, sf):
    return quality.check_unit_disclosed(unit_leaves(spark, sf), "entity").select("entity", "detail")


@query(
    "findings_distribution_label",
    WITH(WAGE)
    + """, l AS (SELECT *, CASE k % 4 WHEN 0 THEN 'mean-only' WHEN 1 THEN 'full' WHEN 2 THEN 'partial' ELSE 'quartile-only' END AS label FROM wage)
SELECT brand AS entity, CASE label WHEN 'partial' THEN 'unknown label' ELSE 'percentiles are published' END AS detail FROM l WHERE label IN ('partial', 'mean-only')""",
)
def findings_distribution_label(spark, sf):
    k = F.col("k") % 4
    w = wage(spark, sf).withColumn("label", F.when(k == 0, "mean-only").when(k == 1, "full").when(k == 2, "partial").otherwise("quartile-only"))
    return quality.check_distribution_label(w, "brand", "label", FIELDS).select("entity", "detail")


@query(
    "findings_magnitude",
    """WITH l AS (SELECT o_orderkey::VARCHAR AS entity, CASE o_orderstatus WHEN 'F' THEN 'hour' WHEN 'O' THEN 'month' ELSE 'year' END AS period, left(o_orderpriority, 1) AS currency,
  CASE o_orderstatus WHEN 'F' THEN o_totalprice / 200 WHEN 'O' THEN o_totalprice ELSE o_totalprice * 10 END AS value FROM orders),
m AS (SELECT currency, period, median(value) AS med FROM l GROUP BY ALL HAVING count(*) >= 5), d AS (SELECT currency, period, any_value(med) AS med, median(abs(value - med)) AS mad FROM l JOIN m USING (currency, period) GROUP BY ALL),
b AS (SELECT *, CASE WHEN mad > 0 THEN mad ELSE med * 0.05 END AS md FROM d), x AS (SELECT l.*, greatest(med - 8 * md, med / 4) AS lo, med + 8 * md AS hi, CASE period WHEN 'hour' THEN 0.5 WHEN 'month' THEN 50 ELSE 500 END AS alo,
  CASE period WHEN 'hour' THEN 2000 WHEN 'month' THEN 500000 ELSE 5000000 END AS ahi FROM l LEFT JOIN b USING (currency, period))
SELECT entity, round(value, 6) AS observed, CASE WHEN value < alo OR value > ahi THEN 'absolute' ELSE 'relative' END AS detail FROM x WHERE value < alo OR value > ahi OR value < lo OR value > hi""",
)
def findings_magnitude(spark, sf):
    st, v = F.col("o_orderstatus"), F.col("o_totalprice")
    long = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("entity"), F.lit("median").alias("field"), F.lit("").alias("prefix"), F.lit("median").alias("statistic"), F.lit("").alias("suffix"),
        F.when(st == "F", "hour").when(st == "O", "month").otherwise("year").alias("period"), F.substring("o_orderpriority", 1, 1).alias("currency"),
        F.when(st == "F", v / 200).when(st == "O", v).otherwise(v * 10).alias("value"),
    )
    return quality.check_magnitude(long).select("entity", r("observed", 6).alias("observed"), "detail")


@query(
    "findings_embedded",
    """WITH e AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS h, round(o_totalprice / 1000 * (37.0::DOUBLE * 52 / 12), 2) + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS c FROM orders),
f AS (SELECT *, c * CASE WHEN id % 70 = 0 THEN 1.02::DOUBLE ELSE 1.0001::DOUBLE END AS p FROM e), g AS (SELECT *, round(abs(c - p) / p * 100, 4) AS real, round(abs(c - p) / p * 100, 4) + CASE WHEN id % 90 = 0 THEN 0.5 ELSE 0 END AS res FROM f)
SELECT rule, count(*) AS n FROM (SELECT 'embedded_product' AS rule FROM g WHERE abs(round(h * (37.0::DOUBLE * 52 / 12), 2) - c) > 0.02 UNION ALL SELECT 'embedded_residual' FROM g WHERE abs(real - res) > 0.001 UNION ALL SELECT 'embedded_bound' FROM g WHERE real > 1.0) GROUP BY rule""",
)
def findings_embedded(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(k.cast("string").alias("id"), k.alias("k"), (F.col("o_totalprice") / 1000).alias("h"))
    d = d.withColumn("c", F.round(F.col("h") * (37.0 * 52 / 12), 2) + F.when(F.col("k") % 50 == 0, 1).otherwise(0))
    d = d.withColumn("p", F.col("c") * F.when(F.col("k") % 70 == 0, 1.02).otherwise(1.0001))
    d = d.withColumn("res", F.round(F.abs(F.col("c") - F.col("p")) / F.col("p") * 100, 4) + F.when(F.col("k") % 90 == 0, 0.5).otherwise(0.0))
    return quality.check_embedded(d, "id", "h", "c", "p", "res").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


SOURCES = """src AS (SELECT CASE o_custkey % 6 WHEN 0 THEN 'postings_' WHEN 1 THEN 'fx_rates' WHEN 2 THEN 'salary_' WHEN 3 THEN 'mipex' WHEN 4 THEN 'levels_fyi' ELSE 'other_' END
    || CASE WHEN o_custkey % 6 IN (0, 2, 5) THEN o_custkey::VARCHAR ELSE '' END AS source_id, max(o_orderdate) AS fetched FROM orders GROUP BY ALL)"""


def sources(spark, sf):
    k = F.col("o_custkey") % 6
    stem = F.get(F.array(*[F.lit(x) for x in ("postings_", "fx_rates", "salary_", "mipex", "levels_fyi", "other_")]), k)
    sid = F.concat(stem, F.when(k.isin(0, 2, 5), F.col("o_custkey").cast("string")).otherwise(""))
    return table(spark, sf, "orders").groupBy(sid.alias("source_id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("fetched_at"))


@query(
    "findings_refresh",
    WITH(SOURCES)
    + """, a AS (SELECT *, date_diff('day', fetched::DATE, DATE '2001-08-01') AS age, 30 * CASE WHEN source_id LIKE 'postings%' THEN 1 WHEN source_id = 'fx_rates' THEN 3 WHEN source_id = 'mipex' THEN 24 WHEN source_id = 'levels_fyi' THEN 6 ELSE 15 END AS lim FROM src)
SELECT source_id AS entity, age::DOUBLE AS observed, lim::DOUBLE AS bound FROM a WHERE age > lim""",
)
def findings_refresh(spark, sf):
    return quality.check_refresh(sources(spark, sf), "source_id", "fetched_at", "2001-08-01").select("entity", "observed", "bound")


@query(
    "source_freshness",
    WITH(SOURCES)
    + """, a AS (SELECT *, date_diff('day', fetched::DATE, DATE '2001-08-01') AS age, 30 * CASE WHEN source_id LIKE 'postings%' THEN 1 WHEN source_id = 'fx_rates' THEN 3 WHEN source_id = 'mipex' THEN 24 WHEN source_id = 'levels_fyi' THEN 6 ELSE 15 END AS lim FROM src)
SELECT source_id, age <= lim AS fresh, age::INTEGER AS age_days FROM a""",
)
def source_freshness(spark, sf):
    s = sources(spark, sf)
    age = F.datediff(F.to_date(F.lit("2001-08-01")), F.to_date("fetched_at"))
    return s.select("source_id", (age <= quality.refresh_months(F.col("source_id")) * 30).alias("fresh"), age.alias("age_days"))


@query(
    "identity_check",
    """WITH b AS (SELECT l_suppkey AS k, sum(l_quantity) AS h, round(sum(l_quantity) * 160.333, 2) AS m FROM lineitem GROUP BY ALL)
SELECT count(*) AS checked, round(max(abs(h * 160.33 - m) / abs(m) * 100), 6) AS worst_pct, max(abs(h * 160.33 - m) / abs(m) * 100) <= 0.5 AS holds FROM b WHERE m <> 0""",
)
def identity_check(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("h"))
    a = g.select("k", F.col("h").alias("value"))
    b = g.select("k", F.round(F.col("h") * 160.333, 2).alias("value"))
    return quality.check_identity(a, b, ["k"], 160.33, 0.5).withColumn("worst_pct", r("worst_pct", 6))


@query(
    "merge_stamp",
    """WITH a AS (SELECT o_custkey AS k, max(o_orderdate) AS m FROM orders WHERE o_orderdate < DATE '2000-01-01' GROUP BY ALL), b AS (SELECT o_custkey AS k, max(o_orderdate) AS m FROM orders GROUP BY ALL)
SELECT k::VARCHAR AS entity, strftime(a.m, '%Y-%m-%d') || ' -> ' || strftime(b.m, '%Y-%m-%d') AS detail FROM a JOIN b USING (k) WHERE a.m <> b.m""",
)
def merge_stamp(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    merged = o.filter("d < '2000-01-01'").groupBy("k").agg(F.max("d").alias("stamp"))
    now = o.groupBy("k").agg(F.max("d").alias("stamp"))
    return quality.check_merge_current(merged, now, "k", "stamp").select("entity", "detail")


@query(
    "findings_annualised",
    WITH(POSTING, RATES)
    + """, m AS (SELECT id, (min / rate / 10 + max / rate / 10) / 2 * CASE period WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'hour' THEN 2080 END AS y FROM posting JOIN rates USING (country, year))
SELECT id::VARCHAR AS entity, round(y, 2) AS observed, CASE WHEN y < 500 THEN 500 ELSE 5000000 END::DOUBLE AS bound FROM m WHERE y < 500 OR y > 5000000""",
)
def findings_annualised(spark, sf):
    p = postings(spark, sf).join(rates(spark, sf), ["country", "year"])
    p = p.select("id", "period", (F.col("min") / F.col("rate") / 10).alias("usd_min"), (F.col("max") / F.col("rate") / 10).alias("usd_max"))
    return quality.check_annualised(p, "id").select("entity", r("observed", 2).alias("observed"), "bound")


@query(
    "findings_curated",
    """SELECT rule, field, count(*) AS n FROM (
  SELECT 'unique_id' AS rule, 'cities' AS field FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)
  UNION ALL SELECT 'as_of', 'cities' FROM part WHERE p_size = 7 UNION ALL SELECT 'sources', 'cities' FROM part WHERE p_size = 9
  UNION ALL SELECT 'known_country', p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')
  UNION ALL SELECT 'salary_bands', 'salary' FROM part WHERE p_size % 10 = 0
  UNION ALL SELECT 'fake_null', 'note' FROM part WHERE p_size = 11
  UNION ALL SELECT 'tax_range', 'net_pct' FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand IN ('Brand#3', 'Brand#4')) GROUP BY ALL""",
)
def findings_curated(spark, sf):
    p, s = table(spark, sf, "part"), F.col("p_size")
    price = F.col("p_retailprice")
    cities = p.select(
        F.col("p_name").alias("id"), F.col("p_brand").alias("country"), F.when(s != 7, "2026-01").alias("as_of"), F.when(s != 9, F.array(F.lit("a"))).alias("sources"),
        price.alias("new_grad"), F.when(s % 10 == 0, price - 1).otherwise(price + 1).alias("mid"), (price + 2).alias("senior"), F.when(s == 11, " TBD ").otherwise("fine").alias("note"),
    )
    brand = F.col("p_brand")
    countries = p.filter(~brand.isin("Brand#1", "Brand#2")).select(
        brand.alias("id"), F.lit("2026-01").alias("as_of"), F.array(F.lit("a")).alias("sources"),
        F.when(brand == "Brand#3", 20.0).when(brand == "Brand#4", 120.0).otherwise(60.0).alias("net_pct"),
    ).distinct()
    return quality.check_curated(cities, countries).groupBy("rule", "field").agg(F.count(F.lit(1)).alias("n"))


DATASETS = """ds AS (SELECT c_custkey::VARCHAR AS source_id, CASE WHEN c_custkey % 50 <> 0 THEN '2026-01-01' END AS generated_at, c_custkey % 60 <> 0 AS meta_present, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey % 7 + 1 END AS rows, c_custkey AS k FROM customer),
pv AS (SELECT c_custkey::VARCHAR AS source_id, CASE WHEN c_custkey % 40 <> 0 THEN 'CC' END AS license, c_custkey % 45 <> 0 AS tr, CASE WHEN c_custkey % 55 <> 0 THEN '2026-01-01' END AS fetched_at, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 31 = 0 THEN 'blocked' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 18 <> 0 THEN 'why' END AS notes FROM customer WHERE c_custkey % 25 <> 3)"""


def datasets(spark, sf):
    k = F.col("c_custkey")
    ds = table(spark, sf, "customer").select(
        k.cast("string").alias("source_id"), F.when(k % 50 != 0, "2026-01-01").alias("generated_at"), (k % 60 != 0).alias("meta_present"),
        F.when(k % 9 == 0, 0).otherwise(k % 7 + 1).alias("rows"), k.alias("k"),
    )
    pv = table(spark, sf, "customer").filter(k % 25 != 3).select(
        k.cast("string").alias("source_id"), F.when(k % 40 != 0, "CC").alias("license"), F.when(k % 45 != 0, F.array(F.lit("t"))).alias("transforms"),
        F.when(k % 55 != 0, "2026-01-01").alias("fetched_at"), F.when((k % 9 == 0) | (k % 31 == 0), "blocked").otherwise("ok").alias("status"), F.when(k % 18 != 0, "why").alias("notes"),
    )
    return ds, pv


@query(
    "findings_envelope",
    WITH(DATASETS)
    + """, j AS (SELECT ds.*, pv.source_id IS NOT NULL AS has, license, tr, fetched_at, status, notes, coalesce(status = 'blocked', false) AS blocked FROM (SELECT * FROM ds WHERE k % 29 <> 5) ds LEFT JOIN pv USING (source_id)),
f AS (SELECT 'envelope_key' AS rule, 'generated_at' AS field FROM j WHERE generated_at IS NULL UNION ALL SELECT 'envelope_key', 'meta' FROM j WHERE NOT meta_present UNION ALL SELECT 'provenance', 'source_id' FROM j WHERE NOT has
  UNION ALL SELECT 'license', 'license' FROM j WHERE has AND license IS NULL UNION ALL SELECT 'transforms', 'transforms' FROM j WHERE has AND NOT tr UNION ALL SELECT 'fetched_at', 'fetched_at' FROM j WHERE has AND fetched_at IS NULL
  UNION ALL SELECT 'blocked_notes', 'notes' FROM j WHERE blocked AND notes IS NULL UNION ALL SELECT 'blocked_empty', 'rows' FROM j WHERE blocked AND rows <> 0 UNION ALL SELECT 'ok_but_empty', 'rows' FROM j WHERE has AND NOT blocked AND rows = 0
  UNION ALL SELECT 'orphan_provenance', 'output' FROM pv WHERE source_id NOT IN (SELECT source_id FROM j))
SELECT rule, field, count(*) AS n FROM f GROUP BY ALL""",
)
def findings_envelope(spark, sf):
    ds, pv = datasets(spark, sf)
    return quality.check_envelope(ds.filter(F.col("k") % 29 != 5), pv).groupBy("rule", "field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "findings_forecasts",
    """SELECT 'forecast_institution' AS rule, c_custkey::VARCHAR AS entity FROM customer WHERE c_nationkey = 3 AND c_custkey % 5 = 0
UNION ALL SELECT 'forecast_attribution', c_custkey::VARCHAR FROM customer WHERE c_nationkey = 3 AND c_custkey % 4 = 0 AND c_custkey % 3 <> 0""",
)
def findings_forecasts(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(
        k.cast("string").alias("source_id"), F.when(F.col("c_nationkey") == 3, "institutional_forecast").otherwise("series").alias("kind"),
        F.when(k % 5 != 0, "I").alias("institution"), F.when(k % 4 != 0, "A").alias("attribution"), F.when(k % 3 == 0, "blocked").otherwise("ok").alias("status"),
    )
    return quality.check_forecasts(d).select("rule", "entity")


LEAVES = """leaf AS (SELECT p_type AS source_id, p_brand || '.' || CASE p_size % 7 WHEN 0 THEN 'median_usd_year' WHEN 1 THEN 'advertised_min' WHEN 2 THEN 'p25_senior' WHEN 3 THEN 'mean_eur' WHEN 4 THEN 'posting_count' WHEN 5 THEN 'title' ELSE 'p90_low' END AS path, p_size AS s FROM part)"""


def leaves(spark, sf):
    names = ("median_usd_year", "advertised_min", "p25_senior", "mean_eur", "posting_count", "title", "p90_low")
    name = F.get(F.array(*[F.lit(x) for x in names]), F.col("p_size") % 7)
    return table(spark, sf, "part").select(F.col("p_type").alias("source_id"), F.concat_ws(".", "p_brand", name).alias("path"), F.col("p_size").alias("s"))


@query(
    "findings_names",
    WITH(LEAVES)
    + """SELECT 'seniority_name' AS rule, path AS entity, count(*) AS n FROM leaf WHERE path LIKE '%p25_senior' GROUP BY path
UNION ALL SELECT 'survey_advertised', source_id, 1 FROM (SELECT source_id FROM leaf GROUP BY 1 HAVING bool_or(path LIKE '%advertised%' OR path LIKE '%posting%') AND bool_or(regexp_matches(path, 'median_usd|p25_|mean_eur|p90_')))
UNION ALL SELECT 'field_separation', f, 1 FROM (SELECT DISTINCT split_part(path, '.', 2) AS f FROM leaf WHERE s < 25 INTERSECT SELECT DISTINCT split_part(path, '.', 2) FROM leaf WHERE s >= 25) WHERE regexp_matches(f, 'median_usd|p25_|mean_eur|p90_')""",
)
def findings_names(spark, sf):
    d = leaves(spark, sf)
    found = quality.union(
        [quality.check_seniority_names(d), quality.check_mixed_vocabulary(d), quality.check_field_separation(d.filter("s < 25"), d.filter("s >= 25"))]
    )
    return found.groupBy("rule", "entity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "shared_fields",
    WITH(LEAVES) + "SELECT DISTINCT split_part(path, '.', 2) AS field FROM leaf WHERE s < 10 INTERSECT SELECT DISTINCT split_part(path, '.', 2) FROM leaf WHERE s >= 10",
)
def shared_fields(spark, sf):
    d = leaves(spark, sf)
    return sets.shared_fields(d.filter("s < 10"), d.filter("s >= 10"))


@query(
    "findings_absence",
    WITH(WAGE)
    + "SELECT brand AS entity FROM wage WHERE k % 4 = 0 AND k % 8 <> 0",
)
def findings_absence(spark, sf):
    k = F.col("k")
    w = wage(spark, sf)
    for c in ("p10", "p25", "p75", "p90"):
        w = w.withColumn(c, F.when(k % 4 != 0, F.col(c)))
    w = w.withColumn("label", F.when(k % 8 == 0, "mean-only").when(k % 8 == 4, "full"))
    return quality.check_absence_explicit(w, "brand", "label", FIELDS).select("entity")


@query(
    "findings_no_series",
    """SELECT 'no_series_status' AS rule, c_custkey::VARCHAR AS entity FROM customer WHERE (c_custkey % 6 = 0 OR c_custkey % 4 = 0) AND (c_custkey % 6 = 0) <> (c_custkey % 4 = 0)
UNION ALL SELECT 'no_series_evidence', c_custkey::VARCHAR FROM customer WHERE (c_custkey % 6 = 0 OR c_custkey % 4 = 0) AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""",
)
def findings_no_series(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(
        k.cast("string").alias("source_id"), F.when(k % 6 == 0, "no_series").otherwise("ok").alias("status"), F.when(k % 4 == 0, "no_series").otherwise("ok").alias("meta_status"),
        F.when(k % 5 == 0, "2020-01").alias("evidence_date"), F.when(k % 7 == 0, "not published").otherwise(" ").alias("explanation"),
    )
    return quality.check_no_series(d).select("rule", "entity")


@query(
    "findings_self_describe",
    WITH(POSTING, RATES)
    + """SELECT field, count(*) AS n FROM (SELECT unnest(['fx_rate', 'fx_source']) AS field FROM posting LEFT JOIN rates USING (country, year) WHERE rate IS NULL UNION ALL SELECT 'chain' FROM posting WHERE period = 'week') GROUP BY field""",
)
def findings_self_describe(spark, sf):
    p = lookups.exact_lookup(postings(spark, sf), rates(spark, sf), ["country", "year"], "rate")
    step = F.array(F.lit("step"))
    d = p.select("id", F.lit(True).alias("ok"), F.col("rate").alias("fx_rate"), F.col("year").alias("fx_year"), F.when(F.col("rate").isNotNull(), "w").alias("fx_source"), F.when(F.col("period") != "week", step).alias("chain"))
    return quality.check_self_describe(d, "id").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "findings_fx_year",
    WITH(POSTING, RATES) + "SELECT id::VARCHAR AS entity, (year + 1)::DOUBLE AS observed, year::DOUBLE AS bound FROM posting JOIN rates USING (country, year) WHERE status = 'P'",
)
def findings_fx_year(spark, sf):
    p = lookups.exact_lookup(postings(spark, sf), rates(spark, sf), ["country", "year"], "rate")
    named = F.when(F.col("status") == "P", F.col("year") + 1).otherwise(F.col("year"))
    p = p.withColumn("res", money.convert_at(F.col("pay"), F.col("rate"), F.col("country"), named)).filter("res.ok")
    return quality.check_fx_year(p.select("id", "year", F.col("res.chain").alias("chain")), "id", "year").select("entity", "observed", "bound")


@query(
    "findings_hours_sourced",
    WITH(POSTING, HOURS) + "SELECT country AS entity, count(*) AS n FROM posting WHERE period = 'hour' AND status <> 'F' AND country NOT IN (SELECT country FROM hours) GROUP BY country",
)
def findings_hours_sourced(spark, sf):
    p = postings(spark, sf).select("country", "period", F.when(F.col("status") == "F", 37.5).alias("own_hours"))
    return quality.check_hours_sourced(p, hours(spark, sf), "country").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "findings_chain",
    WITH(POSTING, HOURS, ANNUAL) + "SELECT id::VARCHAR AS entity, round(yearly * 1.1::DOUBLE, 6) AS observed FROM annual WHERE yearly IS NOT NULL AND status = 'P'",
)
def findings_chain(spark, sf):
    a = annual(spark, sf).filter("res.ok")
    value = F.when(F.col("status") == "P", F.col("res.value") * 1.1).otherwise(F.col("res.value"))
    d = a.select("id", F.col("pay").alias("start"), value.alias("value"), F.col("res.chain").alias("chain"))
    return quality.recompute_chain(d, "id").select("entity", r("observed", 6).alias("observed"))


RECON = """live AS (SELECT l_suppkey AS code, l_returnflag AS field, round(avg(l_quantity), 6) AS value FROM lineitem WHERE l_linenumber <> 1 AND l_suppkey % 13 <> 0 GROUP BY ALL),
stored AS (SELECT l_suppkey AS code, l_returnflag AS field, round(avg(l_quantity), 6) AS value FROM lineitem WHERE l_suppkey % 17 <> 0 GROUP BY ALL)"""


@query(
    "findings_reconcile",
    WITH(RECON)
    + """SELECT CASE WHEN s.value IS NULL THEN 'live_only' WHEN l.value IS NULL THEN 'stored_only' ELSE 'mismatch' END AS detail, concat_ws(':', coalesce(l.code, s.code), coalesce(l.field, s.field)) AS entity, l.value AS observed, s.value AS bound
FROM live l FULL JOIN stored s ON l.code = s.code AND l.field = s.field WHERE l.value IS NULL OR s.value IS NULL OR NOT abs(l.value - s.value) <= abs(s.value) * 0.005""",
)
def findings_reconcile(spark, sf):
    li = table(spark, sf, "lineitem")
    mean = lambda d: d.groupBy(F.col("l_suppkey").alias("code"), F.col("l_returnflag").alias("field")).agg(r(F.avg("l_quantity"), 6).alias("value"))
    live = mean(li.filter((F.col("l_linenumber") != 1) & (F.col("l_suppkey") % 13 != 0)))
    stored = mean(li.filter(F.col("l_suppkey") % 17 != 0))
    return quality.check_reconcile(live, stored, ["code", "field"]).select("detail", "entity", "observed", "bound")


SNAP = """snap AS (SELECT y, scope, k, count(*) AS rows, count(*) FILTER (status = 'F') AS stated_pay FROM (SELECT year AS y, status, unnest(['overall', 'provider', 'country', 'source']) AS scope,
  unnest(['all', provider, country, CASE WHEN segment < 'F' THEN 'postings_' ELSE 'series_' END || segment]) AS k FROM posting) GROUP BY ALL)"""


@query(
    "findings_drift",
    WITH(POSTING, SNAP)
    + """, j AS (SELECT c.scope, c.k, c.rows, c.stated_pay, p.rows AS prow, p.stated_pay AS ppay, 100 * (c.rows - p.rows) / p.rows::DOUBLE AS ch, 100 * (c.stated_pay / c.rows - p.stated_pay / p.rows) / (p.stated_pay / p.rows)::DOUBLE AS rc
  FROM (SELECT * FROM snap WHERE y = 2001) c LEFT JOIN (SELECT * FROM snap WHERE y = 2000) p ON p.scope = c.scope AND p.k = c.k)
SELECT scope || ':' || k AS entity, 'drop' AS field, CASE WHEN scope = 'country' AND prow < 20 THEN 'flag' ELSE 'drop' END AS severity, round(ch, 4) AS observed FROM j WHERE scope <> 'overall' AND ch < -15
UNION ALL SELECT scope || ':' || k, 'growth', 'flag', round(ch, 4) FROM j WHERE scope = 'source' AND NOT starts_with(k, 'postings') AND ch > 50
UNION ALL SELECT scope || ':' || k, 'pay_rate', CASE WHEN rc < 0 THEN 'drop' ELSE 'flag' END, round(rc, 4) FROM j WHERE scope = 'overall' AND abs(rc) > 15""",
)
def findings_drift(spark, sf):
    p = postings(spark, sf)

    def snap(year):
        d = p.filter(F.col("year") == year)
        paid = F.col("status") == "F"
        src = F.concat(F.when(F.col("segment") < "F", "postings_").otherwise("series_"), "segment")
        by_source = d.groupBy(src.alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(paid).alias("stated_pay")).withColumn("scope", F.lit("source"))
        return quality.snapshot(d, "provider", "country", paid).unionByName(by_source)

    return quality.drift(snap(2001), snap(2000)).select("entity", "field", "severity", r("observed").alias("observed"))


@query("run_snapshot", WITH(POSTING, SNAP) + "SELECT scope, k AS key, sum(rows)::BIGINT AS rows, sum(stated_pay)::BIGINT AS stated_pay FROM snap WHERE scope <> 'source' GROUP BY ALL")
def run_snapshot(spark, sf):
    return quality.snapshot(postings(spark, sf), "provider", "country", F.col("status") == "F")


@query(
    "overall_status",
    WITH(WAGE)
    + """, x AS (SELECT count(*) FILTER (mean < p10 OR mean > p90) AS a FROM wage) SELECT a AS errors, 0::BIGINT AS flags, 1::BIGINT AS unrun, 'FAILING' AS status FROM x""",
)
def overall_status(spark, sf):
    found = quality.check_mean_in_range(wage(spark, sf), "brand", "mean", "p10", "p90")
    expected = spark.createDataFrame([("mean_in_range", True), ("refresh", False)], "rule string, ran boolean")
    return quality.overall_status(found, expected)


@query(
    "findings_registry",
    WITH(MAPPINGS)
    + """, m AS (SELECT country, code::VARCHAR AS national_code, shared_key, CASE WHEN code % 10 = 0 THEN 'guess' WHEN shared_key = 'unmapped' THEN 'no-isco-correspondence' WHEN length(shared_key) = 8 THEN 'major-group-only' WHEN length(shared_key) = 9 THEN '2-digit-only' ELSE 'high' END AS confidence, code FROM mapping)
SELECT rule, count(*) AS n FROM (SELECT 'known_confidence' AS rule FROM m WHERE confidence = 'guess' UNION ALL SELECT 'unmapped_confidence' FROM m WHERE confidence = 'guess' AND shared_key = 'unmapped' UNION ALL SELECT 'depth_confidence' FROM m WHERE confidence = 'guess' AND shared_key <> 'unmapped'
  UNION ALL SELECT 'note_is_evidence' FROM m WHERE code % 11 = 0 UNION ALL SELECT 'registered_key' FROM m WHERE shared_key <> 'unmapped' AND length(shared_key) = 8 UNION ALL SELECT 'live_title' FROM m WHERE code % 12 = 0 AND code % 13 <> 0 UNION ALL SELECT 'live_code' FROM m WHERE code % 13 = 0) GROUP BY rule""",
)
def findings_registry(spark, sf):
    k = F.col("code")
    depth = crosswalk.depth_of(F.col("shared_key"))
    m = mappings(spark, sf).select(
        "country", k.cast("string").alias("national_code"), "shared_key", F.lit("s").alias("source_id"), F.concat(F.lit("Title "), k.cast("string")).alias("national_title"),
        F.when(k % 10 == 0, "guess").when(depth.isNull(), "no-isco-correspondence").when(depth == 1, "major-group-only").when(depth == 2, "2-digit-only").otherwise("high").alias("confidence"),
        F.when(k % 11 == 0, "short").otherwise("The national text describes the same duties word for word.").alias("note"), k.alias("k"),
    )
    registry = m.filter(F.length("shared_key") != 8).select("shared_key").distinct()
    title = F.when(F.col("k") % 12 == 0, "Other").otherwise(F.col("national_title"))
    live = m.filter(F.col("k") % 13 != 0).select("source_id", "national_code", title.alias("title"))
    return crosswalk.registry_findings(m, registry, live).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "findings_notes",
    """SELECT rule, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'few_characters' WHEN 2 THEN 'placeholder' END AS rule FROM part) WHERE rule IS NOT NULL GROUP BY rule""",
)
def findings_notes(spark, sf):
    s = F.col("p_size") % 5
    note = (
        F.when(s == 0, F.col("p_name")).when(s == 1, F.repeat(F.lit("ab "), 20)).when(s == 2, F.concat(F.lit("TODO describe why the unit matches the duties of "), "p_name"))
        .otherwise(F.concat(F.lit("The unit covers the same duties as described for "), "p_name"))
    )
    m = table(spark, sf, "part").select(F.col("p_brand").alias("country"), F.col("p_partkey").cast("string").alias("national_code"), note.alias("note"))
    return crosswalk.note_findings(m).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "coverage_matrix",
    WITH(POSTING)
    + """, w AS (SELECT n_name AS entity, n_nationkey % 4 <> 0 AS comparable, (n_nationkey % 3 + 1)::INTEGER AS depth, n_nationkey % 5 <> 0 AS okr, n_nationkey % 2 = 0 AS okt, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS experience FROM nation),
p AS (SELECT country AS entity, count(*) AS postings, count(*) FILTER (status = 'F') AS paid FROM posting GROUP BY 1)
SELECT entity, comparable, depth, CASE WHEN comparable THEN okr END AS ok_regular_pay, CASE WHEN comparable THEN okt END AS ok_total_earnings, experience, coalesce(postings, 0) AS postings, round(100 * paid / postings, 1) AS stated_pay_pct FROM w LEFT JOIN p USING (entity)""",
)
def coverage_matrix(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    k = F.col("n_nationkey")
    base = n.select(F.col("n_name").alias("entity"), (k % 4 != 0).alias("comparable"), (k % 3 + 1).cast("int").alias("depth"), k.alias("k"))
    w = base.withColumn("basis", F.explode(F.array(F.lit("regular_pay"), F.lit("total_earnings"))))
    w = w.withColumn("ok", F.when(F.col("basis") == "regular_pay", F.col("k") % 5 != 0).otherwise(F.col("k") % 2 == 0)).drop("k")
    exp = s.filter("s_acctbal > 9000").join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("entity"))
    p = postings(spark, sf).select(F.col("country").alias("entity"), (F.col("status") == "F").alias("paid"))
    return core.coverage_matrix(w, exp, p, "entity")


@query(
    "coverage",
    WITH(POSTING)
    + """, n AS (SELECT n_name AS entity, n_nationkey AS k FROM nation), w AS (SELECT country AS entity, any_value(CASE WHEN hash > 0 THEN 1 END) AS x, count(DISTINCT year) AS n_points FROM (SELECT *, 1 AS hash FROM posting) GROUP BY 1),
j AS (SELECT n.entity, k, k % 6 <> 1 AS has, k % 4 <> 0 AS comparable, CASE WHEN k % 5 = 2 THEN 1 ELSE n_points END AS pts, k % 3 = 0 AS curve FROM n LEFT JOIN w USING (entity))
SELECT entity, has AND comparable AS occupation_ok, has AND pts >= 2 AS spread_ok, has AND comparable AND pts >= 2 AS works, has AND comparable AND pts >= 2 AND curve AS personalised,
  CASE WHEN NOT has THEN CASE WHEN k = 1 THEN 'no office' ELSE 'no wage source at all' END WHEN NOT comparable THEN 'no correspondence' WHEN pts < 2 THEN 'no spread to rank within' END AS reason FROM j""",
)
def coverage(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.col("n_nationkey").alias("k"))
    k = F.col("k")
    pts = postings(spark, sf).groupBy(F.col("country").alias("entity")).agg(F.count_distinct("year").alias("pts"))
    w = n.join(pts, "entity", "left").filter(k % 6 != 1).select(
        "entity", (k % 4 != 0).alias("comparable"), F.when(k % 4 == 0, "no correspondence").alias("reason"), F.when(k % 5 == 2, 1).otherwise(F.col("pts")).alias("n_points")
    )
    return core.coverage(n, w, n.filter(k % 3 == 0), n.filter("k = 1").select("entity", F.lit("no office").alias("reason")), "entity")


@query(
    "props_json",
    """SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events""",
)
def props_json(spark, sf):
    return quality.flatten_leaves(table(spark, sf, "events"), ["event_id"], "props")


@query(
    "conversation_leaves",
    """SELECT conv_id, path, count(*) AS n FROM (SELECT conv_id, unnest(['turns[].role', 'turns[].chars']) AS path FROM conversations UNION ALL SELECT DISTINCT conv_id, 'n' FROM conversations) GROUP BY ALL""",
)
def conversation_leaves(spark, sf):
    c = table(spark, sf, "conversations")
    doc = c.groupBy("conv_id").agg(
        F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("role", F.length("text").alias("chars"))).alias("turns"))).alias("doc")  # turns of one conversation
    )
    return quality.flatten_leaves(doc, ["conv_id"], "doc").groupBy("conv_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "profile_all",
    """SELECT 'k' AS path, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM (SELECT json_extract(props, '$.k')::DOUBLE AS v FROM events)""",
)
def profile_all(spark, sf):
    from paylens.plans.audit import profile_documents

    p = profile_documents(table(spark, sf, "events"), ["event_id"], "props")
    return p.select("path", "n", "min", "max", r("mean").alias("mean"), r("median").alias("median"))


@query(
    "profile_categories",
    """WITH l AS (SELECT unnest(['role', 'size']) AS path, unnest([role, CASE WHEN length(text) > 60 THEN 'long' ELSE 'short' END]) AS value FROM conversations), c AS (SELECT path, value, count(*) AS k FROM l GROUP BY ALL),
n AS (SELECT path, sum(k) AS n FROM c GROUP BY path)
SELECT path, any_value(n)::BIGINT AS n, 0::BIGINT AS missing, count(*) AS cardinality, (max({'k': k, 'v': value})).v AS mode, round(100 * max(k) / any_value(n), 4) AS mode_share_pct, count(*) FILTER (k = 1) AS singletons, count(*) FILTER (k < 0.01 * n) AS rare
FROM c JOIN n USING (path) GROUP BY path""",
)
def profile_categories(spark, sf):
    from paylens.plans.audit import profile_categories as profile

    size = F.when(F.length("text") > 60, "long").otherwise("short")
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", size.alias("size"))).alias("doc"))
    return profile(d, ["conv_id", "turn"], "doc").withColumn("mode_share_pct", r("mode_share_pct"))


def audit_evidence(spark, sf):
    """Two prices of a line from order and customer, monthly sums, homes from parts, measures of lines and what they are made of."""
    from paylens.plans.audit import Evidence

    p, li = postings(spark, sf), table(spark, sf, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("y"))
    pairs = p.join(per_order, p["id"] == per_order["l_orderkey"]).select(F.col("provider").alias("group"), F.col("pay").alias("x"), "y")
    monthly = p.groupBy(F.col("segment").alias("entity"), F.substring("posted_at", 1, 7).alias("t")).agg(F.round(F.sum("pay"), 2).alias("value"))
    homes = table(spark, sf, "part").select(F.col("p_brand").alias("group"), F.col("p_size").alias("rent"), F.col("p_retailprice").alias("price"))
    price, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    derived = li.select(price.alias("price"), F.col("l_quantity").alias("quantity"), net.alias("net"))
    expected = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return Evidence(
        pairs=pairs, monthly=monthly, homes=homes, features=li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_tax") + 1).alias("taxed")),
        columns=["l_quantity", "l_extendedprice", "taxed"], ids=["l_orderkey", "l_linenumber"], derived=derived, graph={"net": ["price", "quantity"]}, expected=expected,
    )


@query("statistical_audit")
def statistical_audit(spark, sf):
    from paylens.plans.audit import statistical_audit as audit

    p = postings(spark, sf).withColumn("title", F.concat_ws(" ", "segment", "status"))
    return audit(p, series=nation_years(spark, sf), more=audit_evidence(spark, sf))


@query(
    "audit_counts",
    WITH(POSTING, YEARLY)
    + """SELECT 'keyword_census' AS finding, 'all' AS key, 'has_building' AS measure, count(*) FILTER (segment = 'BUILDING')::DOUBLE AS value FROM posting UNION ALL SELECT 'keyword_census', 'all', 'n', count(*) FROM posting
UNION ALL SELECT 'growth', entity, 'growth_pct', round(100 * (pow(max_by(value, year) / min_by(value, year), 1.0::DOUBLE / (max(year) - min(year))) - 1), 4) FROM yearly GROUP BY entity HAVING max(year) > min(year)
UNION ALL SELECT 'missingness', provider || '.pay', 'missing', count(*) FILTER (pay IS NULL) FROM posting GROUP BY provider""",
)
def audit_counts(spark, sf):
    """The audit's own rows for the findings that are plain counts and growth."""
    from paylens.plans.audit import statistical_audit as audit

    p = postings(spark, sf).withColumn("title", F.concat_ws(" ", "segment", "status"))
    out = audit(p, series=nation_years(spark, sf))
    picked = "(finding = 'keyword_census' AND measure IN ('n', 'has_building')) OR (finding = 'growth' AND measure = 'growth_pct' AND value IS NOT NULL) OR (finding = 'missingness' AND key LIKE '%.pay' AND measure = 'missing')"
    return out.filter(picked).select("finding", "key", "measure", r("value").alias("value"))


@query(
    "agreement_votes",
    """SELECT votes::INTEGER AS votes, votes = 3 AS by_all, votes > 0 AS by_any, count(*) AS n FROM (SELECT (l_quantity > 45)::INTEGER + (l_discount > 0.08)::INTEGER + (l_tax > 0.06)::INTEGER AS votes FROM lineitem) GROUP BY ALL""",
)
def agreement_votes(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_quantity") > 45).alias("a"), (F.col("l_discount") > 0.08).alias("b"), (F.col("l_tax") > 0.06).alias("c"))
    return sets.agreement(d, ["a", "b", "c"]).groupBy("votes", "by_all", "by_any").agg(F.count(F.lit(1)).alias("n"))


