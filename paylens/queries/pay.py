"""Pay conversion, basis, crosswalk and postings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens.functions import money
from paylens.operators import crosswalk, lookups, quality
from paylens.operators.quantiles import group_quantiles
from paylens.plans import postings as plan
from paylens.plans import wages
from paylens.queries.common import HOURS, POSTING, RATES, WITH, hours, postings, r, rates, table
from paylens.queries.registry import query


def rated(spark, sf):
    """Postings with the rate of their own country and year, null where there is none."""
    return lookups.exact_lookup(postings(spark, sf), rates(spark, sf), ["country", "year"], "rate")


@query(
    "pay_summary_by_country",
    WITH(POSTING, RATES)
    + """SELECT country, count(*) AS n, round(median((min / rate + max / rate) / 2), 2) AS median
FROM posting JOIN rates USING (country, year) WHERE period = 'year'
GROUP BY country HAVING count(*) >= 5 ORDER BY median DESC, country LIMIT 12""",
)
def pay_summary_by_country(spark, sf):
    df = rated(spark, sf).filter((F.col("period") == "year") & F.col("rate").isNotNull())
    df = df.select("country", ((money.at_rate(F.col("min"), F.col("rate")) + money.at_rate(F.col("max"), F.col("rate"))) / 2).alias("mid"))
    return plan.pay_summary(df, "country", "mid")


@query(
    "fx_refusals",
    WITH(POSTING, RATES)
    + """SELECT rate IS NOT NULL AS ok, CASE WHEN rate IS NULL THEN 'no rate for ' || country || ' in ' || year END AS reason,
  count(*) AS n, round(sum(pay / rate), 0) AS usd
FROM posting LEFT JOIN rates USING (country, year) GROUP BY ALL""",
)
def fx_refusals(spark, sf):
    reason = money.rate_refusal(F.col("rate"), F.col("country"), F.col("year"))
    df = rated(spark, sf).select(reason.alias("reason"), reason.isNull().alias("ok"), money.at_rate(F.col("pay"), F.col("rate")).alias("value"))
    return df.groupBy("ok", "reason").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 0).alias("usd"))


ANNUAL = """annual AS (
  SELECT p.*, coalesce(e.hours, l.hours) AS weekly, CASE WHEN e.hours IS NOT NULL THEN p.year ELSE l.year END AS hours_year,
    CASE period WHEN 'year' THEN pay WHEN 'month' THEN pay * 12 WHEN 'hour' THEN pay * coalesce(e.hours, l.hours) * 52 END AS yearly,
    CASE WHEN period = 'hour' AND coalesce(e.hours, l.hours) IS NULL THEN 'no sourced weekly hours for ' || p.country
      WHEN period = 'week' THEN 'unknown period week' END AS reason
  FROM posting p LEFT JOIN hours e ON e.country = p.country AND e.year = p.year
  LEFT JOIN (SELECT country, arg_max(hours, year) AS hours, max(year) AS year FROM hours GROUP BY country) l ON l.country = p.country)"""


def weekly_hours(spark, sf):
    """Postings with the hours of their country and year, else its latest."""
    return lookups.year_or_latest(postings(spark, sf), hours(spark, sf), "country", "year", "hours", "hours_year")


def annual(spark, sf):
    return weekly_hours(spark, sf).withColumn("res", money.annualise(F.col("pay"), F.col("period"), F.col("hours"), F.col("country")))


@query(
    "annualise_by_period",
    WITH(POSTING, HOURS, ANNUAL)
    + """SELECT period, reason, hours_year, count(*) AS n, round(avg(yearly), 2) AS mean_year
FROM annual GROUP BY ALL""",
)
def annualise_by_period(spark, sf):
    df = weekly_hours(spark, sf).select(
        "period", "hours_year", money.period_refusal(F.col("period"), F.col("hours"), F.col("country")).alias("reason"), money.yearly_value(F.col("pay"), F.col("period"), F.col("hours")).alias("value")
    )
    return df.groupBy("period", "reason", "hours_year").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 2).alias("mean_year"))


@query(
    "conversion_chain",
    WITH(POSTING, HOURS, ANNUAL)
    + """SELECT id, CASE period WHEN 'year' THEN 'identity: already annual'
  WHEN 'month' THEN 'monthly_to_annual: ' || printf('%.2f', pay) || ' x 12'
  WHEN 'hour' THEN CASE WHEN weekly IS NULL THEN '' ELSE 'hourly_to_weekly: ' || printf('%.2f', pay) || ' x '
    || printf('%.2f', weekly) || ' hours/week; weekly_to_annual: x 52 weeks/year' END ELSE '' END AS chain
FROM annual""",
)
def conversion_chain(spark, sf):
    steps = F.transform("res.chain", lambda s: F.concat(s["op"], F.lit(": "), s["detail"]))
    return annual(spark, sf).select("id", F.concat_ws("; ", steps).alias("chain"))


@query(
    "hours_override",
    WITH(POSTING, HOURS, ANNUAL)
    + """SELECT given, weekly2 IS NULL AS refused, count(*) AS n, round(avg(pay * weekly2 * 52), 2) AS mean_year FROM (
  SELECT *, provider = '1-URGENT' AS given,
    CASE WHEN provider = '1-URGENT' THEN CASE WHEN status = 'F' THEN 37.5::DOUBLE END ELSE weekly END AS weekly2 FROM annual)
GROUP BY ALL""",
)
def hours_override(spark, sf):
    df = weekly_hours(spark, sf).withColumn("given", F.col("provider") == "1-URGENT")
    own = F.when(F.col("status") != "P", F.lit(37.5))
    source = F.when(F.col("status") == "F", F.lit("matched cell"))
    df = df.withColumn("weekly", money.override_hours(own, source, F.col("given"), F.col("hours")))
    hour = F.lit("hour")
    df = df.select("given", money.period_refusal(hour, F.col("weekly"), F.col("country")).isNotNull().alias("refused"), money.yearly_value(F.col("pay"), hour, F.col("weekly")).alias("value"))
    return df.groupBy("given", "refused").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 2).alias("mean_year"))


COMPOSITION = """composition AS (
  SELECT s_suppkey AS key, CASE s_suppkey % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'unknown' ELSE 'true (annual)' END AS bonus,
    CASE s_suppkey % 3 WHEN 0 THEN 'true' ELSE 'false' END AS contrib,
    CASE WHEN s_suppkey % 5 = 0 THEN 'salary_uk' WHEN s_suppkey % 7 = 0 THEN 'bls_oews' ELSE 'source' END AS source_id FROM supplier),
based AS (
  SELECT key, contrib = 'false' AND (bonus = 'false' OR source_id = 'bls_oews') AS regular,
    contrib = 'false' AND (bonus = 'true' OR source_id = 'salary_uk') AS total FROM composition)"""


def composition(spark, sf):
    k = F.col("s_suppkey")
    df = table(spark, sf, "supplier").select(
        k.alias("key"),
        F.when(k % 4 == 0, "false").when(k % 4 == 1, "true").when(k % 4 == 2, "unknown").otherwise("true (annual)").alias("bonus"),
        F.when(k % 3 == 0, "true").otherwise("false").alias("contrib"),
        F.when(k % 5 == 0, "salary_uk").when(k % 7 == 0, "bls_oews").otherwise("source").alias("source_id"),
    )
    return df.withColumn("bases", money.bases(F.col("source_id"), F.col("bonus"), F.col("contrib")))


@query(
    "basis_matrix",
    WITH(COMPOSITION)
    + """, pairs AS (SELECT min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY l_partkey)
SELECT concat_ws(',', CASE WHEN x.regular AND y.regular THEN 'regular_pay' END, CASE WHEN x.total AND y.total THEN 'total_earnings' END) AS common,
  (x.regular AND y.regular) OR (x.total AND y.total) AS comparable, count(*) AS n
FROM pairs JOIN based x ON x.key = a JOIN based y ON y.key = b GROUP BY ALL""",
)
def basis_matrix(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    comp = composition(spark, sf)
    x = comp.select(F.col("key").alias("a"), F.col("bases").alias("xb"))
    y = comp.select(F.col("key").alias("b"), F.col("bases").alias("yb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("shared", money.shared_bases(F.col("xb"), F.col("yb")))
    return both.groupBy(F.array_join("shared", ",").alias("common"), (F.size("shared") > 0).alias("comparable")).agg(
        F.count(F.lit(1)).alias("n")
    )


MAPPINGS = """mapping AS (
  SELECT p_partkey AS code, p_brand AS country, p_type AS kind, CASE p_size % 4 WHEN 0 THEN 'unmapped'
    WHEN 1 THEN 'isco08:' || (1 + p_partkey % 9) WHEN 2 THEN 'isco08:' || (10 + p_partkey % 90)
    ELSE 'isco08:' || (1000 + p_partkey * 7 % 9000) END AS shared_key FROM part)"""


def mappings(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    code = (
        F.when(s % 4 == 1, (1 + k % 9).cast("string"))
        .when(s % 4 == 2, (10 + k % 90).cast("string"))
        .when(s % 4 == 3, (1000 + k * 7 % 9000).cast("string"))
    )
    return table(spark, sf, "part").select(
        k.alias("code"),
        F.col("p_brand").alias("country"),
        F.col("p_type").alias("kind"),
        F.coalesce(F.concat(F.lit("isco08:"), code), F.lit("unmapped")).alias("shared_key"),
    )


@query(
    "crosswalk_pairs",
    WITH(MAPPINGS)
    + """, d AS (SELECT code, substr(shared_key, 8) AS c FROM mapping WHERE shared_key <> 'unmapped')
SELECT CAST(least(length(a.c), length(b.c)) AS INTEGER) AS depth, CAST(greatest(length(a.c), length(b.c)) AS INTEGER) AS deeper_side, count(*) AS pairs
FROM d a JOIN d b ON a.code < b.code AND left(a.c, least(length(a.c), length(b.c))) = left(b.c, least(length(a.c), length(b.c)))
GROUP BY ALL""",
)
def crosswalk_pairs(spark, sf):
    return crosswalk.comparable_pair_counts(mappings(spark, sf), "shared_key")


@query(
    "crosswalk_compare",
    WITH(MAPPINGS)
    + """, c AS (SELECT m.*, CASE WHEN shared_key = 'unmapped' THEN NULL ELSE substr(shared_key, 8) END AS own FROM mapping m),
e AS (SELECT country, code, own, least(length(own), 4) AS d FROM c)
SELECT country, code, coalesce(left(own, d) = left('2512', d), false) AS comparable,
  CASE WHEN left(own, d) = left('2512', d) THEN CAST(d AS INTEGER) END AS depth,
  CASE WHEN left(own, d) = left('2512', d) THEN 'isco08:' || left(own, d) END AS shared_key,
  CASE WHEN left(own, d) = left('2512', d) AND d < 4 THEN country || ' forces 4 digits down to ' || d END AS degraded_by,
  CASE WHEN own IS NULL THEN country || ' has no correspondence' WHEN left(own, d) <> left('2512', d) THEN 'codes differ at ' || d || ' digits' END AS reason
FROM e""",
)
def crosswalk_compare(spark, sf):
    df = mappings(spark, sf)
    v = crosswalk.compare(F.lit("isco08:2512"), F.col("shared_key"), F.lit("reference"), F.col("country"))
    return df.select("country", "code", v.alias("v")).select("country", "code", "v.*")


@query(
    "resolve_set",
    WITH(MAPPINGS)
    + """, d AS (SELECT *, CASE WHEN shared_key <> 'unmapped' THEN length(shared_key) - 7 END AS own FROM mapping),
k AS (SELECT kind, own, count(DISTINCT country) AS bases FROM d WHERE own IS NOT NULL GROUP BY ALL),
s AS (SELECT kind, max(own) AS res FROM k WHERE bases >= 2 GROUP BY kind)
SELECT kind, country, code, CAST(own AS INTEGER) AS own_depth, CAST(res AS INTEGER) AS resolved_depth, coalesce(own = res, false) AS comparable,
  CASE WHEN own IS NULL THEN 'no correspondence' WHEN res IS NULL THEN 'fewer than 2 share depth ' || own
    WHEN own < res THEN 'reaches only ' || own || ' of ' || res || ' digits'
    WHEN own > res THEN 'scoped to ' || own || ' digits, the set shares ' || res END AS reason
FROM d LEFT JOIN s USING (kind)""",
)
def resolve_set(spark, sf):
    df = mappings(spark, sf).withColumn("own_depth", crosswalk.depth_of(F.col("shared_key")))
    out = crosswalk.resolve_set(df, ["kind"], "code", "country", "own_depth")
    return out.select("kind", "country", "code", "own_depth", "resolved_depth", "comparable", "reason")


@query(
    "crosswalk_join",
    WITH(MAPPINGS)
    + """SELECT country, CASE WHEN shared_key IS NULL THEN 'no mapping' WHEN shared_key = 'unmapped' THEN 'no correspondence' END AS reason,
  count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem LEFT JOIN mapping ON code = l_partkey + 7 GROUP BY ALL""",
)
def crosswalk_join(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_partkey") + 7).alias("code"), "l_quantity")
    xw = mappings(spark, sf)
    out = lookups.crosswalk_join(li.join(xw.select("code", "country"), "code", "left"), xw, ["code"], "shared_key")
    return out.groupBy("country", "reason").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))


OBS = """obs AS (
  SELECT country, segment AS source_id, year, avg(pay) AS mean, quantile_cont(pay, 0.5) AS median, quantile_cont(pay, 0.1) AS p10,
    quantile_cont(pay, 0.25) AS p25, quantile_cont(pay, 0.75) AS p75, quantile_cont(pay, 0.9) AS p90 FROM posting GROUP BY ALL),
basis AS (
  SELECT o.*, CASE WHEN source_id = 'AUTOMOBILE' THEN ['regular_pay'] WHEN source_id = 'BUILDING' THEN ['total_earnings'] ELSE [] END AS expressible,
    CASE WHEN source_id = 'FURNITURE' THEN floor(mean * 0.05::DOUBLE) END AS pension, CASE WHEN source_id = 'FURNITURE' THEN floor(mean * 0.02::DOUBLE) END AS bonus FROM obs o)"""


def observations(spark, sf):
    """One wage observation per (nation, segment, year): the segments play five sources of unlike composition."""
    p = postings(spark, sf)
    keys = ["country", "segment", "year"]
    probs = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    q = group_quantiles(p, keys, "pay", probs)  # nations x segments x years
    obs = q.join(p.groupBy(*keys).agg(F.avg("pay").alias("mean")), keys).withColumnRenamed("segment", "source_id")
    s = F.col("source_id")
    bonus = F.when(s == "AUTOMOBILE", "false").when(s == "BUILDING", "true").otherwise("unknown")
    own = s == "FURNITURE"
    split_type = "struct<" + ",".join(f"{f}:double" for f in wages.FIELDS) + ">"
    split = F.struct(*[(F.col(f) * F.lit(1.0)).alias(f) for f in wages.FIELDS])
    return obs.withColumns(
        {
            "expressible": money.bases(s, bonus, F.lit("false")),
            "published": F.when(own, F.array(F.lit("employer_social_contributions_rate"), F.lit("irregular_bonus"))),
            "part_employer_social_contributions": F.when(own, F.floor(F.col("mean") * F.lit(0.05)).cast("double")),
            "part_irregular_bonus": F.when(own, F.floor(F.col("mean") * F.lit(0.02)).cast("double")),
            "split_total_earnings": F.when(s == "HOUSEHOLD", split),
            "split_regular_pay": F.when(s == "HOUSEHOLD", split).cast(split_type),
        }
    )


FIGURE_SQL = """CASE WHEN source_id = 'HOUSEHOLD' OR list_contains(expressible, b.basis) THEN {f}
    WHEN source_id = 'FURNITURE' AND b.basis = 'total_earnings' THEN {f} - (0.0::DOUBLE + pension)
    WHEN source_id = 'FURNITURE' THEN {f} - (0.0::DOUBLE + pension + bonus) END"""


@query(
    "figures_by_basis",
    WITH(POSTING, OBS)
    + f"""SELECT country, source_id, year, b.basis, round({FIGURE_SQL.format(f="median")}, 5) AS median, round({FIGURE_SQL.format(f="p90")}, 5) AS p90,
  CASE WHEN source_id = 'HOUSEHOLD' THEN 'native_basis_select' WHEN list_contains(expressible, b.basis) THEN 'native'
    WHEN source_id = 'FURNITURE' THEN 'subtract' END AS how,
  CASE WHEN source_id = 'MACHINERY' OR (source_id IN ('AUTOMOBILE', 'BUILDING') AND NOT list_contains(expressible, b.basis))
    THEN 'source cannot express ' || b.basis END AS reason
FROM basis, (VALUES ('regular_pay'), ('total_earnings')) b(basis)""",
)
def figures_by_basis(spark, sf):
    df = observations(spark, sf)
    for b in wages.BASES:
        df = wages.figure_for_basis(df, b, f"f_{b}")
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("basis"), F.col(f"f_{b}").alias("f")) for b in wages.BASES])).alias("x")
    return df.select("country", "source_id", "year", rows).select(
        "country", "source_id", "year", "x.basis",
        r(F.col("x.f.median"), 5).alias("median"), r(F.col("x.f.p90"), 5).alias("p90"),
        F.get(F.col("x.f.chain"), F.lit(0))["op"].alias("how"), F.col("x.f.reason").alias("reason"),
    )


@query(
    "resolve_entity",
    WITH(POSTING, RATES, HOURS, OBS)
    + f""", f AS (
  SELECT x.country, source_id, x.year, b.basis, CASE source_id WHEN 'FURNITURE' THEN 'hour' WHEN 'BUILDING' THEN 'month' ELSE 'year' END AS period,
    {FIGURE_SQL.format(f="median")} AS median, coalesce(e.hours, l.hours) AS hours, rate
  FROM basis x CROSS JOIN (VALUES ('regular_pay'), ('total_earnings')) b(basis) LEFT JOIN rates q ON q.country = x.country AND q.year = x.year
  LEFT JOIN hours e ON e.country = x.country AND e.year = x.year
  LEFT JOIN (SELECT country, arg_max(hours, year) AS hours FROM hours GROUP BY country) l ON l.country = x.country),
y AS (SELECT *, CASE period WHEN 'year' THEN median WHEN 'month' THEN median * 12 ELSE median * hours * 52 END AS yearly FROM f)
SELECT country, source_id, year, mode, basis, CASE mode WHEN 'usd' THEN 'USD' ELSE left(country, 3) END AS currency,
  round(CASE mode WHEN 'usd' THEN yearly / rate ELSE yearly END, 5) AS median,
  CASE WHEN median IS NULL THEN 'source cannot express ' || basis WHEN yearly IS NULL THEN 'no sourced weekly hours for ' || country
    WHEN mode = 'usd' AND rate IS NULL THEN 'no rate for ' || country || ' in ' || year END AS reason
FROM y, (VALUES ('native'), ('usd')) m(mode)""",
)
def resolve_entity(spark, sf):
    df = observations(spark, sf)
    s = F.col("source_id")
    df = df.withColumn("period", F.when(s == "FURNITURE", "hour").when(s == "BUILDING", "month").otherwise("year"))
    df = df.withColumn("currency", F.substring("country", 1, 3))
    df = lookups.exact_lookup(df, rates(spark, sf), ["country", "year"], "rate")
    df = lookups.year_or_latest(df, hours(spark, sf), "country", "year", "hours", "hours_year")
    out = wages.resolve(df)
    return out.select("country", "source_id", "year", "mode", "basis", "currency", r("median", 5).alias("median"), "reason")


@query(
    "postings_merge",
    WITH(POSTING, RATES)
    + """, m AS (SELECT p.*, CAST(left(coalesce(CASE WHEN status <> 'P' THEN posted_at END, '2000-06-30'), 4) AS INTEGER) AS y FROM posting p)
SELECT provider, count(*) AS rows, count(*) FILTER (pay >= 10000) AS with_pay, count(*) FILTER (pay >= 10000 AND rate IS NOT NULL) AS converted,
  round(sum(CASE WHEN pay >= 10000 THEN (min / rate + max / rate) / 2 END), 0) AS usd
FROM m JOIN nation a ON a.n_name = country JOIN nation b ON b.n_nationkey = a.n_nationkey % {k} LEFT JOIN rates r ON r.country = b.n_name AND r.year = m.y GROUP BY provider""".replace("{k}", str(len(money.CURRENCY_COUNTRY))),
)
def postings_merge(spark, sf):
    """Three sources, told apart by their numbers; every nation borrows a currency, in turn."""
    names = list(money.CURRENCY_COUNTRY)
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"), F.get(F.array(*[F.lit(c) for c in names]), (F.col("n_nationkey") % len(names)).cast("int")).alias("currency"))
    shaped = postings(spark, sf).join(n, "country").select(
        "id", "provider", F.when(F.col("status") != "P", F.col("posted_at")).alias("posted_at"), F.lit("2000-06-30").alias("generated_at"),
        F.when(F.col("pay") >= 10000, F.struct("min", "max", "currency", "period")).alias("compensation"),
    )
    fx = rates(spark, sf).join(n.filter(F.col("n_nationkey") < len(names)), "country").select(plan.fx_country(F.col("currency")).alias("country"), "year", "rate")
    merged = plan.merge([shaped.filter(F.col("id") % 3 == k) for k in range(3)], fx)
    return merged.groupBy("provider").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("compensation").alias("with_pay"),
        F.count("usd").alias("converted"),
        r(F.sum((F.col("usd.min") + F.col("usd.max")) / 2), 0).alias("usd"),
    )


@query(
    "provider_summary",
    WITH(POSTING, RATES)
    + """, known AS (SELECT DISTINCT o_orderpriority AS provider FROM orders UNION ALL SELECT '6-NEVER')
SELECT k.provider, count(p.id) > 0 AS available, count(p.id) AS rows, count(p.id) FILTER (period = 'year') AS with_pay,
  count(p.id) FILTER (period = 'year' AND rate IS NOT NULL) AS converted
FROM known k LEFT JOIN posting p ON p.provider = k.provider LEFT JOIN rates r ON r.country = p.country AND r.year = p.year GROUP BY k.provider""",
)
def provider_summary(spark, sf):
    df = lookups.exact_lookup(postings(spark, sf), rates(spark, sf), ["country", "year"], "rate")
    known = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("provider")).distinct()
    known = known.unionByName(spark.createDataFrame([("6-NEVER",)], "provider string"))
    paid = F.col("period") == "year"
    return plan.provider_summary(df, known, "provider", paid, paid & F.col("rate").isNotNull())


@query("null_rate", WITH(POSTING, RATES) + "SELECT provider, count(*) AS n, count(*) - count(rate) AS n_null FROM posting LEFT JOIN rates USING (country, year) GROUP BY provider")
def null_rate(spark, sf):
    df = lookups.exact_lookup(postings(spark, sf), rates(spark, sf), ["country", "year"], "rate")
    return plan.null_rate(df, "provider", "rate")


@query(
    "counts_by_key",
    WITH(POSTING)
    + """, known AS (SELECT id, CASE WHEN period = 'week' THEN NULL ELSE country END AS country FROM posting)
SELECT coalesce(country, 'unresolved') AS country, count(*) AS n FROM known GROUP BY 1""",
)
def counts_by_key(spark, sf):
    df = postings(spark, sf).withColumn("country", F.when(F.col("period") != "week", F.col("country")))
    return plan.count_by(df, "country")


@query(
    "representativeness",
    WITH(POSTING)
    + """, panel AS (SELECT country, count(*)::DOUBLE AS n FROM posting GROUP BY ALL),
bench AS (SELECT n_name AS country, count(*)::DOUBLE AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT country, n, round((n / sum(n) OVER ()) / (weight / sum(weight) OVER ()), 6) AS representativeness FROM panel JOIN bench USING (country)""",
)
def representativeness(spark, sf):
    panel = postings(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    bench = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("country")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    out = plan.representativeness(panel, bench, "country")
    return out.select("country", "n", r("representativeness", 6).alias("representativeness"))


@query(
    "benchmark_status",
    WITH(POSTING, RATES)
    + """, f AS (SELECT country, segment AS source_id, year, CASE WHEN segment <> 'MACHINERY' THEN median(pay) END AS regular,
    CASE WHEN segment = 'FURNITURE' THEN avg(pay) END AS total, segment <> 'MACHINERY' AS verified FROM posting GROUP BY country, segment, year),
ref AS (SELECT country, year, rate * 60000 AS value FROM rates WHERE country <> 'NATION_24'),
j AS (SELECT f.*, value, coalesce(regular, total) / value AS ratio, f.country IN (SELECT country FROM ref) AS series FROM f LEFT JOIN ref USING (country, year))
SELECT source_id, CASE WHEN NOT series THEN 'exempt' WHEN value IS NULL THEN 'no_year' WHEN coalesce(regular, total) IS NULL AND NOT verified THEN 'uncheckable'
  WHEN coalesce(regular, total) IS NULL THEN 'no_figure' WHEN ratio < 1.0 OR ratio > 2.5 THEN 'flagged' ELSE 'ok' END AS status,
  count(*) AS n, round(avg(ratio), 4) AS mean_ratio FROM j GROUP BY ALL""",
)
def benchmark_status(spark, sf):
    out = benchmark_rows(spark, sf)
    return out.groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ratio")).alias("mean_ratio"))


def benchmark_rows(spark, sf):
    p = postings(spark, sf)
    keys = ["country", "segment", "year"]
    f = group_quantiles(p, keys, "pay", {"regular": 0.5}).join(p.groupBy(*keys).agg(F.avg("pay").alias("avg")), keys)
    seg = F.col("segment")
    f = f.select(
        "country", "year", seg.alias("source_id"), F.when(seg != "MACHINERY", F.col("regular")).alias("regular"),
        F.when(seg == "FURNITURE", F.col("avg")).alias("total"), (seg != "MACHINERY").alias("verified"),
    )
    ref = rates(spark, sf).filter("country <> 'NATION_24'").select("country", "year", (F.col("rate") * 60000).alias("value"))
    return lookups.benchmark_ratio(f, ref, "country", "year", 1.0, 2.5, "verified")


@query(
    "findings_benchmark",
    WITH(POSTING, RATES)
    + """, f AS (SELECT country, segment AS source_id, year, CASE WHEN segment <> 'MACHINERY' THEN median(pay) END AS regular,
    CASE WHEN segment = 'FURNITURE' THEN avg(pay) END AS total, segment <> 'MACHINERY' AS verified FROM posting GROUP BY country, segment, year),
ref AS (SELECT country, year, rate * 60000 AS value FROM rates WHERE country <> 'NATION_24'),
j AS (SELECT f.*, value, coalesce(regular, total) / value AS ratio, f.country IN (SELECT country FROM ref) AS series FROM f LEFT JOIN ref USING (country, year)),
s AS (SELECT source_id, ratio, CASE WHEN NOT series THEN 'exempt' WHEN value IS NULL THEN 'no_year' WHEN coalesce(regular, total) IS NULL AND NOT verified THEN 'uncheckable'
  WHEN coalesce(regular, total) IS NULL THEN 'no_figure' WHEN ratio < 1.0 OR ratio > 2.5 THEN 'flagged' ELSE 'ok' END AS status FROM j)
SELECT 'benchmark' AS rule, 'flag' AS severity, source_id AS entity, status AS detail, count(*) AS n, round(sum(ratio), 4) AS ratios, round(sum(CASE WHEN ratio < 1.0 THEN 1.0 WHEN ratio > 2.5 THEN 2.5 END)::DOUBLE, 1) AS bounds
FROM s WHERE status IN ('flagged', 'no_year', 'no_figure') GROUP BY ALL""",
)
def findings_benchmark(spark, sf):
    f = quality.check_benchmark(benchmark_rows(spark, sf), "source_id")
    return f.groupBy("rule", "severity", "entity", "detail").agg(F.count(F.lit(1)).alias("n"), r(F.sum("observed")).alias("ratios"), r(F.sum("bound"), 1).alias("bounds"))
