"""Statistics queries over orders, lineitem, customer, part and events."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from paylens.functions.draws import counter_sql, mixed_sql, poisson_sql, stream_sql
from paylens.functions.maths import polynomial_sql
from paylens.operators import multivariate, shapiro, stats
from paylens.operators.bootstrap import bootstrap, bootstrap_interval
from paylens.operators.isolation import isolation_forest, isolation_paths
from paylens.operators.neighbours import local_outlier_factor
from paylens.operators.quantiles import group_quantiles
from paylens.queries.common import POSTING, WITH, postings, r, table
from paylens.queries.registry import query

SHAPE = """avg({v}) AS mean, CASE WHEN min({v}) > 0 THEN exp(avg(CASE WHEN {v} > 0 THEN ln({v}) END)) END AS geo,
    avg({v}) AS m1, avg({v}*{v}) AS m2, avg({v}*{v}*{v}) AS m3, count(*) AS n"""


def central(m: str, group: str, src: str, v: str, extra: str = "") -> str:
    """Population skewness and kurtosis from central moments in a second pass."""
    return f"""{m} AS (SELECT {group}, avg(v) AS mean, median(v) AS median, CASE WHEN min(v) > 0 THEN exp(avg(CASE WHEN v > 0 THEN ln(v) END)) END AS geo,
    count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, count(DISTINCT v) AS nd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
    avg((v - mu) ^ 3) / pow(avg((v - mu) ^ 2), 1.5) AS skew, avg((v - mu) ^ 4) / pow(avg((v - mu) ^ 2), 2) - 3 AS kurt {extra}
  FROM (SELECT {group}, {v} AS v, avg({v}) OVER (PARTITION BY {group}) AS mu FROM {src} WHERE {v} IS NOT NULL) GROUP BY {group})"""


@query(
    "estimator_error",
    WITH(POSTING, central("s", "country", "posting", "pay"))
    + """SELECT country, n, round(mean, 4) AS mean, round(median, 4) AS median, round(geo, 4) AS geometric_mean, round(skew, 3) AS skew, round(kurt, 3) AS excess_kurtosis,
  round(100 * (mean - median) / median, 3) AS mean_vs_median_pct, round(100 * (mean - geo) / geo, 3) AS mean_vs_geomean_pct FROM s WHERE n >= 12""",
)
def estimator_error(spark, sf):
    e = stats.estimator_error(postings(spark, sf), ["country"], "pay")
    names = ["mean", "median", "geometric_mean"]
    return e.select(
        "country", "n", *[r(c).alias(c) for c in names],
        *[r(c, 3).alias(c) for c in ("skew", "excess_kurtosis", "mean_vs_median_pct", "mean_vs_geomean_pct")],
    )


@query(
    "profile_numeric",
    "WITH " + central("s", "event_type", "events", "value")
    + """SELECT event_type, n, 0 AS n_missing, nd AS n_distinct, round(100 * (1 - nd / n), 3) AS duplicate_rate_pct, lo AS min, hi AS max, round(mean, 4) AS mean,
  round(median, 5) AS median, round(sd, 4) AS sd, round(q3 - q1, 5) AS iqr, round(skew, 3) AS skew, round(kurt, 3) AS excess_kurtosis, round(geo, 4) AS geometric_mean FROM s""",
)
def profile_numeric(spark, sf):
    p = stats.profile_numeric(table(spark, sf, "events"), ["event_type"], "value")
    rounded = {"duplicate_rate_pct": 3, "mean": 4, "median": 5, "sd": 4, "iqr": 5, "skew": 3, "excess_kurtosis": 3, "geometric_mean": 4}
    return p.select(
        "event_type", "n", F.col("n_missing").cast("int").alias("n_missing"), "n_distinct", "min", "max", *[r(c, d).alias(c) for c, d in rounded.items()]
    )


@query(
    "profile_numeric_lineitem",
    "WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON COLUMNS(*) INTO NAME field VALUE v), "
    + central("s", "field", "u", "v")
    + """SELECT field, n, nd AS n_distinct, lo AS min, hi AS max, round(mean, 4) AS mean, round(median, 5) AS median, round(sd, 4) AS sd, round(skew, 3) AS skew FROM s""",
)
def profile_numeric_lineitem(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = table(spark, sf, "lineitem").select(*cols).unpivot([], cols, "field", "v")
    p = stats.profile_numeric(long, ["field"], "v")
    return p.select("field", "n", "n_distinct", "min", "max", r("mean").alias("mean"), r("median", 5).alias("median"), r("sd").alias("sd"), r("skew", 3).alias("skew"))


@query(
    "profile_categorical",
    """WITH u AS (UNPIVOT (SELECT p_brand, p_type, p_name, CASE WHEN p_size % 10 <> 0 THEN p_size::VARCHAR END AS size FROM part) ON COLUMNS(*) INTO NAME field VALUE level),
k AS (SELECT field, level, count(*) AS k FROM u GROUP BY ALL), t AS (SELECT field, sum(k) AS n FROM k GROUP BY field)
SELECT field, max(n)::BIGINT AS n, (SELECT count(*) FROM part)::BIGINT - max(n)::BIGINT AS n_missing, count(*) AS cardinality, (arg_min(level, (-k, level))) AS mode,
  round(100 * max(k) / max(n), 3) AS mode_share_pct, count(*) FILTER (k = 1) AS singleton_levels, count(*) FILTER (k / n < 0.01) AS rare_levels
FROM k JOIN t USING (field) GROUP BY field""",
)
def profile_categorical(spark, sf):
    p = table(spark, sf, "part").withColumn("size", F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("string")))
    out = stats.profile_categorical(p, ["p_brand", "p_type", "p_name", "size"])
    return out.withColumn("mode_share_pct", r("mode_share_pct", 3))


@query(
    "quartiles_exclusive",
    """WITH s AS (SELECT p_type, l_extendedprice AS v, row_number() OVER (PARTITION BY p_type ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY p_type) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey),
j AS (SELECT DISTINCT p_type, n, q, greatest(1, least(floor(q * (n + 1)), n - 1)) AS j FROM s, (VALUES (0.25::DOUBLE), (0.5), (0.75)) t(q)),
x AS (SELECT j.p_type, j.n, q, a.v + (b.v - a.v) * (q * (j.n + 1) - j) AS v FROM j JOIN s a ON a.p_type = j.p_type AND a.rn = j JOIN s b ON b.p_type = j.p_type AND b.rn = j + 1)
SELECT p_type, n, round(max(v) FILTER (q = 0.25), 5) AS q1, round(max(v) FILTER (q = 0.5), 5) AS median, round(max(v) FILTER (q = 0.75), 5) AS q3 FROM x GROUP BY p_type, n""",
)
def quartiles_exclusive(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    d = li.join(p, li.l_partkey == p.p_partkey).select("p_type", "l_extendedprice")
    q = group_quantiles(d, ["p_type"], "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "exclusive")
    return q.select("p_type", "n", *[r(c, 5).alias(c) for c in ("q1", "median", "q3")])


@query(
    "quartiles_inclusive",
    """SELECT p_type, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 5) AS q1, round(median(l_extendedprice), 5) AS median, round(quantile_cont(l_extendedprice, 0.75), 5) AS q3
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""",
)
def quartiles_inclusive(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    d = li.join(p, li.l_partkey == p.p_partkey).select("p_type", "l_extendedprice")
    q = group_quantiles(d, ["p_type"], "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select("p_type", "n", *[r(c, 5).alias(c) for c in ("q1", "median", "q3")])


@query(
    "hill_tail",
    WITH(POSTING)
    + """, s AS (SELECT country, pay, row_number() OVER (PARTITION BY country ORDER BY pay DESC) AS rn, count(*) OVER (PARTITION BY country) AS n FROM posting WHERE pay > 0),
k AS (SELECT *, greatest(5, least(n // 5, 50)) AS k FROM s WHERE n >= 20)
SELECT country, n, k, round(1 / (avg(ln(pay)) FILTER (rn <= k) - max(ln(pay)) FILTER (rn = k + 1)), 4) AS alpha FROM k GROUP BY country, n, k""",
)
def hill_tail(spark, sf):
    h = stats.hill(postings(spark, sf), ["country"], "pay")
    return h.select("country", "n", "k", r("alpha").alias("alpha"))


@query(
    "granularity",
    """SELECT p_brand, count(*) AS n, CASE """
    + " ".join(f"WHEN count(*) FILTER (v % {s} = 0) / count(*) >= 0.9 THEN {s}" for s in stats.STEPS)
    + """ END::INTEGER AS step FROM (SELECT p_brand, CASE WHEN p_partkey % 20 = 0 THEN p_size ELSE p_size * 500 END::DOUBLE AS v FROM part) GROUP BY p_brand HAVING count(*) >= 12""",
)
def granularity(spark, sf):
    v = F.when(F.col("p_partkey") % 20 == 0, F.col("p_size")).otherwise(F.col("p_size") * 500)
    return stats.granularity(table(spark, sf, "part").select("p_brand", v.alias("v")), ["p_brand"], "v")


@query(
    "digit_heaping",
    """WITH w AS (SELECT p_brand, p_size, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size <> 0),
d AS (SELECT p_brand, any_value(n) AS n, p_size % 10 AS d, count(*) AS k FROM w GROUP BY p_brand, p_size % 10),
c AS (SELECT p_brand, any_value(n) AS n, sum((k - n / 10.0) ^ 2 / (n / 10.0)) + (10 - count(*)) * any_value(n) / 10.0 AS chi2 FROM d GROUP BY p_brand)
SELECT p_brand, n, round(chi2, 4) AS chi2, chi2 > 21.665994 AS rejected, (SELECT round(100 * count(*) FILTER (p_size % 5 = 0) / count(*), 3) FROM w WHERE w.p_brand = c.p_brand) AS ends_in_0_or_5_pct
FROM c WHERE n >= 12""",
)
def digit_heaping(spark, sf):
    h = stats.digit_heaping(table(spark, sf, "part"), ["p_brand"], "p_size")
    return h.select("p_brand", "n", r("chi2").alias("chi2"), "rejected", r("ends_in_0_or_5_pct", 3).alias("ends_in_0_or_5_pct"))


@query(
    "heaping_by_provider",
    """SELECT o_orderpriority AS provider, count(*) AS n, round(100 * count(*) FILTER (v % 5 = 0) / count(*), 3) AS ends_0_or_5_pct, round(100 * count(*) FILTER (v % 1000 = 0) / count(*), 3) AS ends_000_pct
FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 1000) * 1000 ELSE floor(o_totalprice) END AS v FROM orders) GROUP BY 1""",
)
def heaping_by_provider(spark, sf):
    v = F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") / 1000) * 1000).otherwise(F.floor("o_totalprice"))
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("provider"), v.alias("v"))
    h = stats.heaping_shares(d, ["provider"], "v")
    return h.select("provider", "n", r("multiples_of_5_pct", 3).alias("ends_0_or_5_pct"), r("multiples_of_1000_pct", 3).alias("ends_000_pct"))


Z = repr(stats.normal_quantile(0.975))
RANK = "greatest(0, least(ceil(n * (0.5 + 0.5 * ({z}) / sqrt(n + ({z}) * ({z}))))::BIGINT - 1, n - 1))"


@query(
    "median_ci",
    WITH(POSTING)
    + f""", s AS (SELECT country, pay, row_number() OVER (PARTITION BY country ORDER BY pay) - 1 AS rn, count(*) OVER (PARTITION BY country) AS n FROM posting)
SELECT country, n, round(median(pay), 4) AS median, max(pay) FILTER (rn = {RANK.format(z=f"-{Z}::DOUBLE")}) AS lo, max(pay) FILTER (rn = {RANK.format(z=f"{Z}::DOUBLE")}) AS hi
FROM s GROUP BY country, n HAVING n >= 12""",
)
def median_ci(spark, sf):
    m = stats.median_ci(postings(spark, sf), ["country"], "pay")
    return m.select("country", "n", r("median").alias("median"), "lo", "hi")


@query(
    "median_bca",
    WITH(POSTING)
    + f""", s AS (SELECT country, pay, row_number() OVER (PARTITION BY country ORDER BY pay) - 1 AS rn, count(*) OVER (PARTITION BY country) AS n FROM posting),
o AS (SELECT country, n, n // 2 AS h, max(pay) FILTER (rn = greatest(0, (n - 1) // 2 - 1)) AS a, max(pay) FILTER (rn = (n - 1) // 2) AS b, max(pay) FILTER (rn = least(n - 1, (n - 1) // 2 + 1)) AS c
  FROM s GROUP BY country, n HAVING n >= 12),
j AS (SELECT *, (a + b) / 2 AS lo1, (a + c) / 2 AS mi1, (b + c) / 2 AS hi1, (h * ((a + b) / 2) + (a + c) / 2 + h * ((b + c) / 2)) / n AS mu FROM o),
q AS (SELECT *, h * (mu - lo1) ^ 3 + (mu - mi1) ^ 3 + h * (mu - hi1) ^ 3 AS cube, h * (mu - lo1) ^ 2 + (mu - mi1) ^ 2 + h * (mu - hi1) ^ 2 AS sq FROM j),
p AS (SELECT country, n, CASE WHEN n % 2 = 1 THEN b ELSE (b + c) / 2 END AS median, CASE WHEN n % 2 = 1 THEN -0.5 / sqrt(h * (1 - h / n)) ELSE 0 END AS z0,
  CASE WHEN n % 2 = 1 AND sq > 0 THEN cube / (6 * pow(sq, 1.5)) ELSE 0 END AS acc FROM q),
z AS (SELECT *, z0 + (z0 - {Z}::DOUBLE) / (1 - acc * (z0 - {Z}::DOUBLE)) AS zl, z0 + (z0 + {Z}::DOUBLE) / (1 - acc * (z0 + {Z}::DOUBLE)) AS zu FROM p)
SELECT country, n, round(median, 4) AS median, round(z0, 6) AS z0, round(acc, 6) AS acceleration,
  (SELECT max(pay) FROM s WHERE s.country = z.country AND rn = greatest(0, least(ceil(z.n * (0.5 + 0.5 * zl / sqrt(z.n + zl * zl)))::BIGINT - 1, z.n - 1))) AS lo,
  (SELECT max(pay) FROM s WHERE s.country = z.country AND rn = greatest(0, least(ceil(z.n * (0.5 + 0.5 * zu / sqrt(z.n + zu * zu)))::BIGINT - 1, z.n - 1))) AS hi FROM z""",
)
def median_bca(spark, sf):
    m = stats.median_bca(postings(spark, sf), ["country"], "pay")
    return m.select("country", "n", r("median").alias("median"), r("z0", 6).alias("z0"), r("acceleration", 6).alias("acceleration"), "lo", "hi")


#: Weighted draws of every posting in every replicate, summed by country: the draws that the operator makes.
BOOT = f"""rows_ AS (SELECT country, pay, {counter_sql("id::VARCHAR")} AS row_ FROM posting),
streams AS (SELECT replicate, stream_ FROM {mixed_sql("(SELECT i::INTEGER AS replicate FROM range(0, {many}) t(i))", stream_sql("replicate", 15), "stream_")}),
w AS (SELECT country, replicate, pay, {poisson_sql("draw")} AS w FROM {mixed_sql("(SELECT country, replicate, pay, row_, stream_ FROM rows_, streams)", "xor(row_, stream_)", "draw")}),
boot AS (SELECT country, replicate, sum(w)::BIGINT AS n, sum(pay * w) / nullif(sum(w), 0) AS mean FROM w GROUP BY ALL)"""


@query("bootstrap_means", WITH(POSTING, BOOT.replace("{many}", "200")) + "SELECT country, replicate, n, round(mean * n, 2) AS total FROM boot")
def bootstrap_means(spark, sf):
    """Size and total of each replicate: totals are whole cents, which means are not."""
    b = bootstrap(postings(spark, sf), ["country"], "pay", "id", 200)
    return b.select("country", "replicate", "n", r(F.col("mean") * F.col("n"), 2).alias("total"))


@query(
    "bootstrap_interval",
    WITH(POSTING, BOOT.replace("{many}", "10000"))
    + """SELECT country, count(*) AS replicates, round(quantile_cont(mean, 0.025), 2) AS lo, round(quantile_cont(mean, 0.975), 2) AS hi FROM boot GROUP BY country""",
)
def interval(spark, sf):
    b = bootstrap_interval(postings(spark, sf), ["country"], "pay", "id")
    return b.select("country", "replicates", r("lo", 2).alias("lo"), r("hi", 2).alias("hi"))


OUT = """q AS (SELECT {g} AS g, v, n, quantile_cont(v, 0.25) OVER w AS q1, median(v) OVER w AS md, quantile_cont(v, 0.75) OVER w AS q3, min(v) OVER w AS lo,
    avg(v) OVER w AS mu FROM (SELECT {g}, {v} AS v, count(*) OVER (PARTITION BY {g}) AS n FROM {src}) WINDOW w AS (PARTITION BY {g})),
m AS (SELECT g, median(abs(v - md)) AS mad, avg((v - mu) ^ 3) / pow(avg((v - mu) ^ 2), 1.5) AS skew, quantile_cont(CASE WHEN lo > 0 THEN ln(CASE WHEN v > 0 THEN v END) END, 0.25) AS lq1,
    quantile_cont(CASE WHEN lo > 0 THEN ln(CASE WHEN v > 0 THEN v END) END, 0.75) AS lq3 FROM q GROUP BY g),
f AS (SELECT q.g, v, v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS a, coalesce(mad > 0 AND abs(0.6745 * (v - md) / nullif(mad, 0)) > 3.5, false) AS b,
    CASE WHEN lo > 0 AND skew > 0.5 THEN ln(CASE WHEN v > 0 THEN v END) < lq1 - 1.5 * (lq3 - lq1) OR ln(CASE WHEN v > 0 THEN v END) > lq3 + 1.5 * (lq3 - lq1)
      ELSE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) END AS c FROM q JOIN m USING (g))"""


@query(
    "outlier_rules",
    "WITH " + OUT.format(g="event_type", v="value", src="events")
    + """SELECT g AS event_type, count(*) AS n, count(*) FILTER (a) AS iqr_fence_n, count(*) FILTER (b) AS robust_z_n, count(*) FILTER (c) AS log_fence_n,
  count(*) FILTER (a AND b AND c) AS by_all_n, count(*) FILTER (a OR b OR c) AS by_any_n FROM f GROUP BY g""",
)
def outlier_rules(spark, sf):
    return stats.outlier_summary(table(spark, sf, "events"), ["event_type"], "value")


ORDER_SUM = """j AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice AS x, round(sum(l_extendedprice * (1 - l_discount)), 4) AS y
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def order_sum(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("y")
    )
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"))
    return o.join(li, "o_orderkey")


@query(
    "bland_altman",
    WITH(ORDER_SUM)
    + """SELECT g, count(*) AS n, round(exp(avg(d)), 4) AS bias, round(exp(avg(d) - 1.96 * stddev_samp(d)), 4) AS loa_lo, round(exp(avg(d) + 1.96 * stddev_samp(d)), 4) AS loa_hi, round(corr(x, y), 6) AS pearson_r
FROM (SELECT *, ln(y) - ln(x) AS d FROM j WHERE x > 0 AND y > 0) GROUP BY g""",
)
def bland_altman(spark, sf):
    b = stats.bland_altman(order_sum(spark, sf), ["g"], "x", "y")
    return b.select("g", "n", *[r(c).alias(c) for c in ("bias", "loa_lo", "loa_hi")], r("pearson_r", 6).alias("pearson_r"))


@query(
    "bland_altman_linear",
    WITH(ORDER_SUM)
    + """SELECT count(*) AS n, round(avg(d), 2) AS bias, round(avg(d) - 1.96 * stddev_samp(d), 2) AS loa_lo, round(avg(d) + 1.96 * stddev_samp(d), 2) AS loa_hi
FROM (SELECT *, y - x AS d FROM j WHERE x > 0 AND y > 0)""",
)
def bland_altman_linear(spark, sf):
    b = stats.bland_altman(order_sum(spark, sf), [], "x", "y", log_space=False)
    return b.select("n", *[r(c, 2).alias(c) for c in ("bias", "loa_lo", "loa_hi")])


@query(
    "spearman",
    WITH(ORDER_SUM)
    + """, k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j)
SELECT count(*) AS n, round(corr(rx::DOUBLE, ry::DOUBLE), 8) AS spearman_r FROM k""",
)
def spearman(spark, sf):
    return stats.spearman(order_sum(spark, sf), "x", "y").select("n", r("spearman_r", 8).alias("spearman_r"))


@query(
    "deming",
    WITH(ORDER_SUM)
    + """, m AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy FROM j GROUP BY g),
s AS (SELECT *, ((syy - sxx) + sqrt((syy - sxx) ^ 2 + 4 * sxy ^ 2)) / (2 * sxy) AS slope FROM m)
SELECT g, n, round(slope, 4) AS slope, round(sxy / sxx, 6) AS ols_slope FROM s""",
)
def deming(spark, sf):
    d = stats.deming(order_sum(spark, sf), ["g"], "x", "y")
    return d.select("g", "n", r("slope").alias("slope"), r("ols_slope", 6).alias("ols_slope"))


@query(
    "benford",
    """SELECT event_type, n, round(mad, 6) AS mad, round(orders, 4) AS orders, orders >= 3 AS interpretable FROM (
  SELECT event_type, count(*) AS n, log10(max(value) / min(value)) AS orders, ("""
    + " + ".join(f"abs(count(*) FILTER (left(printf('%.10e', value), 1) = '{d}') / count(*) - {math.log10(1 + 1 / d)!r}::DOUBLE)" for d in range(1, 10))
    + """) / 9 AS mad FROM events WHERE value > 0 GROUP BY 1) WHERE n >= 50""",
)
def benford(spark, sf):
    b = stats.benford(table(spark, sf, "events"), ["event_type"], "value")
    return b.select("event_type", "n", r("mad", 6).alias("mad"), r("orders").alias("orders"), "interpretable")


@query(
    "mann_whitney",
    """WITH k AS (SELECT c_mktsegment = 'BUILDING' AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0::DOUBLE AS rk, c_acctbal AS v FROM customer),
t AS (SELECT sum(k::DOUBLE ^ 3 - k) AS tie FROM (SELECT count(*) AS k FROM customer GROUP BY c_acctbal)),
m AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (g)::DOUBLE AS n1, sum(rk) FILTER (g) AS r1 FROM k)
SELECT n1::BIGINT AS n1, (n - n1)::BIGINT AS n2, r1 - n1 * (n1 + 1) / 2 AS u,
  round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2 - 0.5) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - tie / (n * (n - 1)))), 6) AS z FROM m, t""",
)
def mann_whitney(spark, sf):
    m = stats.mann_whitney(table(spark, sf, "customer"), F.col("c_mktsegment") == "BUILDING", "c_acctbal")
    return m.select("n1", "n2", "u", r("z", 6).alias("z"))


@query(
    "ratio_outliers",
    WITH(ORDER_SUM)
    + """, q AS (SELECT *, y / x AS ratio FROM j WHERE x <> 0 AND y <> 0), m AS (SELECT median(ratio) AS med FROM q), d AS (SELECT median(abs(ratio - med)) AS mad FROM q, m)
SELECT o_orderkey, round(ratio, 6) AS ratio, round(med, 6) AS ratio_median, round(0.6745 * (ratio - med) / mad, 4) AS robust_z FROM q, m, d WHERE abs(0.6745 * (ratio - med) / mad) > 3.5""",
)
def ratio_outliers(spark, sf):
    o = stats.ratio_outliers(order_sum(spark, sf), "x", "y")
    return o.select("o_orderkey", r("ratio", 6).alias("ratio"), r("ratio_median", 6).alias("ratio_median"), r("robust_z").alias("robust_z"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]
    ),
)
def corr_pairs(spark, sf):
    return stats.corr_pairs(table(spark, sf, "lineitem"), MEASURES).withColumn("r", r("r", 8))


@query("pca_dims")
def pca_dims(spark, sf):
    p = multivariate.pca_array(table(spark, sf, "embeddings"), "embedding")
    return p.select("component", r("variance", 6).alias("variance"), r("cumulative", 6).alias("cumulative"), "reaches_share")


@query(
    "vif_two_columns",
    "SELECT f AS feature, round(r * r, 6) AS r2_on_others, round(1 / (1 - r * r), 6) AS vif FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), (VALUES ('l_quantity'), ('l_extendedprice')) t(f)",
)
def vif_two_columns(spark, sf):
    v = multivariate.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return v.select("feature", r("r2_on_others", 6).alias("r2_on_others"), r("vif", 6).alias("vif"))


@query("vif")
def vif(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    v = multivariate.vif(d, [*MEASURES, "net"])
    return v.select("feature", r("r2_on_others", 6).alias("r2_on_others"), r("vif", 4).alias("vif"))


@query(
    "mahalanobis",
    """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS a, var_samp(l_extendedprice) AS b, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(d2), 4) AS mean_d2, count(*) FILTER (d2 > 7.377759) AS far FROM (
  SELECT l_returnflag, (b * (l_quantity - mx) ^ 2 - 2 * c * (l_quantity - mx) * (l_extendedprice - my) + a * (l_extendedprice - my) ^ 2) / (a * b - c * c) AS d2 FROM lineitem, m) GROUP BY 1""",
)
def mahalanobis(spark, sf):
    li = table(spark, sf, "lineitem")
    d = li.withColumn("d2", multivariate.mahalanobis(li, ["l_quantity", "l_extendedprice"]))
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("d2")).alias("mean_d2"), F.count_if(F.col("d2") > 7.377759).alias("far"))


def outlier_columns(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_tax") + 1).alias("taxed"))


OUTLIER_COLUMNS, LINE = ["l_quantity", "l_extendedprice", "taxed"], ["l_orderkey", "l_linenumber"]


@query("mv_outliers")
def mv_outliers(spark, sf):
    out = multivariate.mv_outliers(outlier_columns(spark, sf), OUTLIER_COLUMNS, LINE)
    return out.filter("flagged").select("l_orderkey", "l_linenumber", "far", "isolated", "alone", "votes")


@query("mv_census")
def mv_census(spark, sf):
    d = outlier_columns(spark, sf).withColumn("taxed", F.col("taxed") - 1)  # rows without tax have no logarithm
    return multivariate.mv_census(multivariate.mv_verdicts(d, OUTLIER_COLUMNS, LINE))


def forest_sql(rows: str, k: int, trees: int = 100, sample: int = 256, depth: int = 8, seed: int = 15) -> str:
    """SQL of the forest that the operator grows, and of the path of every row of ``rows`` (row_, x0, x1, ..)."""
    xs = ", ".join(f"x{i}" for i in range(k))
    wide = "[" + ", ".join(f"lo{i} < hi{i}" for i in range(k)) + "]"
    pick = "CASE " + " ".join(f"WHEN {wide}[(pick + {j}) % {k} + 1] THEN (pick + {j}) % {k}" for j in range(k)) + " END"
    at = lambda side: "[" + ", ".join(f"{side}{i}" for i in range(k)) + "][f + 1]"
    value = "CASE f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(k)) + " END"
    ends = ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(k))
    parts = [
        f"rows_ AS MATERIALIZED ({rows})",
        f"bar AS (SELECT CASE WHEN count(*) > {sample} THEN floor({sample}::DOUBLE / count(*) * 4294967296.0::DOUBLE)::BIGINT ELSE 4294967296 END AS bar FROM rows_)",
        f"streams AS MATERIALIZED (SELECT tree, stream_ FROM {mixed_sql(f'(SELECT i AS tree FROM range(0, {trees}) t(i))', stream_sql('tree', seed), 'stream_')})",
        f"t0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, {xs} FROM {mixed_sql('(SELECT * FROM rows_, streams)', 'xor(row_, stream_)', 'draw')}, bar WHERE draw < bar)",
    ]
    for d in range(depth + 1):
        parts.append(f"s{d} AS MATERIALIZED (SELECT tree, node, count(*) AS n, {ends} FROM t{d} GROUP BY tree, node)")
        if d < depth:
            drawn = mixed_sql(f"(SELECT *, tree * {2 << depth} + node AS number FROM s{d} WHERE n > 1 AND list_contains({wide}, true))", stream_sql("number", seed + 1), "pick")
            drawn = mixed_sql(drawn, stream_sql("number", seed + 2), "place")
            parts.append(f"c{d} AS MATERIALIZED (SELECT tree, node, f, {at('lo')} + (place + 0.5::DOUBLE) / 4294967296.0::DOUBLE * ({at('hi')} - {at('lo')}) AS cut FROM (SELECT *, {pick} AS f FROM {drawn}))")
            parts.append(f"t{d + 1} AS MATERIALIZED (SELECT tree, 2 * node + ({value} >= cut)::BIGINT AS node, {xs} FROM t{d} JOIN c{d} USING (tree, node))")
    cuts = " UNION ALL ".join(f"SELECT * FROM c{d}" for d in range(depth))
    nodes = " UNION ALL ".join(f"SELECT tree, node, n FROM s{d}" for d in range(depth + 1))
    parts += [f"cuts AS MATERIALIZED ({cuts})", f"nodes AS MATERIALIZED ({nodes})", "w0 AS (SELECT rows_.*, tree, 1::BIGINT AS node FROM rows_, (SELECT tree FROM s0))"]
    for d in range(depth):
        parts.append(f"w{d + 1} AS (SELECT w{d}.* REPLACE (CASE WHEN cut IS NULL THEN w{d}.node ELSE 2 * w{d}.node + ({value} >= cut)::BIGINT END AS node) FROM w{d} LEFT JOIN cuts USING (tree, node))")
    extra = "CASE WHEN n IS NULL OR n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + 0.5772156649015329::DOUBLE) - 2 * (n - 1) / n::DOUBLE END"
    parts.append(f"paths AS (SELECT w{depth}.*, floor(log2(w{depth}.node)) + {extra} AS path FROM w{depth} LEFT JOIN nodes USING (tree, node))")
    return "WITH " + ",\n".join(parts)


@query(
    "isolation_paths",
    forest_sql(
        f"SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, {counter_sql("l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR")} AS row_, l_quantity::DOUBLE AS x0, l_extendedprice::DOUBLE AS x1, l_tax::DOUBLE AS x2 FROM lineitem", 3
    )
    + " SELECT l_orderkey, l_linenumber, round(avg(path), 6) AS path FROM paths GROUP BY rid, l_orderkey, l_linenumber",
)
def forest_paths(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    d = table(spark, sf, "lineitem").select(*LINE, *cols)
    return isolation_paths(d, cols, isolation_forest(d, cols, LINE)).select(*LINE, r("path", 6).alias("path"))


@query(
    "lof_parts",
    """WITH s AS (SELECT avg(p_retailprice) AS mp, stddev_samp(p_retailprice) AS sp, avg(p_size) AS ms, stddev_samp(p_size) AS ss FROM part),
p AS (SELECT p_partkey, (p_retailprice - mp) / sp AS x, (p_size - ms) / ss AS y FROM part, s),
d AS (SELECT a.p_partkey AS a, b.p_partkey AS b, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS d FROM p a, p b WHERE a.p_partkey <> b.p_partkey),
k AS (SELECT a, b, d, max(d) FILTER (r <= 15) OVER (PARTITION BY a) AS reach FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM d)),
n AS MATERIALIZED (SELECT a, b, d FROM k WHERE d <= reach), t AS (SELECT a, max(d) AS reach FROM n GROUP BY a),
l AS MATERIALIZED (SELECT n.a, 1 / (avg(greatest(d, t.reach)) + 1e-10::DOUBLE) AS density FROM n JOIN t ON t.a = n.b GROUP BY n.a)
SELECT n.a AS p_partkey, round(avg(o.density) / any_value(m.density), 6) AS lof FROM n JOIN l o ON o.a = n.b JOIN l m ON m.a = n.a GROUP BY n.a""",
)
def lof_parts(spark, sf):
    p = table(spark, sf, "part")
    m = p.agg(F.avg("p_retailprice"), F.stddev_samp("p_retailprice"), F.avg("p_size"), F.stddev_samp("p_size")).first()
    d = p.select("p_partkey", ((F.col("p_retailprice") - m[0]) / m[1]).alias("x"), ((F.col("p_size") - m[2]) / m[3]).alias("y"))
    f = local_outlier_factor(d, ["x", "y"]).withColumnsRenamed({"z0": "x", "z1": "y"})
    return d.join(f, ["x", "y"]).select("p_partkey", r("lof", 6).alias("lof"))


@query(
    "missingness",
    """SELECT lang, of, field, missing FROM (SELECT lang, count(*) AS of, count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic, count(*) FILTER (text IS NULL) AS text
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang) UNPIVOT (missing FOR field IN (quality, toxic, text))""",
)
def missingness(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return stats.missingness(d, ["lang"], ["quality", "toxic", "text"])


@query(
    "lineage",
    """WITH d AS (SELECT ln(l_extendedprice) AS price, ln(l_quantity) AS quantity, ln(l_extendedprice * (1 - l_discount)) AS net, ln(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS charge FROM lineitem
  WHERE l_extendedprice > 0 AND l_quantity > 0 AND l_extendedprice * (1 - l_discount) > 0)
SELECT 'net' AS derived, 'price' AS input, round(corr(net, price), 6) AS r FROM d UNION ALL SELECT 'charge', 'net', round(corr(charge, net), 6) FROM d UNION ALL SELECT 'charge', 'price', round(corr(charge, price), 6) FROM d""",
)
def lineage(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    d = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), net.alias("net"), (net * (1 + F.col("l_tax"))).alias("charge")
    )
    graph = {"net": ["price", "discount"], "charge": ["net", "price", "tax"]}
    return stats.lineage(d, graph, ["price", "quantity", "net", "charge"]).withColumn("r", r("r", 6))


@query(
    "implied_yield",
    "SELECT p_brand, count(*) AS n, round(median(12 * p_size::DOUBLE / (60.0::DOUBLE * p_retailprice)), 8) AS median_yield FROM part WHERE p_size <> 0 AND p_retailprice <> 0 GROUP BY p_brand",
)
def implied_yield(spark, sf):
    y = stats.implied_yield(table(spark, sf, "part"), ["p_brand"], "p_size", "p_retailprice")
    return y.select("p_brand", "n", r("median_yield", 8).alias("median_yield"))


@query(
    "temporal_gap",
    """SELECT entity, month, n, round(mean, 4) AS mean, round(median, 5) AS median, round(abs(100 * (mean - median) / median), 4) AS gap_pct FROM (
  SELECT event_type AS entity, strftime(ts, '%Y-%m-%d') AS month, count(*) AS n, avg(value) AS mean, median(value) AS median FROM events WHERE value > 0 GROUP BY ALL HAVING count(*) >= 6)""",
)
def temporal_gap(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("entity"), F.date_format("ts", "yyyy-MM-dd").alias("month"), "value")
    t = stats.temporal_gap(e, ["entity"], "month", "value")
    return t.select("entity", "month", "n", r("mean").alias("mean"), r("median", 5).alias("median"), r("gap_pct").alias("gap_pct"))


DAILY = """daily AS (SELECT c_mktsegment AS entity, strftime(o_orderdate, '%Y-%m') AS m, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def monthly(spark, sf):
    p = postings(spark, sf)
    return p.groupBy(F.col("segment").alias("entity"), F.substring("posted_at", 1, 7).alias("m")).agg(F.round(F.sum("pay"), 2).alias("value"))


@query(
    "noise_test",
    WITH(DAILY)
    + """, s AS (SELECT entity, m, value AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity)::DOUBLE AS n, lag(value) OVER w AS prev FROM daily WINDOW w AS (PARTITION BY entity ORDER BY m)),
x AS (SELECT *, i - (n - 1) / 2 AS p1 FROM s WHERE n >= 36), y AS (SELECT *, p1 * p1 - (n * n - 1) / 12 AS p2, p1 * p1 * p1 - p1 * (3 * n * n - 7) / 20 AS p3 FROM x),
c AS (SELECT entity, avg(y) AS c0, sum(y * p1) / sum(p1 * p1) AS c1, sum(y * p2) / sum(p2 * p2) AS c2, sum(y * p3) / sum(p3 * p3) AS c3 FROM y GROUP BY entity),
r AS (SELECT entity, m, n, y - (c0 + c1 * p1 + c2 * p2 + c3 * p3) AS r, (y - prev) / prev AS c FROM y JOIN c USING (entity)),
d AS (SELECT entity, m, n, c, r - avg(r) OVER (PARTITION BY entity) AS r, c - avg(c) OVER (PARTITION BY entity) AS cm FROM r),
l AS (SELECT *, lag(r, 1) OVER w AS r1, lag(r, 2) OVER w AS r2, lag(cm, 1) OVER w AS c1 FROM d WINDOW w AS (PARTITION BY entity ORDER BY m))
SELECT entity, max(n)::BIGINT AS n, round(sum(r * r1) / sum(r * r), 6) AS residual_acf1, round(sum(r * r2) / sum(r * r), 6) AS residual_acf2, round(sum(cm * c1) / sum(cm * cm), 6) AS change_acf1,
  round(100 * stddev_samp(c), 4) AS change_sd_pct, sum(r * r1) / sum(r * r) < 0.6 AND sum(cm * c1) / sum(cm * cm) < -0.25 AS noisy FROM l GROUP BY entity""",
)
def noise_test(spark, sf):
    t = stats.noise_test(monthly(spark, sf), ["entity"], "m", "value")
    return t.select("entity", "n", *[r(c, 6).alias(c) for c in ("residual_acf1", "residual_acf2", "change_acf1")], r("change_sd_pct").alias("change_sd_pct"), "noisy")


#: SQL of Shapiro-Wilk's W and p of ``v`` by ``g`` in ``src`` (g, v), every row ranked.
SHAPIRO = f"""x AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i, count(*) OVER (PARTITION BY g) AS n FROM src WHERE v IS NOT NULL),
m AS (SELECT n, i, {shapiro.SCORE} AS m FROM (SELECT DISTINCT n, i FROM x WHERE n BETWEEN 3 AND 5000)),
t AS (SELECT *, {shapiro.DIVISOR} AS divisor FROM (SELECT *, {shapiro.FIRST_WEIGHT} AS a1, {shapiro.SECOND_WEIGHT} AS a2 FROM (SELECT n, mm, {shapiro.FIRST_SCORE} AS m1, {shapiro.SECOND_SCORE} AS m2 FROM (SELECT n, sum(m * m) AS mm FROM m GROUP BY n)))),
a AS (SELECT n, i, {shapiro.WEIGHT} AS a FROM m JOIN t USING (n)),
w AS (SELECT g, n, least(1.0::DOUBLE, sum(a * v) ^ 2 / (var_pop(v) * count(*))) AS w FROM x JOIN a USING (n, i) GROUP BY g, n HAVING min(v) < max(v)),
z AS (SELECT *, {shapiro.Z} AS z FROM w),
sw AS (SELECT g, n, w, CASE WHEN n = 3 THEN greatest(0, {6 / math.pi!r}::DOUBLE * (asin(sqrt(w)) - {math.asin(math.sqrt(0.75))!r}::DOUBLE)) WHEN w >= 1 THEN 1 WHEN z >= 0 THEN tail ELSE 1 - tail END AS p FROM (
  SELECT *, exp(-z * z / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE * {polynomial_sql((0.0, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), "(1 / (1 + 0.2316419::DOUBLE * abs(z)))")} AS tail FROM z))"""


@query("shapiro_wilk", "WITH src AS (SELECT p_brand AS g, p_retailprice AS v FROM part),\n" + SHAPIRO + " SELECT g AS p_brand, n, round(w, 6) AS w, round(p, 5) AS p FROM sw")
def shapiro_parts(spark, sf):
    s = shapiro.shapiro_wilk(table(spark, sf, "part"), ["p_brand"], "p_retailprice")
    return s.select("p_brand", F.col("n").cast("long").alias("n"), r("w", 6).alias("w"), r("p", 5).alias("p"))


@query("normality")
def normality(spark, sf):
    nm = stats.normality(table(spark, sf, "events"), ["event_type"], "value")
    return nm.select("event_type", "n", *[r(c, 4).alias(c) for c in ("ks_raw", "ks_log", "ad_raw", "ad_log", "w_raw", "p_raw", "w_log", "p_log")], "rejects_normal", "better_fit")
