"""Text, location, duplicate and label queries over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paylens.functions import geo, text
from paylens.operators import dedupe, stats
from paylens.plans import postings as plan
from paylens.queries.common import POSTING, WITH, postings, r, table
from paylens.queries.registry import query
from paylens.session import written

FORM = f"'(^|[^\\p{{L}}\\p{{N}}_])(?:{text.FORM_WORDS})([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\2', 'g'"


def norm_sql(col: str) -> str:
    """Form words need two passes because each match eats the separator it shares with the next."""
    words = f"regexp_replace(regexp_replace(lower({col}), {FORM}), {FORM})"
    return rf"trim(regexp_replace(regexp_replace({words}, '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    "norm_keys",
    f"SELECT doc_id, md5(k) AS key_md5, length(k) AS key_chars FROM (SELECT doc_id, {norm_sql('text')} AS k FROM documents)",
)
def norm_keys(spark, sf):
    k = text.norm(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(k).alias("key_md5"), F.length(k).cast("long").alias("key_chars"))


@query(
    "job_keys",
    f"""SELECT concat_ws(' | ', {norm_sql("p_name || ' (Full-Time)'")}, {norm_sql("p_brand")}, {norm_sql("p_type || ', Remote'")}) AS key, count(*) AS n
FROM part GROUP BY 1""",
)
def job_keys(spark, sf):
    key = text.job_key(F.concat("p_name", F.lit(" (Full-Time)")), F.col("p_brand"), F.concat("p_type", F.lit(", Remote")))
    return table(spark, sf, "part").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "exact_dupes",
    """SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows_in_groups, coalesce(sum(n - 1), 0)::BIGINT AS removable
FROM (SELECT count(*) AS n FROM part GROUP BY lower(trim(p_name)), lower(p_brand), lower(p_type) HAVING count(*) > 1)""",
)
def exact_dupes(spark, sf):
    p = table(spark, sf, "part").select(F.lower(F.trim("p_name")).alias("a"), F.lower("p_brand").alias("b"), F.lower("p_type").alias("c"))
    return dedupe.exact_census(p, ["a", "b", "c"])


@query(
    "exact_dupes_by_source",
    f"""SELECT source, count(*) AS groups, sum(n)::BIGINT AS rows_in_groups, sum(n - 1)::BIGINT AS removable FROM (
  SELECT source, {norm_sql('text')} AS k, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1) GROUP BY source""",
)
def exact_dupes_by_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", text.norm(F.col("text")).alias("k"))
    g = dedupe.distinct_keys(d, ["source"], "k", "doc_id").filter("copies > 1")
    return g.groupBy("source").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("copies").alias("rows_in_groups"), F.sum(F.col("copies") - 1).alias("removable")
    )


KEYS = f"""k AS (SELECT lang, source, key, min(doc_id) AS rep, count(*) AS copies FROM (
  SELECT doc_id, lang, source, {norm_sql('text')} AS key FROM documents) GROUP BY ALL)"""
VEC = """w AS (SELECT rep, lang, source, ' ' || w || ' ' AS w, count(*) AS k FROM (
  SELECT rep, lang, source, unnest(string_split(key, ' ')) AS w FROM k) WHERE w <> '' GROUP BY ALL),
g AS (SELECT rep, lang, source, substr(w, i::INTEGER, n::INTEGER) AS gram, sum(k)::DOUBLE AS tf
  FROM w, (VALUES (3), (4), (5)) q(n), LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i) WHERE length(w) >= n GROUP BY ALL),
d AS (SELECT lang, source, gram, count(*) AS df FROM g GROUP BY ALL),
b AS (SELECT lang, source, count(*) AS n FROM k GROUP BY ALL),
x AS (SELECT g.*, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS wt FROM g JOIN d USING (lang, source, gram) JOIN b USING (lang, source)),
v AS (SELECT rep, lang, source, gram, wt / sqrt(sum(wt * wt) OVER (PARTITION BY rep)) AS u FROM x)"""


def keyed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", text.norm(F.col("text")).alias("key"))


PAIRS = """p AS (SELECT a.rep AS a, b.rep AS b, sum(a.u * b.u) AS score
  FROM v a JOIN v b ON a.lang = b.lang AND a.source = b.source AND a.gram = b.gram AND a.rep < b.rep
  GROUP BY ALL HAVING sum(a.u * b.u) >= 0.9)"""


@query("near_dupe_pairs", WITH(KEYS, VEC, PAIRS) + "SELECT a, b, round(score, 6) AS score FROM p")
def near_dupe_pairs(spark, sf):
    pairs = dedupe.near_pairs(keyed(spark, sf), ["lang", "source"], "key", "doc_id", floor=0.9)
    return pairs.select("a", "b", r("score", 6).alias("score"))


CLUSTERS = """e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(id, other) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
root AS (SELECT id AS rep, least(id, min(other)) AS cluster FROM reach GROUP BY id),
rows AS (SELECT doc_id, lang, source, NORM AS key FROM documents),
clusters AS (SELECT rows.doc_id AS id, coalesce(root.cluster, k.rep) AS cluster FROM rows JOIN k USING (lang, source, key) LEFT JOIN root USING (rep)
  WHERE copies > 1 OR root.cluster IS NOT NULL)""".replace("NORM", norm_sql("text"))


def clusters_sql(body: str) -> str:
    return (WITH(KEYS, VEC, PAIRS, CLUSTERS) + body).replace("WITH ", "WITH RECURSIVE ", 1)


def clusters(spark, sf):
    return dedupe.near_clusters(keyed(spark, sf), ["lang", "source"], "key", "doc_id", threshold=0.9)


@query("near_dupe_clusters", clusters_sql("SELECT id, cluster FROM clusters"))
def near_dupe_clusters(spark, sf):
    return clusters(spark, sf)


@query(
    "dupes_removed",
    clusters_sql("""SELECT source, count(*) AS n, count(*) FILTER (id IS NOT NULL AND id <> cluster) AS removable
FROM documents LEFT JOIN clusters ON id = doc_id GROUP BY source"""),
)
def dupes_removed(spark, sf):
    gone = dedupe.removable(clusters(spark, sf)).select(F.col("id").alias("doc_id"), F.lit(1).alias("gone"))
    docs = table(spark, sf, "documents").select("doc_id", "source").join(gone, "doc_id", "left")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("gone").alias("removable"))


SCORED = """scored AS (SELECT doc_id, quality = 1 AS same, 0.5::DOUBLE + (n_chars % 101) / 200.0::DOUBLE AS score
  FROM documents JOIN labels USING (doc_id))"""


@query(
    "threshold_table",
    WITH(SCORED)
    + """, c AS (SELECT t::DOUBLE AS threshold, count(*) FILTER (same AND score >= t) AS tp, count(*) FILTER (NOT same AND score >= t) AS fp,
    count(*) FILTER (same AND score < t) AS fn FROM scored, (VALUES (0.70), (0.75), (0.80), (0.85), (0.90), (0.95), (0.98)) q(t) GROUP BY t),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE AS f1 FROM m)
SELECT threshold, tp, fp, fn, round(p, 4) AS "precision", round(r, 4) AS recall, round(f1, 4) AS f1,
  row_number() OVER (ORDER BY p >= 0.95 DESC, f1 DESC, threshold) = 1 AS chosen FROM f""",
)
def threshold_table(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    scored = d.select((F.col("quality") == 1).alias("same"), (F.lit(0.5) + (F.col("n_chars") % 101) / F.lit(200.0)).alias("score"))
    out = dedupe.tune(scored)
    return out.select("threshold", "tp", "fp", "fn", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "chosen")


LABELLED = f"""r AS (SELECT doc_id, d.lang, d.source, d.key, rep FROM (SELECT doc_id, lang, source, {norm_sql('text')} AS key FROM documents) d JOIN k USING (lang, source, key)),
lab AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS b FROM r UNION SELECT doc_id, doc_id + 1 FROM r),
both_ AS (SELECT x.rep AS xr, y.rep AS yr, x.lang = y.lang AND x.source = y.source AS together, left(x.key, 40) = left(y.key, 40) AS same FROM lab JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b),
dots AS (SELECT p.lo, p.hi, sum(x.u * y.u) AS dot FROM (SELECT DISTINCT least(xr, yr) AS lo, greatest(xr, yr) AS hi FROM both_ WHERE together AND xr <> yr) p JOIN v x ON x.rep = p.lo JOIN v y ON y.rep = p.hi AND y.gram = x.gram GROUP BY ALL),
scored AS (SELECT same, CASE WHEN NOT together THEN 0 WHEN xr = yr THEN 1 ELSE coalesce(dot, 0) END::DOUBLE AS score FROM both_ LEFT JOIN dots ON lo = least(xr, yr) AND hi = greatest(xr, yr))"""


@query(
    "threshold_table_pairs",
    WITH(KEYS, VEC, LABELLED)
    + """, c AS (SELECT t::DOUBLE AS threshold, count(*) FILTER (same AND score >= t) AS tp, count(*) FILTER (NOT same AND score >= t) AS fp,
    count(*) FILTER (same AND score < t) AS fn FROM scored, (VALUES (0.70), (0.75), (0.80), (0.85), (0.90), (0.95), (0.98)) q(t) GROUP BY t),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE AS f1 FROM m)
SELECT threshold, tp, fp, fn, round(p, 4) AS "precision", round(r, 4) AS recall, round(f1, 4) AS f1,
  row_number() OVER (ORDER BY p >= 0.95 DESC, f1 DESC, threshold) = 1 AS chosen FROM f""",
)
def threshold_table_pairs(spark, sf):
    """Neighbouring documents of a block, and neighbours by number of any block, told the same by how they begin."""
    d = keyed(spark, sf)
    heads = written(d.select("doc_id", "lang", "source", F.left(F.col("key"), F.lit(40)).alias("head")))
    after = F.lead("doc_id").over(Window.partitionBy("lang", "source").orderBy("doc_id"))  # documents of one block
    pairs = heads.select(F.col("doc_id").alias("a"), after.alias("b")).unionByName(heads.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))).distinct()
    head = lambda x: heads.select(F.col("doc_id").alias(x), F.col("head").alias(f"{x}_head"))
    labelled = pairs.join(head("a"), "a").join(head("b"), "b").select("a", "b", (F.col("a_head") == F.col("b_head")).alias("same"))
    out = dedupe.tune(dedupe.score_labelled(d, ["lang", "source"], "key", "doc_id", labelled))
    return out.select("threshold", "tp", "fp", "fn", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "chosen")


@query(
    "strip_html",
    r"""SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id,
  replace(replace(replace(replace(regexp_replace(replace(html, '<p>', chr(10)), '<[^>]+>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS t FROM pages)""",
)
def strip_html(spark, sf):
    t = text.strip_html(F.col("html"))
    df = table(spark, sf, "pages").select("page_id", t.alias("t"))
    return df.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"))


PAYTEXT = """paytext AS (SELECT o_orderkey AS id, o_orderpriority AS kind, CASE o_orderpriority
    WHEN '1-URGENT' THEN '$' || printf('%d', floor(o_totalprice)::BIGINT // 1000) || 'k - $' || printf('%d', floor(o_totalprice)::BIGINT // 1000 + 5) || 'K per year'
    WHEN '2-HIGH' THEN 'about ' || printf('%d', floor(o_totalprice)::BIGINT % 150) || '-' || printf('%d', floor(o_totalprice)::BIGINT % 150 + 20) || 'k CAD, full-time'
    WHEN '3-MEDIUM' THEN '£' || printf('%d', floor(o_totalprice)::BIGINT % 90) || ' – £' || printf('%d', floor(o_totalprice)::BIGINT % 100) || ' / hour'
    WHEN '4-NOT SPECIFIED' THEN '€' || printf('%d', floor(o_totalprice)::BIGINT) || ' - ' || printf('%d', floor(o_totalprice)::BIGINT + 900) || ' monthly'
    ELSE '2-3 days per week' END AS t, floor(o_totalprice)::BIGINT AS n FROM orders)"""


def paytext(spark, sf):
    n = F.floor("o_totalprice")
    t = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.format_string("$%dk - $%dK per year", F.floor(n / 1000), F.floor(n / 1000) + 5))
        .when(F.col("o_orderpriority") == "2-HIGH", F.format_string("about %d-%dk CAD, full-time", n % 150, n % 150 + 20))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.format_string("£%d – £%d / hour", n % 90, n % 100))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.format_string("€%d - %d monthly", n, n + 900))
        .otherwise("2-3 days per week")
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), t.alias("t"))


@query(
    "parse_pay",
    WITH(PAYTEXT)
    + """, v AS (SELECT id, kind, t, CASE kind WHEN '1-URGENT' THEN n // 1000 * 1000 WHEN '2-HIGH' THEN n % 150 * 1000 WHEN '3-MEDIUM' THEN n % 90 WHEN '4-NOT SPECIFIED' THEN n END AS lo,
  CASE kind WHEN '1-URGENT' THEN (n // 1000 + 5) * 1000 WHEN '2-HIGH' THEN (n % 150 + 20) * 1000 WHEN '3-MEDIUM' THEN n % 100 WHEN '4-NOT SPECIFIED' THEN n + 900 END AS hi FROM paytext)
SELECT id, lo::DOUBLE AS min, hi::DOUBLE AS max, CASE kind WHEN '1-URGENT' THEN 'USD' WHEN '2-HIGH' THEN 'CAD' WHEN '3-MEDIUM' THEN 'GBP' ELSE 'EUR' END AS currency,
  CASE kind WHEN '3-MEDIUM' THEN 'hour' WHEN '4-NOT SPECIFIED' THEN 'month' ELSE 'year' END AS period, t AS raw_text
FROM v WHERE lo > 0 AND hi >= 12 AND lo <= hi""",
)
def parse_pay(spark, sf):
    df = paytext(spark, sf).select("id", text.parse_pay(F.col("t")).alias("p")).filter("p IS NOT NULL")
    return df.select("id", "p.min", "p.max", "p.currency", "p.period", "p.raw_text")


@query(
    "fix_period",
    """SELECT o_orderpriority AS tag, CASE WHEN o_orderpriority <> '5-LOW' AND o_totalprice / 2000 < 100 AND o_orderstatus <> 'P' AND o_totalprice > 0 THEN 'hour' ELSE 'year' END AS period,
  count(*) AS n FROM orders GROUP BY ALL""",
)
def fix_period(spark, sf):
    o = table(spark, sf, "orders")
    pay = F.struct(
        (F.col("o_totalprice") / 4000).alias("min"), (F.col("o_totalprice") / 2000).alias("max"),
        F.when(F.col("o_orderpriority") == "5-LOW", "EUR").otherwise("USD").alias("currency"), F.lit("year").alias("period"),
        F.when(F.col("o_orderstatus") == "P", "$0.5k").otherwise("$30 - $50").alias("raw_text"),
    )
    fixed = o.select("o_orderpriority", text.fix_period(pay).alias("p"))
    return fixed.groupBy(F.col("o_orderpriority").alias("tag"), "p.period").agg(F.count(F.lit(1)).alias("n"))


PLACES = """Austin|Seattle, WA|Atlanta, Georgia|Milwaukee|Berlin, Germany|London|Remote - U.S.|King of Prussia, PA|Toronto, Canada|CA - Toronto|São Paulo|Kyiv, Ukraine|
Dublin|gbr|UK|Singapore|New York City|Zürich|Türkiye|Unknown place|Oslo, Norway|Perth|Tel Aviv|Malmö|Bogotá"""
PLACE_LIST = [p.strip() for p in PLACES.replace("\n", "").split("|")]
PLACE_CODES = ["US", "US", "US", "-", "DE", "GB", "US", "US", "CA", "US", "BR", "UA", "IE", "GB", "GB", "SG", "US", "CH", "TR", "-", "NO", "AU", "IL", "SE", "CO"]


@query(
    "country_from_location",
    "WITH place(k, place, code) AS (VALUES "
    + ", ".join(f"({i}, '{p}', {'NULL' if c == '-' else repr(c)})" for i, (p, c) in enumerate(zip(PLACE_LIST, PLACE_CODES)))
    + """) SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN place ELSE place || ' (' || c_name || ')' END AS location,
  CASE WHEN c_custkey % 2 = 1 AND place IN ('gbr') THEN NULL ELSE code END AS country FROM customer JOIN place ON k = c_nationkey""",
)
def country_from_location(spark, sf):
    names = F.array(*[F.lit(p) for p in PLACE_LIST])
    c = table(spark, sf, "customer")
    place = F.get(names, F.col("c_nationkey"))
    loc = F.when(F.col("c_custkey") % 2 == 0, place).otherwise(F.concat(place, F.lit(" ("), "c_name", F.lit(")")))
    return c.select("c_custkey", loc.alias("location")).withColumn("country", geo.country_from_location(F.col("location")))


@query(
    "to_iso2",
    """SELECT label, CASE label WHEN 'NATION_0' THEN NULL WHEN ' us ' THEN 'US' WHEN 'swe' THEN 'SE' WHEN 'Great Britain' THEN 'GB' WHEN 'EL' THEN NULL
  WHEN 'United Arab Emirates' THEN 'AE' END AS iso2, n FROM (
  SELECT CASE c_custkey % 6 WHEN 0 THEN ' us ' WHEN 1 THEN 'swe' WHEN 2 THEN 'Great Britain' WHEN 3 THEN 'EL' WHEN 4 THEN 'United Arab Emirates' ELSE 'NATION_' || c_nationkey END AS label,
    count(*) AS n FROM customer GROUP BY 1)""",
)
def to_iso2(spark, sf):
    k = F.col("c_custkey") % 6
    label = (
        F.when(k == 0, " us ").when(k == 1, "swe").when(k == 2, "Great Britain").when(k == 3, "EL").when(k == 4, "United Arab Emirates")
        .otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    )
    df = table(spark, sf, "customer").select(label.alias("label"), geo.to_iso2(label).alias("iso2"))
    return df.groupBy("label", "iso2").agg(F.count(F.lit(1)).alias("n"))


@query(
    "posting_filter",
    WITH(POSTING)
    + """, t AS (SELECT p.*, 'Senior ' || segment || ' Engineer' AS title, CASE status WHEN 'F' THEN true WHEN 'O' THEN false END AS remote FROM posting p)
SELECT id, country, title FROM t WHERE country = 'NATION_3' AND remote AND title ILIKE '%build%'""",
)
def posting_filter(spark, sf):
    p = postings(spark, sf).withColumn("title", F.concat(F.lit("Senior "), "segment", F.lit(" Engineer")))
    p = p.withColumn("remote", F.when(F.col("status") == "F", True).when(F.col("status") == "O", False))
    return plan.filter_postings(p, country="NATION_3", level="senior", remote=True, q=" Build ").select("id", "country", "title")


TITLES = """titles AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'Intern, ' WHEN 1 THEN 'Principal ' WHEN 2 THEN 'VP of ' WHEN 3 THEN 'Sr. ' WHEN 4 THEN 'Jr ' WHEN 5 THEN 'International '
  WHEN 6 THEN 'Senior Staff ' ELSE '' END || p_name || CASE WHEN p_size % 16 >= 8 THEN ' III' ELSE '' END AS title FROM part)"""


def titles(spark, sf):
    s = F.col("p_size") % 8
    words = ["Intern, ", "Principal ", "VP of ", "Sr. ", "Jr ", "International ", "Senior Staff ", ""]
    head = F.get(F.array(*[F.lit(w) for w in words]), s)
    tail = F.when(F.col("p_size") % 16 >= 8, " III").otherwise("")
    return table(spark, sf, "part").select("p_partkey", F.concat(head, "p_name", tail).alias("title"))


@query(
    "level_census",
    WITH(TITLES)
    + r"""SELECT CASE WHEN regexp_matches(t, '\bintern(ship)?\b') THEN 'intern' WHEN regexp_matches(t, '\b(staff|principal|distinguished|director|head of|vp\b)') THEN 'staff+'
  WHEN regexp_matches(t, '\b(senior|sr|lead|iii|l3|l4)\b') THEN 'senior' WHEN regexp_matches(t, '\b(junior|jr|entry|graduate|new grad|associate|i)\b') THEN 'junior' END AS level, count(*) AS n
FROM (SELECT lower(title) AS t FROM titles) GROUP BY 1""",
)
def level_census(spark, sf):
    return titles(spark, sf).groupBy(text.level_of_title(F.col("title")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


WORDS = ("the", "and", "der", "que", "email", "license")


@query(
    "keyword_census",
    "SELECT lang, " + ", ".join(f"count(*) FILTER (contains(lower(text), '{w}')) AS has_{w}" for w in WORDS) + " FROM documents GROUP BY lang",
)
def keyword_census(spark, sf):
    return stats.keyword_census(table(spark, sf, "documents"), ["lang"], "text", WORDS).drop("n")


@query(
    "company_label",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE (CASE WHEN length(a) <= 3 THEN upper(a) ELSE upper(a[1]) || a[2:] END) || ' ' || upper(b[1]) || b[2:]
    || ' ' || CASE WHEN length(k) <= 3 THEN upper(k) ELSE upper(k[1]) || k[2:] END END AS label
FROM (SELECT *, lower(left(c_mktsegment, c_nationkey % 6 + 1)) AS a, 'nation' AS b, c_nationkey::VARCHAR AS k FROM customer)""",
)
def company_label(spark, sf):
    slug = F.concat(
        F.lower(F.expr("left(c_mktsegment, c_nationkey % 6 + 1)")), F.lit("--nation_"), F.col("c_nationkey").cast("string")
    )
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.company_label(name, slug).alias("label"))


@query(
    "fake_nulls",
    """SELECT lower(trim(v)) IN ('n/a', 'na', 'none', 'null', 'unknown', 'tbd', '-', '') AS fake, v, count(*) AS n FROM (
  SELECT CASE c_custkey % 5 WHEN 0 THEN ' N/A' WHEN 1 THEN 'Unknown' WHEN 2 THEN '' WHEN 3 THEN 'none given' ELSE c_mktsegment END AS v FROM customer) GROUP BY ALL""",
)
def fake_nulls(spark, sf):
    k = F.col("c_custkey") % 5
    v = F.when(k == 0, " N/A").when(k == 1, "Unknown").when(k == 2, "").when(k == 3, "none given").otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").groupBy(text.is_fake_null(v).alias("fake"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_clean",
    """SELECT lower(trim(v)) AS token, min(k) AS first_at FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '  ' || c_mktsegment WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment)
  WHEN c_custkey % 4 = 2 THEN '   ' ELSE c_name END AS v FROM customer) WHERE trim(v) <> '' GROUP BY 1""",
)
def token_clean(spark, sf):
    from paylens.operators.sets import clean_tokens

    k = F.col("c_custkey") % 4
    v = (
        F.when(k == 0, F.concat(F.lit("  "), "c_mktsegment")).when(k == 1, F.lower("c_mktsegment")).when(k == 2, "   ").otherwise(F.col("c_name"))
    )
    df = table(spark, sf, "customer").select(v.alias("token"), F.col("c_custkey").alias("pos"))
    return clean_tokens(df, "token", "pos").withColumnRenamed("pos", "first_at")


@query(
    "experience_bands",
    """SELECT CASE WHEN y < 3 THEN 'new_grad' WHEN y < 6 THEN 'mid' WHEN y IS NOT NULL THEN 'senior' END AS band, count(*) AS n FROM (
  SELECT CASE WHEN p_size = 1 THEN 0.5 WHEN p_size = 50 THEN 51 WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 4.0 END AS y FROM part) GROUP BY 1""",
)
def experience_bands(spark, sf):
    s = F.col("p_size")
    t = (
        F.when(s == 1, " Less than 1 year").when(s == 50, "More than 50 years").when(s % 7 == 0, "prefer not to say")
        .otherwise((s / 4).cast("string"))
    )
    return table(spark, sf, "part").groupBy(text.experience_band(t).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "suppressed_cells",
    """SELECT o_orderpriority AS mark, count(*) AS n, count(v) AS kept, round(sum(v), 2) AS total FROM (SELECT o_orderpriority,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS v FROM orders) GROUP BY 1""",
)
def suppressed_cells(spark, sf):
    k = F.col("o_orderkey") % 7
    marks = F.get(F.array(*[F.lit(m) for m in ("x", "..", "-", "/", ".")]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    plain = F.format_number("o_totalprice", 2)
    comma = F.translate(plain, ",.", ".,")
    cell = F.when(k == 0, marks).otherwise(plain)
    v = F.when(F.col("o_orderpriority") == "5-LOW", text.number(F.when(k == 0, ".").otherwise(comma), "comma")).otherwise(text.number(cell))
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("mark"), v.alias("v"))
    return df.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("kept"), r(F.sum("v"), 2).alias("total"))


@query(
    "effective_year",
    """SELECT y, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN year(o_orderdate) WHEN 'O' THEN 2024 END::INTEGER AS y FROM orders) GROUP BY 1""",
)
def effective_year(spark, sf):
    posted = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    harvest = F.when(F.col("o_orderstatus") == "O", "2024-05-01T10:00:00Z")
    return table(spark, sf, "orders").groupBy(text.effective_year(posted, harvest).alias("y")).agg(F.count(F.lit(1)).alias("n"))
