"""Keyed state, run history, set comparisons, streams and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paylens.functions import text
from paylens.functions.money import CURRENCY_COUNTRY
from paylens.operators import lookups, sets
from paylens.plans import core
from paylens.plans import postings as plan
from paylens.queries.common import POSTING, RATES, WITH, YEARLY, nation_years, postings, r, rates, table
from paylens.queries.registry import query
from paylens.session import ensure_checkpoint_dir
from paylens.sources import sinks
from paylens.streaming import drift, ledger


def work_folder(spark, name: str) -> str:
    """A new folder inside the session's checkpoint folder, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# A run is a day; a company is a user; it is probed on every third day on which it has any event
# or at all, and seen when it purchases that day.
RUNS = """runs AS (SELECT user_id AS key, strftime(ts, '%Y-%m-%d') AS run, bool_or(event_type = 'purchase') AS seen FROM events GROUP BY ALL)"""


def runs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("key"), F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(
        (F.max((F.col("event_type") == "purchase").cast("int")) == 1).alias("seen")
    )


# The same rules run by run: a recursive walk over the runs of each key.
LEDGER = """o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run) AS i FROM runs),
walk(key, i, live, fails, first, last_ok, times) AS (
  SELECT key, 1, seen, 0, CASE WHEN seen THEN run END, CASE WHEN seen THEN run END, 0 FROM o WHERE i = 1
  UNION ALL
  SELECT o.key, w.i + 1, CASE WHEN seen THEN true WHEN w.live AND w.fails + 1 >= 3 THEN false ELSE w.live END,
    CASE WHEN seen THEN 0 WHEN w.live THEN w.fails + 1 ELSE w.fails END, CASE WHEN seen AND NOT w.live THEN run ELSE w.first END, CASE WHEN seen THEN run ELSE w.last_ok END,
    w.times + CASE WHEN NOT seen AND w.live AND w.fails + 1 >= 3 THEN 1 ELSE 0 END
  FROM walk w JOIN o ON o.key = w.key AND o.i = w.i + 1),
ledger AS (SELECT key::VARCHAR AS key, fails::INTEGER AS consecutive_failures, last_ok AS last_seen_ok, first AS first_verified_at, times AS times_removed, NOT live AS removed
  FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1)"""


def ledger_sql(body: str) -> str:
    return (WITH(RUNS, LEDGER) + body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "ledger_merge",
    ledger_sql("SELECT key, consecutive_failures, last_seen_ok, first_verified_at, times_removed::BIGINT AS times_removed, removed FROM ledger WHERE last_seen_ok IS NOT NULL"),
)
def ledger_merge(spark, sf):
    return ledger.ledger_replay(runs(spark, sf), "key", "run", "seen")


@query(
    "ledger_one_run",
    """WITH prev AS (SELECT user_id AS token, count(*) AS jobs, max(user_id % 3)::INTEGER AS f FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), probed AS (SELECT DISTINCT user_id AS token FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
seen AS (SELECT user_id AS token, count(*) AS jobs FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type = 'purchase' GROUP BY 1)
SELECT coalesce(p.token, s.token)::VARCHAR AS token, CASE WHEN s.token IS NOT NULL THEN s.jobs ELSE p.jobs END AS job_count, CASE WHEN s.token IS NOT NULL THEN 0 WHEN b.token IS NOT NULL THEN p.f + 1 ELSE p.f END AS consecutive_failures,
  s.token IS NULL AND b.token IS NOT NULL AND p.f + 1 >= 3 AS removed FROM prev p FULL JOIN seen s ON s.token = p.token LEFT JOIN probed b ON b.token = coalesce(p.token, s.token)""",
)
def ledger_one_run(spark, sf):
    e = table(spark, sf, "events").withColumn("token", F.col("user_id").cast("string"))
    before, after = e.filter("ts < timestamp_ntz'2024-01-15 00:00:00'"), e.filter("ts >= timestamp_ntz'2024-01-15 00:00:00'")
    shape = lambda d: d.groupBy("token").agg(F.lit(None).cast("string").alias("company"), F.lit("x").alias("provider"), F.count(F.lit(1)).alias("job_count"), F.max(F.col("user_id") % 3).cast("int").alias("f"))
    state = shape(before).select("token", "company", "provider", "job_count", F.lit("2024-01-14").alias("last_seen_ok"), F.col("f").alias("consecutive_failures"), F.lit("2024-01-01").alias("first_verified_at"))
    out = ledger.ledger_merge(state, after.select("token"), shape(after.filter("event_type = 'purchase'")), "2024-01-15")
    return out.select("token", "job_count", "consecutive_failures", "removed")


@query("stream_ledger", ledger_sql("SELECT key, consecutive_failures, last_seen_ok, first_verified_at, times_removed, removed FROM ledger WHERE last_seen_ok IS NOT NULL"))
def stream_ledger(spark, sf):
    folder = work_folder(spark, "ledger")
    runs(spark, sf).write.mode("overwrite").parquet(f"{folder}/runs")
    stream = spark.readStream.schema("key string, run string, seen boolean").parquet(f"{folder}/runs")
    ledger.run_ledger(stream, f"{folder}/ledger", f"{folder}/state")
    return ledger.read_ledger(spark, f"{folder}/ledger")


@query(
    "stream_counts",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL""",
)
def stream_counts(spark, sf):
    """Closed windows only: an append stream gives a window once the watermark has passed it."""
    folder = work_folder(spark, "counts")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    drift.run_to_table(drift.windowed_counts(stream, "ts", "event_type"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("start", "event_type", "n", r("total", 2).alias("total"))


@query(
    "drift_daily",
    """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY start) AS previous FROM c)
SELECT start, event_type, n, previous, round(100 * (n - previous) / previous, 4) AS change_pct, CASE WHEN previous IS NULL THEN 'new' WHEN 100 * (n - previous) / previous < -15 AND previous >= 20 THEN 'drop'
  WHEN 100 * (n - previous) / previous < -15 THEN 'flag_small' WHEN 100 * (n - previous) / previous > 50 THEN 'growth' END AS verdict FROM p""",
)
def drift_daily(spark, sf):
    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drift.between_windows(e, "event_type").withColumn("change_pct", r("change_pct"))


@query(
    "keyed_upsert",
    WITH(POSTING)
    + """, o AS (SELECT custkey, max(posted_at) AS fetched_at, arg_max(pay, (posted_at, id)) AS pay FROM posting WHERE year < 2000 GROUP BY 1), n AS (SELECT custkey, max(posted_at) AS fetched_at, arg_max(pay, (posted_at, id)) AS pay FROM posting WHERE year >= 2000 GROUP BY 1)
SELECT coalesce(n.custkey, o.custkey) AS custkey, coalesce(n.fetched_at, o.fetched_at) AS fetched_at, coalesce(n.pay, o.pay) AS pay FROM o FULL JOIN n ON o.custkey = n.custkey ORDER BY custkey""",
)
def keyed_upsert(spark, sf):
    last = lambda d: d.groupBy("custkey").agg(F.max("posted_at").alias("fetched_at"), F.max_by("pay", F.struct("posted_at", "id")).alias("pay"))
    p = postings(spark, sf)
    return ledger.upsert_latest(last(p.filter("year < 2000")), last(p.filter("year >= 2000")), ["custkey"], "fetched_at").orderBy("custkey")


@query(
    "manifest",
    """SELECT n_name AS source_id, CASE WHEN n_regionkey = 4 THEN 'blocked' ELSE 'ok' END AS status, count(c_custkey) AS rows, count(c_custkey) = 0 AS empty FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_regionkey <> 4 GROUP BY ALL""",
)
def manifest(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    ds = n.select(F.col("n_name").alias("source_id"), F.when(F.col("n_regionkey") == 4, "blocked").otherwise("ok").alias("status"))
    facts = c.join(n.filter("n_regionkey <> 4"), c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("source_id"))
    return core.manifest(ds, facts, "source_id")


@query("snapshot_append", WITH(POSTING) + "SELECT year::VARCHAR AS run_ts, country, count(*) AS n FROM posting GROUP BY ALL")
def snapshot_append(spark, sf):
    folder = work_folder(spark, "snapshots")
    counts = postings(spark, sf).groupBy("year", "country").agg(F.count(F.lit(1)).alias("n"))
    sinks.append_snapshots(counts.select(F.col("year").cast("string").alias("run_ts"), "country", "n"), folder)
    return spark.read.schema("country string, n long, run_ts string").parquet(folder)


@query(
    "export_roundtrip",
    WITH(POSTING) + "SELECT id, country, posted_at, CASE WHEN status <> 'P' THEN company_slug END AS slug FROM posting",
)
def export_roundtrip(spark, sf):
    folder = work_folder(spark, "export")
    p = postings(spark, sf).select("id", "country", "posted_at", F.when(F.col("status") != "P", F.col("company_slug")).alias("slug"))
    sinks.export_csv(p, f"{folder}/csv")
    back = spark.read.schema("id long, country string, posted_at string, slug string").option("header", True).option("nullValue", "").csv(f"{folder}/csv")
    return back.select("id", "country", "posted_at", F.nullif("slug", F.lit("")).alias("slug"))


@query("export_json", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance, '2026-01-01' AS generated_at, 'test' AS note FROM customer")
def export_json(spark, sf):
    folder = work_folder(spark, "json")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("balance"))
    sinks.export_json(c, folder, "2026-01-01", "test")
    return spark.read.schema("c_custkey long, c_name string, balance double, generated_at string, note string").json(folder)


@query("dataset_write", "SELECT c_mktsegment AS source_id, count(*) AS n FROM customer GROUP BY 1")
def dataset_write(spark, sf):
    folder = work_folder(spark, "datasets")
    c = table(spark, sf, "customer")
    sinks.write_datasets(c, folder, "c_mktsegment", "2026-01-01")
    sinks.write_dataset(c.filter("c_mktsegment = 'BUILDING'"), folder, "BUILDING", "2026-01-01")  # written again
    return spark.read.parquet(folder).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("column_slice", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def column_slice(spark, sf):
    folder = work_folder(spark, "slice")
    sinks.write_slice(table(spark, sf, "lineitem"), ["l_suppkey"], folder)
    return spark.read.parquet(folder).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lost_keys",
    "SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) < 2000 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) >= 2000)",
)
def lost_keys(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return lookups.lost_keys(o.filter("y < 2000"), o.filter("y >= 2000"), ["o_custkey"])


@query(
    "orphans",
    """SELECT o_custkey AS k, 'orders' AS only_in FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_custkey, 'pending' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def orphans(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return lookups.orphans(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "k", "orders", "pending")


@query("duplicate_ids", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return sets.duplicate_ids(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("set_difference", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A'")
def set_difference(spark, sf):
    li = table(spark, sf, "lineitem")
    return sets.difference(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag <> 'A'"), ["l_partkey", "l_suppkey"])


@query("set_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def set_intersection(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter("l_returnflag = 'A'").select("l_partkey").intersect(li.filter("l_linestatus = 'O'").select("l_partkey"))


@query(
    "union_sources",
    """SELECT kind, count(*) AS n, count(segment) AS with_segment, round(sum(balance), 2) AS balance FROM (SELECT 'customer' AS kind, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY kind""",
)
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    d = sets.union_sources([c, s])
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("segment").alias("with_segment"), r(F.sum("balance"), 2).alias("balance"))


@query(
    "tolerance_join",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT class, count(*) AS n FROM (SELECT CASE WHEN b.v IS NULL THEN 'live_only' WHEN a.v IS NULL THEN 'stored_only' WHEN abs(a.v - b.v) <= abs(b.v) * 0.2 THEN 'match' ELSE 'mismatch' END AS class FROM a FULL JOIN b ON a.k = b.k) GROUP BY 1""",
)
def tolerance_join(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("value"))
    return lookups.reconcile(a, b, ["k"], 0.2).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_join",
    """SELECT source, CASE WHEN quality IS NULL THEN 'unclassified' ELSE quality::VARCHAR END AS class, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
)
def class_join(spark, sf):
    cls = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("class"))
    return lookups.classes_back(table(spark, sf, "documents").select("doc_id", "source"), cls, "doc_id", "class").groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "merge_classes",
    """SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN quality END, CASE WHEN doc_id % 2 = 0 THEN 9 END)::INTEGER AS occupation FROM documents LEFT JOIN labels USING (doc_id)""",
)
def merge_classes(spark, sf):
    from paylens.operators.classify import merge_classes as f

    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 9).alias("occupation"))
    new = table(spark, sf, "labels").filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("occupation"))
    return f(d, new, "doc_id", "occupation").withColumn("occupation", F.col("occupation").cast("int"))


@query(
    "rederived_pay",
    WITH(POSTING)
    + """, t AS (SELECT *, segment || ' ' || provider AS title FROM posting), gone AS (SELECT id FROM t QUALIFY row_number() OVER (PARTITION BY title, company, year ORDER BY id) > 1),
k AS (SELECT t.*, CASE WHEN segment = 'BUILDING' THEN 'SW' ELSE 'unclassified' END AS class FROM t WHERE id NOT IN (SELECT id FROM gone)),
pub AS (SELECT country, count(*) AS n_published, median(pay) AS published FROM t GROUP BY 1), ded AS (SELECT country, count(*) AS n_after_dedupe FROM k GROUP BY 1), cls AS (SELECT country, count(*) AS n_class, median(pay) AS m FROM k WHERE class = 'SW' GROUP BY 1 HAVING count(*) >= 5)
SELECT country, n_published, round(published, 4) AS published, n_after_dedupe, n_class, round(m, 4) AS median, round(100 * (m - published) / published, 4) AS delta_pct, coalesce(n_class >= 30, false) AS publishable FROM pub LEFT JOIN ded USING (country) LEFT JOIN cls USING (country)""",
)
def rederived_pay(spark, sf):
    p = postings(spark, sf).withColumn("title", F.concat_ws(" ", "segment", "provider"))
    first = p.groupBy("title", "company", "year").agg(F.min("id").alias("keep"))
    gone = p.join(first, ["title", "company", "year"]).filter("id <> keep").select("id")
    classes = p.select("title", "segment").distinct().filter("segment = 'BUILDING'").select("title", F.lit("SW").alias("class"))
    out = core.rederive_pay(p.withColumn("value", F.col("pay")), classes, gone, "country", "SW")
    return out.select("country", "n_published", r("published").alias("published"), "n_after_dedupe", "n_class", r("median").alias("median"), r("delta_pct").alias("delta_pct"), "publishable")


@query(
    "postings_usd",
    WITH(POSTING, RATES)
    + """SELECT id, round(min / rate, 8) AS usd_min, round(max / rate, 8) AS usd_max, rate AS fx_rate FROM posting JOIN nation a ON a.n_name = country JOIN nation b ON b.n_nationkey = a.n_nationkey % {k} LEFT JOIN rates r ON r.country = b.n_name AND r.year = posting.year""".replace("{k}", str(len(CURRENCY_COUNTRY))),
)
def postings_usd(spark, sf):
    """Every nation borrows a currency, in turn; a currency has the rates of the first nation that borrows it."""
    names = list(CURRENCY_COUNTRY)
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"), F.get(F.array(*[F.lit(c) for c in names]), (F.col("n_nationkey") % len(names)).cast("int")).alias("currency"))
    p = postings(spark, sf).join(n, "country")
    shaped = p.select("id", "posted_at", F.lit(None).cast("string").alias("generated_at"), F.struct("min", "max", "currency", "period").alias("compensation"))
    fx = rates(spark, sf).join(n.filter(F.col("n_nationkey") < len(names)), "country").select(plan.fx_country(F.col("currency")).alias("country"), "year", "rate")
    out = plan.add_usd(shaped, fx)
    return out.select("id", r("usd.min", 8).alias("usd_min"), r("usd.max", 8).alias("usd_max"), "usd.fx_rate")


@query(
    "key_pairs_same_text",
    "SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY source",
)
def key_pairs_same_text(spark, sf):
    d = table(spark, sf, "documents").select("source", F.md5("text").alias("m"))
    return d.groupBy("source", "m").agg(F.count(F.lit(1)).alias("k")).groupBy("source").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("texts"))


@query(
    "blank_values",
    "SELECT c_mktsegment, count(*) FILTER (c_custkey % 4 <> 0) AS present FROM customer GROUP BY 1",
)
def blank_values(spark, sf):
    v = text.blank_to_null(F.when(F.col("c_custkey") % 4 == 0, "   ").otherwise(F.col("c_name")))
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(v).alias("present"))


@query("yearly_series", WITH(POSTING, YEARLY) + "SELECT entity, year, value, n FROM yearly")
def yearly_series(spark, sf):
    return nation_years(spark, sf)
