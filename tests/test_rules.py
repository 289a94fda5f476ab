"""Every rule fires on a spoilt row and stays quiet on a clean one."""

from pyspark.sql import functions as F

from paylens.functions import money
from paylens.operators import crosswalk, lookups, quality

FIELDS = {s: s for s in ("mean", "p10", "p25", "median", "p75", "p90")}
W = "id string, mean double, p10 double, p25 double, median double, p75 double, p90 double, label string"


def rules(df):
    return sorted((r["entity"], r["rule"], r["field"]) for r in df.collect())


def test_percentiles_mean_label_absence(spark):
    df = spark.createDataFrame(
        [("good", 5.0, 1.0, 2.0, 5.0, 7.0, 9.0, "full"), ("bad", 50.0, 1.0, 9.0, 5.0, None, 9.0, "mean-only"), ("odd", 5.0, None, None, None, None, None, "wide"), ("plain", 5.0, None, None, 5.0, None, None, "central-tendency-only")], W
    )
    assert rules(quality.check_percentiles(df, "id", FIELDS)) == [("bad", "percentiles_ordered", "p25<=median")]
    assert rules(quality.check_mean_in_range(df, "id", "mean", "p10", "p90")) == [("bad", "mean_in_range", "mean")]
    assert {(r["entity"], r["detail"]) for r in quality.check_distribution_label(df, "id", "label", FIELDS).collect()} == {("bad", "percentiles are published"), ("odd", "unknown label")}
    assert rules(quality.check_absence_explicit(df, "id", "label", FIELDS)) == [("odd", "absence_explicit", "label")]


def test_units_pay_and_magnitude(spark):
    rows = [(f"e{i}", "mean_sek_month", "", "mean", "_sek_month", 30000.0 + i * 100, "SEK", "month") for i in range(9)]
    rows += [("low", "mean_sek_month", "", "mean", "_sek_month", 4000.0, "SEK", "month"), ("huge", "mean_sek_month", "", "mean", "_sek_month", 9e6, "SEK", "month"), ("zero", "mean_sek_month", "", "mean", "_sek_month", 0.0, "SEK", "month"), ("cold", "mean_c", "", "mean", "_c", -4.0, None, None)]
    long = spark.createDataFrame(rows, "entity string, field string, prefix string, statistic string, suffix string, value double, currency string, period string")
    assert rules(quality.check_positive_pay(long, "entity")) == [("zero", "positive_pay", "mean_sek_month")]
    got = {(r["entity"], r["detail"]) for r in quality.check_magnitude(long).collect()}
    assert got == {("huge", "absolute"), ("zero", "absolute"), ("low", "relative")}
    leaves = spark.createDataFrame([("a", "total_mean", "x", None, None), ("b", "median_eur", "x", None, None), ("c", "mean", "k_eur_year", None, None), ("d", "p10", "coefficient_of_variation_pct", None, None), ("e", "mean", "x", "SEK", "month")], "entity string, field string, container string, currency string, period string")
    assert {(r["entity"], r["detail"]) for r in quality.check_unit_disclosed(leaves, "entity").collect()} == {("a", "currency and period"), ("b", "period")}


def test_embedded_identity_refresh(spark):
    h = 400.0
    m = round(h * 37 * 52 / 12, 2)
    df = spark.createDataFrame([("ok", h, m, m, 0.0), ("stale", h, m + 1, m, 0.0), ("far", h, m, m * 1.05, 0.0)], "id string, h double, c double, p double, r double")
    got = {(r["entity"], r["rule"]) for r in quality.check_embedded(df, "id", "h", "c", "p", "r").collect()}
    assert got == {("stale", "embedded_product"), ("stale", "embedded_residual"), ("far", "embedded_residual"), ("far", "embedded_bound")}
    a = spark.createDataFrame([("k", 100.0)], "k string, value double")
    b = spark.createDataFrame([("k", 16033.0)], "k string, value double")
    assert quality.check_identity(a, b, ["k"], 160.33, 0.5).first()["holds"] is True
    assert quality.check_identity(a, b.filter("false"), ["k"], 160.33, 0.5).first()["holds"] is False
    prov = spark.createDataFrame([("postings_x", "2026-01-01"), ("salary_se", "2026-01-01T10:00:00Z"), ("fx_rates", "2025-01-01"), ("bad", "soon")], "source_id string, fetched_at string")
    assert rules(quality.check_refresh(prov, "source_id", "fetched_at", "2026-03-01")) == [("fx_rates", "refresh", "fetched_at"), ("postings_x", "refresh", "fetched_at")]


def test_benchmark_statuses(spark):
    df = spark.createDataFrame([("SE", 2020, 60.0, None, True), ("ES", 2020, None, 5.0, True), ("AE", 2020, 9.0, None, True), ("CA", 2020, None, None, False), ("FI", 2019, 9.0, None, True)], "country string, year int, regular double, total double, ok boolean")
    ref = spark.createDataFrame([("SE", 2020, 40.0), ("ES", 2020, 40.0), ("CA", 2020, 40.0), ("FI", 2020, 40.0)], "country string, year int, value double")
    status = lookups.benchmark_ratio(df, ref, "country", "year", 1.0, 2.5, "ok")
    assert {r["country"]: r["status"] for r in status.collect()} == {"SE": "ok", "ES": "flagged", "AE": "exempt", "CA": "uncheckable", "FI": "no_year"}
    assert rules(quality.check_benchmark(status, "country")) == [("ES", "benchmark", "ratio"), ("FI", "benchmark", "ratio")]
    assert rules(quality.check_benchmark(status.filter("status = 'exempt'"), "country")) == [("all", "benchmark", "ratio")]


def test_annualised_band(spark):
    df = spark.createDataFrame([("a", 20.0, 30.0, "hour"), ("b", 0.1, 0.2, "hour"), ("c", 9e6, 9e6, "year"), ("d", 1.0, 1.0, "week")], "id string, usd_min double, usd_max double, period string")
    assert [e for e, _, _ in rules(quality.check_annualised(df, "id"))] == ["b", "c"]


def test_curated_and_envelope(spark):
    cities = spark.createDataFrame(
        [("a", "SE", "2026-01", ["s"], 1.0, 2.0, 3.0, "fine"), ("a", "XX", "", None, 3.0, 2.0, 1.0, "TBD"), ("b", "SE", "2026-01", ["s"], 3.0, None, 1.0, "x")],
        "id string, country string, as_of string, sources array<string>, new_grad double, mid double, senior double, note string",
    )
    countries = spark.createDataFrame([("SE", "2026", ["s"], 20.0)], "id string, as_of string, sources array<string>, net_pct double")
    got = {(e, r) for e, r, _ in rules(quality.check_curated(cities, countries))}
    assert got == {("a", "unique_id"), ("a", "as_of"), ("a", "sources"), ("a", "known_country"), ("a", "salary_bands"), ("a", "fake_null"), ("SE", "tax_range")}
    ds = spark.createDataFrame([("x", "t", True, 5), ("y", None, True, 5), ("z", "t", True, 0), ("lone", "t", True, 1)], "source_id string, generated_at string, meta_present boolean, rows int")
    pv = spark.createDataFrame([("x", "CC", ["t"], "t", "ok", None, "o"), ("y", "CC", ["t"], "t", "blocked", None, "o"), ("z", "CC", ["t"], "t", "blocked", "why", "o"), ("gone", "CC", ["t"], "t", "ok", None, "o")], "source_id string, license string, transforms array<string>, fetched_at string, status string, notes string, output string")
    got = {(e, r) for e, r, _ in rules(quality.check_envelope(ds, pv))}
    assert got == {("y", "envelope_key"), ("y", "blocked_notes"), ("y", "blocked_empty"), ("lone", "provenance"), ("gone", "orphan_provenance")}


def test_forecasts_names_and_no_series(spark):
    d = spark.createDataFrame([("f", "institutional_forecast", None, "a", "ok"), ("g", "institutional_forecast", "I", None, "blocked")], "source_id string, kind string, institution string, attribution string, status string")
    assert rules(quality.check_forecasts(d)) == [("f", "forecast_institution", "institution")]
    assert rules(quality.check_forecasts(d.filter("false"))) == [("all", "forecast_present", "kind")]
    leaves = spark.createDataFrame([("a", "x.p25_senior"), ("b", "x.senior_title"), ("c", "x.advertised_min"), ("c", "x.median_usd")], "source_id string, path string")
    assert [e for e, _, _ in rules(quality.check_seniority_names(leaves))] == ["x.p25_senior"]
    assert [e for e, _, _ in rules(quality.check_mixed_vocabulary(leaves))] == ["c"]
    other = spark.createDataFrame([("z", "y.median_usd"), ("z", "y.title")], "source_id string, path string")
    assert [e for e, _, _ in rules(quality.check_field_separation(leaves, other))] == ["median_usd"]
    assert rules(quality.check_field_separation(leaves, other, ["median_usd"])) == []
    ns = spark.createDataFrame([("a", "no_series", "no_series", "2009", ""), ("b", "no_series", "ok", None, "why"), ("c", "no_series", "no_series", None, " "), ("d", "ok", "ok", None, None)], "source_id string, status string, meta_status string, evidence_date string, explanation string")
    assert {(e, r) for e, r, _ in rules(quality.check_no_series(ns))} == {("b", "no_series_status"), ("c", "no_series_evidence")}


def test_chains(spark):
    df = spark.createDataFrame([("a", 100.0, 38.0, 2.0, 2020), ("b", 100.0, 38.0, 2.0, 2020)], "id string, v double, h double, r double, year int")
    ann = money.annualise(F.col("v"), F.lit("hour"), F.col("h"), F.lit("SE"))
    df = df.withColumn("x", ann)
    df = df.withColumn("u", money.then(F.col("x"), money.convert_at(F.col("x.value"), F.col("r"), F.lit("SE"), F.when(F.col("id") == "b", 2021).otherwise(F.col("year")))))
    d = df.select("id", "year", F.col("v").alias("start"), (F.col("u.value") * F.when(F.col("id") == "b", 1.1).otherwise(1.0)).alias("value"), F.col("u.chain").alias("chain"))
    assert d.filter("id = 'a'").first()["value"] == 100 * 38 * 52 / 2
    assert [e for e, _, _ in rules(quality.recompute_chain(d, "id"))] == ["b"]
    assert [e for e, _, _ in rules(quality.check_fx_year(d, "id", "year"))] == ["b"]
    h = spark.createDataFrame([("SE", "hour", None), ("ZZ", "hour", None), ("YY", "hour", 37.0), ("XX", "year", None)], "country string, period string, own_hours double")
    assert [e for e, _, _ in rules(quality.check_hours_sourced(h, spark.createDataFrame([("SE",)], "country string"), "country"))] == ["ZZ"]
    s = spark.createDataFrame([("a", True, 1.0, 2020, "w", ["x"]), ("b", True, None, 2020, "w", []), ("c", False, None, None, None, None)], "id string, ok boolean, fx_rate double, fx_year int, fx_source string, chain array<string>")
    assert {(e, f) for e, _, f in rules(quality.check_self_describe(s, "id"))} == {("b", "fx_rate"), ("b", "chain")}


def test_reconcile_and_status(spark):
    live = spark.createDataFrame([("a", "m", 100.0), ("b", "m", 100.0), ("c", "m", 1.0), ("z", "m", 1.0)], "code string, field string, value double")
    stored = spark.createDataFrame([("a", "m", 100.4), ("b", "m", 102.0), ("d", "m", 1.0), ("z", "m", 0.0)], "code string, field string, value double")
    got = {(r["entity"], r["detail"], r["severity"]) for r in quality.check_reconcile(live, stored, ["code", "field"]).collect()}
    assert got == {("b:m", "mismatch", "error"), ("z:m", "mismatch", "error"), ("c:m", "live_only", "flag"), ("d:m", "stored_only", "flag")}
    none = quality.check_reconcile(live.filter("false"), stored.filter("false"), ["code", "field"])
    assert [r["detail"] for r in none.collect()] == ["nothing was compared"]
    exp = spark.createDataFrame([("a", True)], "rule string, ran boolean")
    quiet = none.filter("false")
    assert quality.overall_status(quiet, exp).first()["status"] == "PASSING"
    assert quality.overall_status(none, exp).first()["status"] == "PASSING"
    assert quality.overall_status(quiet, exp.selectExpr("rule", "false AS ran")).first()["status"] == "FAILING"


def test_drift(spark):
    s = "scope string, key string, rows long, stated_pay long"
    prev = spark.createDataFrame([("source", "salary_se", 100, 0), ("source", "postings_x", 100, 0), ("source", "gdp", 100, 0), ("overall", "all", 100, 50), ("country", "SE", 100, 0), ("country", "QA", 10, 0), ("provider", "p", 100, 0)], s)
    cur = spark.createDataFrame([("source", "salary_se", 60, 0), ("source", "postings_x", 300, 0), ("source", "gdp", 200, 0), ("source", "new", 5, 0), ("overall", "all", 100, 40), ("country", "SE", 84, 0), ("country", "QA", 5, 0), ("provider", "p", 90, 0)], s)
    got = {(r["entity"], r["field"], r["severity"]) for r in quality.drift(cur, prev).collect()}
    assert got == {("source:salary_se", "drop", "drop"), ("source:gdp", "growth", "flag"), ("source:new", "new", "flag"), ("overall:all", "pay_rate", "drop"), ("country:SE", "drop", "drop"), ("country:QA", "drop", "flag")}


def test_crosswalk(spark):
    rows = [("SE", "2512", "isco08:2512"), ("GB", "2134", "isco08:2512"), ("ES", "it", "isco08:25"), ("IE", "2", "isco08:2"), ("NL", "0811", "unmapped"), ("XX", "1", "isco08:2513")]
    df = spark.createDataFrame(rows, "country string, code string, key string")
    v = df.select("country", crosswalk.compare(F.lit("isco08:2512"), F.col("key"), F.lit("SE"), F.col("country")).alias("v")).select("country", "v.*")
    got = {r["country"]: (r["comparable"], r["depth"], r["degraded_by"]) for r in v.collect()}
    assert got["GB"] == (True, 4, None) and got["ES"] == (True, 2, "ES forces 4 digits down to 2") and got["IE"][1] == 1
    assert got["NL"][0] is False and got["XX"][0] is False
    pairs = {(r["depth"], r["deeper_side"]): r["pairs"] for r in crosswalk.comparable_pair_counts(df, "key").collect()}
    assert pairs == {(4, 4): 1, (2, 4): 3, (1, 2): 1, (1, 4): 3}
    one = spark.createDataFrame([("s", "CA-1", "CA", 4), ("s", "CA-2", "CA", 4), ("s", "ES", "ES", 2), ("s", "FI", "FI", 2), ("s", "NL", "NL", None)], "g string, label string, base string, d int")
    got = {r["label"]: (r["comparable"], r["resolved_depth"]) for r in crosswalk.resolve_set(one, ["g"], "label", "base", "d").collect()}
    assert got == {"CA-1": (False, 2), "CA-2": (False, 2), "ES": (True, 2), "FI": (True, 2), "NL": (False, 2)}
    notes = spark.createDataFrame([("SE", "1", "short"), ("SE", "2", "ab " * 20), ("SE", "3", "This is TODO text that is long enough to be taken as evidence"), ("SE", "4", "The national definition lists the same duties as the unit group")], "country string, national_code string, note string")
    assert {(r["entity"], r["rule"]) for r in crosswalk.note_findings(notes).collect()} == {("SE/1", "short"), ("SE/2", "few_characters"), ("SE/3", "placeholder")}


def test_flatten_leaves_collapses_arrays(spark):
    df = spark.createDataFrame([("a", '{"x":{"y":[1,2,{"z":"q"}]},"id":7}'), ("b", "not json")], "k string, doc string")
    got = sorted((r["path"], r["value"]) for r in quality.flatten_leaves(df, ["k"], "doc").collect())
    assert got == [("id", "7"), ("x.y[]", "1"), ("x.y[]", "2"), ("x.y[].z", "q")]
    leaves = quality.flatten_leaves(df, ["k"], "doc")
    assert "id" not in {r["path"] for r in quality.measured(leaves).collect()}
