from pyspark.sql import functions as F

from paylens.plans import core, wages

BASE = "country string, mean double, median double, p10 double, p25 double, p75 double, p90 double, comparable boolean, premium_basis string, years int"


def test_golden_swedish_position(spark):
    row = spark.createDataFrame([("SE", 55500.0, 53500.0, 39600.0, 46200.0, 62600.0, 72600.0, True, "mean", 8)], BASE)
    # premium that turns the published mean into the published estimate at eight years
    curve = spark.createDataFrame([("SE", 21.0, -30.0), ("SE", 30.0, -10.5), ("SE", 39.5, 5.0)], "country string, age_midpoint double, premium_pct double")
    got = wages.position_and_estimate(row, curve, "country", "years").first()
    assert int(got["estimate"] + 0.5) == 49673 and got["premium"] == -10.5 and round(got["position"]) == 37


def test_refusals_and_unpersonalised(spark):
    rows = spark.createDataFrame(
        [("ES", None, 100.0, None, 80.0, 120.0, None, True, None, 5), ("QA", 50.0, None, None, None, None, None, True, None, 5), ("NL", 50.0, 60.0, 10.0, 20.0, 70.0, 80.0, False, None, 5), ("NO", 100.0, 100.0, 99.0, None, 101.0, None, True, "median", 50)], BASE
    )
    curve = spark.createDataFrame([("NO", 39.0, -8.31), ("NO", 47.0, 13.27)], "country string, age_midpoint double, premium_pct double")
    got = {r["country"]: r for r in wages.position_and_estimate(rows, curve, "country", "years").collect()}
    assert (got["ES"]["estimate"], got["ES"]["position"], got["ES"]["personalised"]) == (100.0, 50.0, False)
    assert got["QA"]["reason"] == "no spread to place within" and got["QA"]["estimate"] is None
    assert got["NL"]["reason"] == "not comparable" and got["NL"]["position"] is None
    assert (got["NO"]["estimate"], got["NO"]["position"], got["NO"]["clamped"]) == (101.0, 75.0, "high")


def test_exact_names_and_latest_year(spark):
    src = spark.createDataFrame([("2512", 2023, 1.0, 2.0, 9.0), ("2512", 2024, 3.0, 4.0, 8.0)], "national_code string, year int, mean_nok_month double, median_nok_month double, avtalt_mean_nok_month double")
    got = wages.extract_source(src, "salary_no").first()
    assert (got["country"], got["year"], got["mean"], got["median"], got["p10"], got["distribution"]) == ("NO", 2024, 3.0, 4.0, None, "central-tendency-only")


def test_build_wages(spark):
    schema = "country string, source_id string, national_code string, year int, period string, currency string, mean double, median double, p10 double, p25 double, p75 double, p90 double"
    obs = spark.createDataFrame(
        [
            ("SE", "salary_se", "2512", 2020, "month", "SEK", 100.0, 90.0, None, None, None, None),
            ("DK", "salary_dk", "2512", 2020, "hour", "DKK", 400.0, None, None, None, None, None),
            ("NL", "salary_nl", "0811", 2020, "hour", "EUR", 30.0, None, None, None, None, None),
            ("ES", "salary_es", "25", 2019, "year", "EUR", 30000.0, None, None, None, None, None),
        ],
        schema,
    )
    split = "struct<" + ",".join(f"{f}:double" for f in wages.FIELDS) + ">"
    comp = spark.createDataFrame(
        [("salary_se", "false", "false", None, None, None), ("salary_dk", "true", "true", ["employer_social_contributions", "irregular_bonus"], 20.0, 10.0), ("salary_nl", "unknown", "unknown", None, None, None), ("salary_es", "true", "false", None, None, None)],
        "source_id string, irregular_bonus string, employer_social_contributions string, published array<string>, part_employer_social_contributions double, part_irregular_bonus double",
    ).withColumns({"split_regular_pay": F.lit(None).cast(split), "split_total_earnings": F.lit(None).cast(split)})
    fx = spark.createDataFrame([("SE", 2020, 10.0), ("DK", 2020, 5.0)], "country string, year int, rate double")
    hours = spark.createDataFrame([("DK", 2019, 37.0)], "country string, year int, hours double")
    maps = spark.createDataFrame([("SE", "2512", "isco08:2512"), ("DK", "2512", "isco08:2512"), ("NL", "0811", "unmapped"), ("ES", "25", "isco08:25")], "country string, national_code string, shared_key string")
    table, verdicts = wages.build_wages(obs, comp, fx, hours, maps, "isco08:2512")
    got = {(r["country"], r["mode"], r["basis"]): r for r in table.collect()}
    assert got["SE", "native", "regular_pay"]["median"] == 1080.0 and got["SE", "usd", "regular_pay"]["median"] == 108.0
    assert got["SE", "usd", "total_earnings"]["ok"] is False
    assert got["DK", "native", "total_earnings"]["mean"] == 380.0 * 37 * 52 and got["DK", "usd", "regular_pay"]["mean"] == 370.0 * 37 * 52 / 5
    assert [s["op"] for s in got["DK", "usd", "total_earnings"]["chain"]] == ["subtract", "assumption", "hourly_to_weekly", "weekly_to_annual", "fx_convert"]
    assert got["NL", "native", "regular_pay"]["reason"] == "source cannot express regular_pay"
    assert got["ES", "usd", "total_earnings"]["reason"] == "no rate for ES in 2019"
    assert {r["country"]: (r["comparable"], r["resolved_depth"]) for r in verdicts.collect()} == {"SE": (True, 4), "DK": (True, 4), "ES": (False, 4), "NL": (False, 4)}
    assert wages.absent_rows(spark, {"IT": "no series"}).first()["reason"] == "no series"


def test_gradient_and_coverage(spark):
    bands = spark.createDataFrame([("SE", "tot", 100.0, None), ("SE", "a", 80.0, 21.0), ("SE", "b", 120.0, 40.0), ("SE", "c", 110.0, 60.0)], "e string, band string, v double, mid double")
    got = [(r["band"], r["premium_pct"], r["falls"]) for r in wages.experience_gradient(bands, "e", "band", "v", "tot", "mid").orderBy("mid").collect()]
    assert got == [("a", -20.0, False), ("b", 20.0, False), ("c", 10.0, True)]
    ents = spark.createDataFrame([("SE",), ("IT",), ("ES",), ("QA",)], "e string")
    w = spark.createDataFrame([("SE", True, None, 5), ("ES", False, "depth", 5), ("QA", True, None, 1)], "e string, comparable boolean, reason string, n_points int")
    out = core.coverage(ents, w, spark.createDataFrame([("SE",)], "e string"), spark.createDataFrame([("IT", "no office")], "e string, reason string"), "e")
    assert {r["e"]: (r["works"], r["personalised"], r["reason"]) for r in out.collect()} == {"SE": (True, True, None), "IT": (False, False, "no office"), "ES": (False, False, "depth"), "QA": (False, False, "no spread to rank within")}
