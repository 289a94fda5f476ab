import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.functions import geo, maths, money, text
from paylens.operators import quantiles
from paylens.operators.grams import explode_grams


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first()["y"]


def many(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_pay_reads_ranges(spark):
    texts = [
        "$155,000 - $165,000 per year", "£40k-£55k", "$211.4K – $290.6K • Offers Equity", "160-170K CAD",
        "hybrid, 2-3 days/week | $160-170K CAD", "€30-€40 per hour", "£2,000 - £3,000 monthly",
    ]
    got = [(r["min"], r["max"], r["currency"], r["period"]) for r in many(spark, texts, text.parse_pay)]
    assert got == [
        (155000.0, 165000.0, "USD", "year"),
        (40000.0, 55000.0, "GBP", "year"),
        (211400.0, 290600.0, "USD", "year"),
        (160000.0, 170000.0, "CAD", "year"),
        (160000.0, 170000.0, "CAD", "year"),
        (30.0, 40.0, "EUR", "hour"),
        (2000.0, 3000.0, "GBP", "month"),
    ]


def test_parse_pay_refuses(spark):
    texts = ["2-3 days per week", "$2-$3 bonus", "$90k-$80k", "competitive", "", None, "$1.2.3-$4", "$0-$50k"]
    assert many(spark, texts, text.parse_pay) == [None] * len(texts)


def test_fix_period_only_for_hour_shaped_dollars(spark):
    rows = [
        (30.0, 50.0, "USD", "year", "$30 - $50"),
        (500.0, 700.0, "USD", "year", "$500 - $700"),
        (42.0, 46.0, "EUR", "year", "42-46 EUR"),
        (0.5, 0.9, "USD", "year", "$0.5k - $0.9k"),
        (30.0, 50.0, "USD", "month", "$30"),
    ]
    df = spark.createDataFrame(rows, "min double, max double, currency string, period string, raw_text string")
    fixed = df.select(text.fix_period(F.struct(*df.columns)).alias("p")).select("p.period").collect()
    assert [r[0] for r in fixed] == ["hour", "year", "year", "year", "month"]


def test_norm_drops_form_not_identity(spark):
    got = many(spark, ["Sales Associate (Part-Time)", "Sénior  Dev — Full time, REMOTE!", "newest new", None], text.norm)
    assert got == ["sales associate", "sénior dev", "newest", ""]


def test_word_grams_stop_at_word_length(spark):
    df = spark.createDataFrame([(" a ",), (" abc ",)], "w string")
    got = [(r["w"], r["gram"]) for r in explode_grams(df.withColumn("p", F.col("w")), "p", 3, 5, "w").collect()]
    assert [g for w, g in got if w == " a "] == [" a "]
    assert sorted(g for w, g in got if w == " abc ") == sorted([" ab", "abc", "bc ", " abc", "abc ", " abc "])


def test_strip_html(spark):
    got = many(
        spark,
        ["a<p>b<i>c</i>", "5 &lt; 6 &amp;&amp; 7", "&#x2F;hr &#8364;5", "&#128512; ok", "&#zz; &#xD800;", "&amp;lt;"],
        text.strip_html,
    )
    assert got == ["a\nbc", "5 < 6 && 7", "/hr €5", "😀 ok", "&#zz; &#xD800;", "&lt;"]


def test_numbers_with_suppression_marks(spark):
    assert many(spark, ["1,234.5", "x", "..", "-", "/", ".", " 7 ", ""], text.number) == [1234.5, None, None, None, None, None, 7.0, None]
    assert many(spark, ["1.234,5", "3,0"], lambda c: text.number(c, "comma")) == [1234.5, 3.0]
    assert many(spark, ["(12)", "12"], lambda c: text.number(c, "paren")) == [None, 12.0]


def test_levels_and_bands(spark):
    titles = ["Software Engineering Intern", "Staff Engineer", "VP of Sales", "Senior Dev", "Jr. Dev", "Engineer I", "International Dev", None]
    assert many(spark, titles, text.level_of_title) == ["intern", "staff+", "staff+", "senior", "junior", "junior", None, None]
    assert many(spark, ["Less than 1 year", "2", "5.5", "6", "More than 50 years", "x"], text.experience_band) == [
        "new_grad", "new_grad", "mid", "senior", "senior", None,
    ]


def test_field_family_and_units(spark):
    fams = many(spark, ["mean_sek_month", "annual_p50_usd", "p10_low_cad_hour", "median_ci95_margin", "title"], text.field_family)
    assert [tuple(f) if f else None for f in fams] == [
        ("", "mean", "_sek_month"), ("annual_", "median", "_usd"), ("", "p10", "_cad_hour"), None, None,
    ]
    df = spark.createDataFrame(
        [("mean_sek_month", "x", "USD", "year"), ("mean", "age_bands_eur_year", None, None), ("median_usd", "x", "CAD", "year"), ("total_mean", "x", None, None)],
        "n string, k string, c string, p string",
    )
    cur, per = text.resolve_unit(F.col("n"), F.col("k"), (F.col("c"), F.col("p")))
    assert [tuple(r) for r in df.select(cur, per).collect()] == [("SEK", "month"), ("EUR", "year"), ("USD", "year"), (None, None)]


def test_country_resolution(spark):
    places = {
        "Atlanta, Georgia": "US", "Milwaukee, Wisconsin": "US", "Milwaukee": None, "Kyiv, Ukraine": "UA",
        "King of Prussia, PA": "US", "China Lake, California": "US", "Albuquerque, New Mexico": "US",
        "U.S. Remote": "US", "UK": "GB", "gbr": "GB", "the netherlands": "NL", "São Paulo": "BR", "Berlin": "DE",
        "London, United Kingdom": "GB", "CA - Toronto": "US", "Remote": None, "Türkiye": "TR", "New  York": None,
        "Zürich": "CH", "Greater Boston area": "US", "": None,
    }
    assert many(spark, list(places), geo.country_from_location) == list(places.values())
    assert many(spark, ["France", "us", "EL", "Czechia", None], geo.to_iso2) == [None, "US", None, None, None]


def test_company_label(spark):
    df = spark.createDataFrame([("Ramp", "ramp"), (None, "3y-health"), (None, "air_ops--co")], "c string, s string")
    assert [r[0] for r in df.select(text.company_label(F.col("c"), F.col("s"))).collect()] == ["Ramp", "3Y Health", "AIR OPS CO"]


def test_annualise_and_convert(spark):
    rows = [(10.0, "hour", 38.0), (10.0, "hour", None), (100.0, "month", None), (5.0, "year", None), (5.0, "week", 38.0)]
    df = spark.createDataFrame(rows, "v double, p string, h double")
    got = df.select(money.annualise(F.col("v"), F.col("p"), F.col("h"), F.lit("DK")).alias("r")).select("r.*").collect()
    assert [r["value"] for r in got] == [10 * 38 * 52, None, 1200.0, 5.0, None]
    assert [r["ok"] for r in got] == [True, False, True, True, False]
    assert [s["op"] for s in got[0]["chain"]] == ["hourly_to_weekly", "weekly_to_annual"]
    df = spark.createDataFrame([(10.0, 2.0), (10.0, None)], "v double, r double")
    got = df.select(money.convert_at(F.col("v"), F.col("r"), F.lit("SE"), F.lit(2020)).alias("x")).select("x.*").collect()
    assert got[0]["value"] == 5.0 and got[1]["reason"] == "no rate for SE in 2020"


def test_override_subtract_and_bases(spark):
    df = spark.createDataFrame(
        [(33.6, "own", True, 40.8), (None, "own", True, 40.8), (None, None, False, 40.8)], "g double, s string, has boolean, t double"
    )
    got = df.select(money.override_hours(F.col("g"), F.col("s"), F.col("has"), F.col("t"))).collect()
    assert [r[0] for r in got] == [33.6, None, 40.8]
    df = spark.createDataFrame([(10.0, ["pension_total"], 2.0), (10.0, [], 2.0), (10.0, None, 2.0)], "v double, p array<string>, c double")
    got = df.select(money.subtract_component(F.col("v"), F.col("p"), F.lit("pension"), F.col("c")).alias("r")).select("r.*").collect()
    assert [r["value"] for r in got] == [8.0, None, None]
    df = spark.createDataFrame(
        [("a", "false", "false"), ("b", "true", "false"), ("c", "unknown", "false"), ("salary_uk", "true (annual)", "false"), ("d", "true", "true")],
        "s string, b string, c string",
    )
    got = [r[0] for r in df.select(money.bases(F.col("s"), F.col("b"), F.col("c"))).collect()]
    assert got == [["regular_pay"], ["total_earnings"], [], ["total_earnings"], []]


def test_distribution_functions(spark):
    zs = spark.createDataFrame([(-1.96,), (0.0,), (1.0,)], "z double")
    got = [r[0] for r in zs.select(maths.normal_cdf(F.col("z"))).collect()]
    want = [0.5 * (1 + math.erf(z / math.sqrt(2))) for z in (-1.96, 0.0, 1.0)]
    assert np.allclose(got, want, atol=1e-6)
    assert maths.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    assert maths.chi2_quantile(0.975, 9) == pytest.approx(19.0228, abs=1e-3)
    x = spark.createDataFrame([(16.919,)], "x double")
    assert x.select(maths.chi2_tail(F.col("x"), 9)).first()[0] == pytest.approx(0.05, abs=1e-4)
    assert x.select(maths.chi2_tail(F.col("x"), 4)).first()[0] == pytest.approx(0.00200, abs=1e-4)
    assert one(spark, 2.5, lambda c: maths.round_up_half(c), "double") == 3.0
    assert one(spark, -2.5, lambda c: maths.round_up_half(c), "double") == -2.0


def test_group_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in np.round(rng.lognormal(11, 0.6, 4000), 2)]
    rows += [("same", 7.0)] * 50 + [("neg", float(x)) for x in rng.normal(0, 3, 301)] + [("one", 1.5), (None, 2.0), (None, 4.0), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q1": 0.25, "med": 0.5, "p90": 0.9}
    got = {r["g"]: r for r in quantiles.group_quantiles(df, ["g"], "v", probs).collect()}
    for g in ("hot", "same", "neg", "one", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g]["n"] == len(v)
        assert np.allclose([got[g][k] for k in probs], np.percentile(v, [25, 50, 90]))


def test_exclusive_quartiles_match_statistics(spark):
    import statistics

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(50, 9, 37).tolist(), "b": [3.0, 1.0, 2.0, 9.0], "c": [5.0, 6.0]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, v double")
    res = quantiles.group_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}, method="exclusive")
    for r in res.collect():
        assert np.allclose([r["a"], r["b"], r["c"]], statistics.quantiles(groups[r["g"]], n=4))


def test_rank_table_average_ranks(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(0, 4, 500), 0).tolist()
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r["v"]: r["avg_rank"] for r in quantiles.rank_table(df, ["g"], "v").collect()}
    ordered = sorted(values)
    for v in set(values):
        want = np.mean([i + 1 for i, x in enumerate(ordered) if x == v])
        assert got[v] == pytest.approx(want)


def test_word_edges_know_accented_letters(spark):
    rows = [("éhr $30,000 - $50,000", "São ÉWA", "ésenior"), ("$30,000 - $50,000 hr", "Seattle WA", "senior é")]
    df = spark.createDataFrame(rows, "pay string, place string, title string")
    got = df.select(text.parse_pay(F.col("pay"))["period"].alias("p"), geo.country_from_location(F.col("place")).alias("c"), text.level_of_title(F.col("title")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("year", None, None), ("hour", "US", "senior")]
