import re
import json

from pyspark.sql import functions as F

from paylens.sources import cubes, postings, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else sorted(tuple(r) for r in df.collect())


CUBE = {
    "id": ["geo", "time"],
    "size": [2, 3],
    "dimension": {
        "geo": {"category": {"index": {"SE": 1, "NO": 0}, "label": {"SE": "Sweden", "NO": "Norway"}}},
        "time": {"category": {"index": ["2020", "2021", "2022"]}},
    },
    "value": [1.0, None, 3.0, 4.0, 5.0, 6.0],
    "status": {"2": "u"},
}


def cube(spark, **changes):
    return spark.createDataFrame([("c", json.dumps({**CUBE, **changes}))], "cube string, doc string")


def test_cube_dense_sparse_and_nested(spark):
    want = [("NO", "2020", 1.0, None), ("NO", "2022", 3.0, "u"), ("SE", "2020", 4.0, None), ("SE", "2021", 5.0, None), ("SE", "2022", 6.0, None)]
    flat = lambda d: rows(cubes.cube_table(cubes.flatten_cube(d, ["cube"]), [], ["geo", "time"]), "geo", "time")
    assert flat(cube(spark)) == want
    assert flat(cube(spark, value={"0": 1.0, "2": 3.0, "3": 4.0, "4": 5.0, "5": 6.0})) == want
    nested = {k: v for k, v in CUBE.items() if k not in ("id", "size")}
    nested["dimension"] = {**CUBE["dimension"], "id": CUBE["id"], "size": CUBE["size"]}
    assert flat(spark.createDataFrame([("c", json.dumps(nested))], "cube string, doc string")) == want
    assert rows(cubes.cube_labels(cube(spark), [], "geo")) == [("NO", "Norway"), ("SE", "Sweden")]


def test_wage_cube_and_fallback(spark):
    cells = spark.createDataFrame(
        [({"o": "2512", "t": "2024", "c": "mean"}, 10.0), ({"o": "2512", "t": "2024", "c": "median"}, 9.0), ({"o": "2512", "t": "2024", "c": "zzz"}, 1.0)],
        "coords map<string,string>, value double",
    )
    got = cubes.wage_cube(cells, "o", "t", "c", {"mean": "mean_sek_month", "median": "median_sek_month"})
    assert rows(got) == [("2512", 2024, 10.0, 9.0)]
    a = spark.createDataFrame([("SE", 1.0)], "entity string, v double")
    b = spark.createDataFrame([("SE", 2.0), ("AE", 3.0)], "entity string, v double")
    assert rows(cubes.with_fallback(a, b, "entity", "nace", "J", "TOTAL")) == [("AE", 3.0, "TOTAL"), ("SE", 1.0, "J")]


def test_indicator_pages(spark):
    page = [{"page": 1}, [{"countryiso3code": "SWE", "indicator": {"id": "X"}, "date": "2020", "value": 1.5}, {"countryiso3code": "SWE", "indicator": {"id": "X"}, "date": "2021", "value": None}, {"countryiso3code": "FRA", "indicator": {"id": "X"}, "date": "2020", "value": 2}]]
    df = spark.createDataFrame([(json.dumps(page),)], "page string")
    assert rows(tables.read_indicator(df, "page")) == [("SE", "X", 2020, 1.5)]
    extra = spark.createDataFrame([("FRA", "FR"), ("SWE", "SE")], "code string, entity string")
    assert rows(tables.read_indicator(df, "page", extra)) == [("FR", "X", 2020, 2.0), ("SE", "X", 2020, 1.5)]


def test_sdmx_keys_labels_and_filter(spark):
    df = spark.createDataFrame(
        [("SWE", "M", "", "2020", "1.5", "_Z"), ("SWE", "", " ", "2020", "2", "_Z"), ("SWE", "M", "U", "2020", "x", "_Z"), ("FRA", "M", "U", "2020", "3", "_Z"), ("DEU", "M", "U", "2020", "4", "F")],
        "REF_AREA string, MEASURE string, UNIT string, TIME string, OBS string, SEX string",
    )
    got = tables.read_sdmx(df, "REF_AREA", ["MEASURE", "UNIT"], "TIME", "OBS", F.col("SEX") == "_Z")
    assert rows(got) == [("SE", "M", "2020", 1.5), ("SE", "value", "2020", 2.0)]
    labelled = tables.read_sdmx(df, "REF_AREA", ["MEASURE", "UNIT"], "TIME", "OBS", labels={"MEASURE": {"M": "real"}, "UNIT": {"U": "index"}})
    assert rows(labelled) == [("DE", "real_index", "2020", 4.0)]


def test_projection_mark(spark):
    d = spark.createDataFrame([("SE", 2023), ("SE", 2025), ("NO", 2025), ("NO", 2026)], "entity string, year int")
    act = spark.createDataFrame([("SE", 2024), ("DE", 2025)], "entity string, year int")
    assert rows(tables.mark_projection(d, act)) == [("NO", 2025, False), ("NO", 2026, True), ("SE", 2023, False), ("SE", 2025, True)]


def test_population(spark):
    df = spark.createDataFrame(
        [(1, "SE", "", "Medium", "2023", "10.5", "25"), (2, "SE", "", "Medium", "2023", "99", "1"), (3, "", "NOR", "Medium", "2030", "5", ""), (4, "SE", "", "High", "2024", "11", "1")],
        "row_no int, ISO2_code string, ISO3_code string, Variant string, Time string, PopTotal string, PopDensity string",
    )
    assert rows(tables.read_population(df, ["Medium"], 2000, 2040, 2023)) == [
        ("NO", "total_population", 2030, 5000.0, True), ("SE", "population_density", 2023, 25.0, False), ("SE", "total_population", 2023, 10500.0, False),
    ]


def test_wide_years(spark):
    df = spark.createDataFrame([("SWE", "NGDP", "2021", "1,234.5", "--", "n/a"), ("SWE", "OTHER", "2021", "1", "2", "3"), ("FRA", "NGDP", "x", "1", "2", "3")], "ISO string, S string, L string, `2020` string, `2021` string, `2022` string")
    assert rows(tables.read_wide_years(df, "ISO", "S", {"NGDP": "gdp"}, "L")) == [("SE", "gdp", 2020, 1234.5, False)]


def test_header_scan_and_sections(spark):
    sheet = [(1, ["x", "a", "b", "c"]), (2, [None, "2024", "2025e", "2026f"]), (3, ["Sweden", "1.5", None, "3"]), (4, ["Narnia", "9", "9", "9"]), (5, [None, "2030", "2031", "2032"]), (6, ["", "Norway", "7", "8"])]
    df = spark.createDataFrame([("s", i, c) for i, c in sheet], "sheet string, n int, cells array<string>")
    assert rows(tables.read_header_scan(df, "sheet", "n", "cells")) == [("NO", 2031, 7.0), ("NO", 2032, 8.0), ("SE", 2024, 1.5), ("SE", 2026, 3.0)]
    parts = [(1, ["Overall scores", None]), (2, ["Year", "Score"]), (3, ["2020", "55.456"]), (4, ["Policy strand", "Labour", "Health"]), (5, ["2020", "1", "2.5"]), (6, ["note", "3"])]
    df = spark.createDataFrame([("SE", i, c) for i, c in parts], "sheet string, n int, cells array<string>")
    got = sorted(tables.read_sections(df, "sheet", "n", "cells").collect(), key=lambda r: str(r["strand"]))
    assert [tuple(r) for r in got] == [("SE", "strand", "Health", 2020, 2.5), ("SE", "strand", "Labour", 2020, 1.0), ("SE", "overall", None, 2020, 55.46)]


def test_migrants_rank_panel_vintage(spark):
    df = spark.createDataFrame([("SE", 900, "World", 2020, 100.0), ("SE", 364, "Iran", 2020, 30.0), ("SE", 246, "Finland", 2020, 40.0), ("SE", 364, "Iran", 2015, 10.0)], "destination string, origin_code int, origin string, year int, value double")
    per, listed = tables.read_migrant_matrix(df)
    assert sorted((r["year"], r["total"], r["named"]) for r in per.collect() if r["year"] == 2020) == [(2020, 100.0, 30.0)]
    assert [(r["origin"], r["rank"]) for r in listed.orderBy("rank").collect()] == [("Finland", 1), ("Iran", 2)]
    panel = spark.createDataFrame([("Sweden", "2020", "7", "7.3"), ("Narnia", "2020", "150", "1"), ("Sweden", None, "1", "1")], "Country string, Year string, Rank string, `Ladder score (x)` string")
    assert rows(tables.read_rank_panel(panel, "Country", "Year", "Rank", {"ladder": "score"})) == [("SE", 2020, 7, 150, 7.3)]
    rsf = spark.createDataFrame([("SWE", "88,15", "4"), ("ZZZ", "1", "180")], "ISO string, `Score 2025` string, Rank string")
    assert rows(tables.read_vintage_csv(rsf, 2025, "ISO", ["Score {year}", "Score"], ["Rank"])) == [("SE", 2025, 88.15, 4, 180)]


def test_metro_uk_months_daily(spark):
    raw = spark.createDataFrame([("Boston (MSAD)", "1", "2020", "1", "100.5", ""), ("Boston", "1", "2020", "2", "-", ""), ("X", "9", "2020", "1", "1", "")], "_c0 string, _c1 string, _c2 string, _c3 string, _c4 string, _c5 string")
    codes = spark.createDataFrame([("1", "boston", "primary")], "code string, city string, role string")
    assert rows(tables.read_metro_hpi(raw, codes)) == [("boston", "primary", 2020, 1, 100.5, True)]
    uk = spark.createDataFrame([("01/02/2020", "London", "500000", ""), ("01/03/2020", "London", "", ""), ("bad", "London", "1", "1")], "Date string, RegionName string, AveragePrice string, Index string")
    regions = spark.createDataFrame([("London", "london")], "region string, city string")
    assert rows(tables.read_uk_hpi(uk, regions)) == [("london", "2020-02", 500000.0, None)]
    arr = spark.createDataFrame([("t", [None, 1.0, 2.0], "1999-12")], "city string, v array<double>, start string")
    assert rows(tables.read_month_arrays(arr, "city", "v", "start")) == [("t", "2000-01", 1.0), ("t", "2000-02", 2.0)]
    day = spark.createDataFrame([("c", "2020-01-01", 1.0), ("c", "2020-01-02", 2.0)], "code string, date string, value double")
    fan = spark.createDataFrame([("c", "a"), ("c", "b")], "code string, city string")
    assert rows(tables.daily_to_monthly(day, "code", "date", "value", fan)) == [("a", "2020-01", 1.5, 2), ("b", "2020-01", 1.5, 2)]


def test_series_ids(spark):
    wanted = spark.createDataFrame([("nyc", "primary", "M", "35620")], "city string, role string, area_type string, area string")
    df = spark.createDataFrame([("OEUM003562000000015125204", "2024", "150,000"), ("OEUM003562000000015125213", "2024", "-")], "series_id string, year string, value string")
    assert rows(tables.read_series_by_id(df, wanted, {"04": "annual_mean_usd", "13": "annual_median_usd"})) == [("nyc", "primary", "2024", 150000.0, None)]


def test_survey_counts_unbanded_rows_once(spark):
    data = [("2024", "Sweden", "50000", "2", "Dev; Ops"), ("2024", "Sweden", "60000", "", "Dev"), ("2024", "Sweden", "70000", "4", "Dev"), ("2024", "Sweden", "80000", "9", "Dev"), ("2024", "Sweden", "4000", "9", "Dev"), ("2024", "France", "50000", "9", "Dev")]
    df = spark.createDataFrame(data, "wave string, Country string, Pay string, Exp string, DevType string")
    banded, roles = tables.survey_pay(df, ["Old", "Pay"], ["Country"], ["Exp"], ["DevType"], "wave")
    assert {(r["band"], r["n"], r["median"], r["p25"], r["thin"]) for r in banded.collect()} == {
        ("all", 4, 65000.0, 52500.0, True), ("new_grad", 1, 50000.0, None, True), ("mid", 1, 70000.0, None, True), ("senior", 1, 80000.0, None, True),
    }
    assert {(r["role"], r["n"]) for r in roles.collect()} == {("Dev", 4)}


def test_places_tables_pages_lines(spark):
    cand = spark.createDataFrame([("a", "SE", "SE", 1.0, 2.0, 10), ("a", "SE", "SE", 3.0, 4.0, 99), ("a", "US", "SE", 5.0, 6.0, 999), ("b", "SE", "SE", 7.0, 8.0, 1)], "id string, country string, wanted_country string, lat double, lon double, population int")
    old = spark.createDataFrame([("b", 0.0, 0.5), ("c", None, None)], "id string, lat double, lon double")
    assert sorted(tables.pick_place(cand, old).collect(), key=lambda r: r["id"]) == [("a", 3.0, 4.0), ("b", 0.0, 0.5), ("c", None, None)]
    t = spark.createDataFrame([(["Rank", "Country", "Cost of Living"], ["1", "Sweden", "70.5"]), (["Rank", "Country", "Cost of Living"], ["2", "Narnia", "1"])], "h array<string>, c array<string>")
    assert rows(tables.table_rows(t, "h", "c")) == [("SE", "cost_of_living", 70.5), ("SE", "rank", 1.0)]
    page = spark.createDataFrame([("x", "In 2020: 55.5 then 2020 66.6, 2021 is 70.25; 1999 80.1")], "city string, page string")
    assert rows(tables.regex_pairs(page, "city", "page")) == [("x", 2020, 55.5), ("x", 2021, 70.25)]
    wiki = spark.createDataFrame([(1, ["Sweden[a]", "10,000,000[1]", "89.2 %"]), (2, ["Sweden", "5", "1%"]), (3, ["Norway", "none", "-"])], "n int, c array<string>")
    assert rows(tables.table_numbers(wiki, "n", "c")) == [("SE", 89.2, 10000000)]
    lines = spark.createDataFrame([(1, "Germany 60 chart"), (2, "9 Germany 58.1 10 Sweden 57"), (3, "(cid:3) 1 Sweden 99.9"), (4, "Norway 12")], "n int, line string")
    got = {r["entity"]: (r["score"], r["rank"]) for r in tables.scrape_lines(lines, "n", "line", 20, 100).collect()}
    assert got == {"DE": (58.1, 9), "SE": (57.0, 10)}
    both = spark.createDataFrame([(1, "Germany 60 Sweden 57.5"), (2, "United States 33.3 United Kingdom"), (3, "Sweden 61")], "n int, line string")
    got = {r["entity"]: (r["score"], r["rank"]) for r in tables.scrape_lines(both, "n", "line", 20, 100).collect()}
    assert got == {"DE": (60.0, None), "SE": (57.5, 60), "US": (33.3, None)}
    odd = {"Ab": "1", "Abc": "2", "A.c": "3", "b": "4"}
    assert [re.findall(tables.trie_pattern(list(odd)), t) for t in ("Abc Ab", "A.c Axc", "xb")] == [["Abc", "Ab"], ["A.c"], ["b"]]


def test_capture_and_wage_tables(spark):
    cap = spark.createDataFrame([("berlin", "EUR", 80.0), ("oslo", "NOK", 10.0)], "city string, currency string, median double")
    fx = spark.createDataFrame([("EUR", 0.8)], "currency string, rate double")
    cities = spark.createDataFrame([("berlin",), ("oslo",), ("doha",)], "city string")
    got = {r["city"]: (r["median_usd"], r["reason"]) for r in tables.read_capture(cap, fx, cities).collect()}
    assert got == {"berlin": (100.0, None), "oslo": (None, "no pinned rate"), "doha": (None, "not captured")}
    es = spark.createDataFrame([("National Total. Base data. Both genders. IT. Mean ", [(2018, 1.0), (2022, 2.0)]), ("National Total. Base data. Men. IT. Mean", [(2022, 9.0)])], "name string, points array<struct<year:int,value:double>>")
    assert rows(tables.wages_es(es, "IT")) == [("Mean", 2.0, 2022)]
    nl = spark.createDataFrame([("0811", "2024JJ00"), ("0811", "2024KW01")], "Beroep string, Perioden string")
    assert [r["year"] for r in tables.wages_nl(nl, "Beroep", "Perioden").collect()] == [2024]
    de = spark.createDataFrame([("434", "4.500,5", "/"), ("43", "1", "2")], "k string, a string, b string")
    assert rows(tables.wages_de(de, "k", "434", {"a": "mean_eur_month", "b": "median_eur_month"})) == [("434", 4500.5, None)]
    uk = spark.createDataFrame([("2134 ", "50000", "x")], "code string, mean string, p90 string")
    cv = spark.createDataFrame([("2134", "1.5", "..")], "code string, mean string, p90 string")
    assert rows(tables.wages_uk(uk, cv, "code", ["mean", "p90"])) == [("2134", 50000.0, None, 1.5, None)]
    ca = spark.createDataFrame([("NOC_21231", "Canada", "55.1", "")], "c string, r string, m string, l string")
    assert rows(tables.wages_ca(ca, "c", "r", "Canada", {"m": "median_cad_hour", "l": "p10_low_cad_hour"})) == [("21231", "Canada", 55.1, None, True)]
    au = spark.createDataFrame([("261313 Software Engineer", "Total", "100,000", "90,000"), ("261313 Software Engineer", "Male", "1", "1")], "l string, s string, m string, d string")
    assert rows(tables.wages_au(au, "l", "s", "Total", {"salary": ("m", "d")})) == [("261313", "Software Engineer", "salary", 100000.0, 90000.0)]
    qa = spark.createDataFrame([("2020", "M", "10", "3"), ("2020", "F", "20", "1")], "y string, s string, w string, n string")
    assert [r["weighted_mean_qar_month"] for r in tables.wages_qa(qa, "y", "s", ["M", "F"], "w", "n").collect()] == [12.5]
    assert tables.no_series_rows(spark, [("IT", "salary_it", None, "not published")]).first()["status"] == "no_series"


def test_ashby(spark):
    comp = lambda mn, mx, cur, itv: {"compensationTierSummary": "all", "compensationTiers": [{"tierSummary": "$30 - $50", "components": [{"minValue": 0.0, "maxValue": 9.0, "currencyCode": "USD", "interval": "1 YEAR"}, {"minValue": mn, "maxValue": mx, "currencyCode": cur, "interval": itv}]}]}
    jobs = [("1", comp(100000.0, 120000.0, "EUR", "1 YEAR")), ("2", comp(30.0, 50.0, "USD", "1 YEAR")), ("3", comp(1.0, None, "USD", "NONE")), ("4", None), ("5", comp(20.0, None, "USD", "1 HOUR"))]
    docs = [{"token": "ramp", "organizationName": None, "jobs": [{"id": i, "title": "T", "location": "Berlin", "isRemote": None, "jobUrl": None, "applyUrl": "u", "publishedAt": "2026-01-02", "compensation": c} for i, c in jobs]}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "v string").select(F.from_json("v", postings.ASHBY).alias("d")).select("d.*")
    got = {r["id"]: r for r in postings.postings_ashby(df).collect()}
    pay = lambda i: (lambda c: c and (c["min"], c["max"], c["currency"], c["period"]))(got[f"ashby:ramp:{i}"]["compensation"])
    assert [pay(i) for i in "12345"] == [(100000.0, 120000.0, "EUR", "year"), (30.0, 50.0, "USD", "hour"), None, None, (20.0, 20.0, "USD", "hour")]
    assert got["ashby:ramp:1"]["country"] == "DE" and got["ashby:ramp:1"]["company"] is None


def test_greenhouse_caps_and_period(spark):
    jobs = spark.createDataFrame([("acme", i, str(i), "T", "Acme", "Oslo", "u", "2026-02-03T10:00:00Z") for i in range(45)], "token string, pos int, id string, title string, company_name string, location string, url string, updated_at string")
    detail = spark.createDataFrame([("acme", str(i), 4500 if i == 1 else 10_000_000, 5500 if i == 1 else 12_000_000, "USD") for i in range(45)] + [("acme", "99", 0, 0, "USD")], "token string, id string, min_cents long, max_cents long, currency string")
    every = postings.postings_greenhouse(jobs, detail).collect()
    assert len(every) == 45 and sum(r["compensation"] is not None for r in every) == 45
    got = postings.postings_greenhouse(jobs, detail, paid_jobs=40).collect()
    paid = {r["id"]: r["compensation"] for r in got if r["compensation"]}
    assert len(got) == 45 and len(paid) == 40
    assert paid["greenhouse:acme:1"]["period"] == "hour" and paid["greenhouse:acme:1"]["max"] == 55.0
    assert paid["greenhouse:acme:2"]["period"] == "year" and got[0]["posted_at"] == "2026-02-03"


def test_lever_feed_gov_forum(spark):
    sal = "salary struct<min:double,max:double,currency:string,interval:string>"
    df = spark.createDataFrame([("t", "1", "T", "Paris", "remote", "u", (10.0, 20.0, "EUR", "per-hour-wage")), ("t", "2", "T", "Paris", None, "u", (10.0, 20.0, "EUR", "semi-month-salary")), ("t", "3", "T", "Paris", None, "u", (0.0, 20.0, "EUR", "per-year-salary")), ("t", "4", "T", "Paris", None, "u", None)], f"token string, id string, title string, location string, workplace string, url string, {sal}")
    got = postings.postings_lever(df).orderBy("id").collect()
    assert [r["compensation"] and r["compensation"]["period"] for r in got] == ["hour", None, None, None]
    assert [r["remote"] for r in got] == [True, None, None, None]
    feed = spark.createDataFrame([("x", "X AB", "1", "T", "u", "2026-01-05T00:00", "Malmö", "", "Sweden", (1000.0, None, "SEK", None)), ("x", None, "2", "T", "u", "", "", "", "SE", None)], "token string, feed_title string, id string, title string, url string, published string, locality string, region string, country_name string, salary struct<min:double,max:double,currency:string,unit:string>")
    got = postings.postings_feed(feed).orderBy("id").collect()
    assert [(r["country"], r["location_raw"], r["company"]) for r in got] == [("SE", "Malmö, Sweden", "X AB"), ("SE", "SE", "x")]
    assert got[0]["compensation"]["period"] == "year" and got[1]["compensation"] is None
    gov = spark.createDataFrame([("9", None, "Navy", "NV", "T", "2026-01-01", 50.0, 60.0, "Per Hour", [("Nowhere", "")]), ("8", "A", "D", None, "T", "2026-01-01", 50000.0, 60000.0, "Per Month", [])], "id string, agency string, department string, department_code string, title string, opened string, lo double, hi double, salary_type string, locations array<struct<city:string,state:string>>")
    got = postings.postings_gov(gov).orderBy("id").collect()
    assert [(r["company"], r["company_slug"], r["country"], r["compensation"] is None) for r in got] == [("A", "usajobs", "US", True), ("Navy", "NV", "US", False)]
    forum = spark.createDataFrame([("1", "Acme | Berlin | Remote<p>2-3 days/week, $160-170K CAD<p>more", None, None), ("2", "x", True, None), ("3", "<p> ", None, None)], "id string, text string, deleted boolean, dead boolean")
    got = postings.postings_forum(forum).collect()
    assert len(got) == 1 and got[0]["title"] == "Acme | Berlin | Remote" and got[0]["country"] == "DE" and got[0]["remote"] is True
    assert (got[0]["compensation"]["min"], got[0]["compensation"]["currency"]) == (160000.0, "CAD")


def test_survey_and_forum_queries_give_the_readers_own_columns(spark, tmp_path):
    from statistics import median, quantiles

    from paylens.queries import readers

    orders = [(i, i % 7, f"199{i % 2}-05-05", 4000.0 + 517.5 * i) for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double").selectExpr("*", "date(o_orderdate) AS d").drop("o_orderdate").withColumnRenamed("d", "o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(c, c % 2) for c in range(7)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    groups: dict = {}
    for _, c, day, pay in orders:
        if 5000 <= pay <= 1_000_000:
            place, band = "DE" if c % 2 else "SE", {0: "new_grad", 1: "mid", 2: "senior"}.get(c % 4)
            for kind, key in (("band", "all"), ("role", "dev"), ("band", band)):
                if key:
                    groups.setdefault((kind, place, day[:4], key), []).append(pay)
    for kind, query, least in (("band", readers.survey_pay_bands, 1), ("role", readers.survey_pay_roles, 3)):
        want = {}
        for (k, *key), v in groups.items():
            if k == kind and len(v) >= least:
                q = quantiles(v, n=4) if len(v) >= 4 else [None] * 3
                want[tuple(key)] = (len(v), round(median(v)), *(x if x is None else round(x) for x in (q[0], q[2])), len(v) < 5)
        got = {(r["country"], r["wave"], r[kind]): (r["n"], r["median"], r["p25"], r["p75"], r["thin"]) for r in query(spark, str(tmp_path)).collect()}
        assert got == want
    talk = [(1, 0, "Acme | Berlin, Germany | REMOTE\n$120,000 - $150,000 per year"), (1, 1, "Plain"), (2, 0, " ")]
    spark.createDataFrame(talk, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r["id"]: r for r in readers.forum_postings_fields(spark, str(tmp_path)).collect()}
    assert set(out) == {"hn:1-0", "hn:1-1"}
    assert out["hn:1-0"]["location_raw"] == talk[0][2].split("\n")[0] and out["hn:1-0"]["remote"] is True and out["hn:1-1"]["remote"] is None
    assert out["hn:1-0"]["compensation"] is not None and out["hn:1-1"]["compensation"] is None
