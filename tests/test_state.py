import random

from pyspark.sql import functions as F

from paylens.operators import lookups, ranking, series
from paylens.plans import postings as plan
from paylens.sources import sinks
from paylens.streaming import ledger
from paylens.streaming.generations import Generations

STATE = "token string, company string, provider string, job_count long, last_seen_ok string, consecutive_failures int, first_verified_at string"


def test_one_bad_run_removes_nobody(spark):
    state = spark.createDataFrame([(f"t{i}", "c", "p", 1, "d0", 0, "d0") for i in range(300)], STATE)
    nobody = spark.createDataFrame([], "token string, company string, provider string, job_count long")
    once = ledger.ledger_merge(state, state.select("token"), nobody, "d1")
    assert once.filter("NOT removed").count() == 300 and once.agg(F.sum("consecutive_failures")).first()[0] == 300
    again = once.drop("removed")
    for _ in range(2):
        again = ledger.ledger_merge(again, state.select("token"), nobody, "d2")
        gone = again.filter("removed").count()
        again = again.drop("removed")
    assert gone == 300


def test_ledger_cases(spark):
    state = spark.createDataFrame([("seen", "old", "p", 1, "d0", 2, "d0"), ("missed", "c", "p", 1, "d0", 1, "d0"), ("unprobed", "c", "p", 1, "d0", 2, "d0"), ("third", "c", "p", 1, "d0", 2, "d0")], STATE)
    probed = spark.createDataFrame([("seen",), ("missed",), ("third",), ("fresh",)], "token string")
    seen = spark.createDataFrame([("seen", "new", "p", 9), ("fresh", "f", "p", 3)], "token string, company string, provider string, job_count long")
    got = {r["token"]: (r["company"], r["consecutive_failures"], r["first_verified_at"], r["removed"]) for r in ledger.ledger_merge(state, probed, seen, "d1").collect()}
    assert got == {"seen": ("new", 0, "d0", False), "missed": ("c", 2, "d0", False), "unprobed": ("c", 2, "d0", False), "third": ("c", 3, "d0", True), "fresh": ("f", 0, "d1", False)}


def walk(runs):
    live, fails, first, ok, times = False, 0, None, None, 0
    for run, seen in sorted(runs):
        if seen:
            first, ok, fails, live = (first if live else run), run, 0, True
        elif live:
            fails += 1
            if fails >= 3:
                live, times = False, times + 1
    return fails, ok, first, times, not live


def test_replay_equals_walking_and_the_stream(spark, tmp_path):
    rnd = random.Random(7)
    data = {f"k{i}": [(f"r{j:02d}", rnd.random() < 0.35) for j in range(rnd.randint(1, 14))] for i in range(40)}
    rows = [(k, r, s) for k, v in data.items() for r, s in v]
    df = spark.createDataFrame(rows, "key string, run string, seen boolean")
    want = {k: walk(v) for k, v in data.items() if any(s for _, s in v)}
    shape = lambda r: (r["consecutive_failures"], r["last_seen_ok"], r["first_verified_at"], r["times_removed"], r["removed"])
    assert {r["key"]: shape(r) for r in ledger.ledger_replay(df, "key", "run", "seen").collect()} == want
    # folding a part of the history and then the rest comes to the same
    half = ledger.ledger_replay(df.filter("run < 'r06'"), "key", "run", "seen")
    assert {r["key"]: shape(r) for r in ledger.ledger_fold(half, df.filter("run >= 'r06'"), "key", "run", "seen").collect()} == want
    # the same runs arriving in batches, some rows again and neighbouring runs out of order
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    parts = ["run <= 'r03' AND run <> 'r02'", "run IN ('r02', 'r05')", "run >= 'r04' AND run <= 'r07'", "run IN ('r09', 'r08')", "run = 'r11' AND key < 'k2'", "run >= 'r10'"]
    for part in parts:
        df.filter(part).write.mode("append").parquet(src)
        ledger.run_ledger(spark.readStream.schema(df.schema).parquet(src), out, state)
    assert {r["key"]: shape(r) for r in ledger.read_ledger(spark, out).collect()} == want
    assert ledger.read_late(spark, out).count() == 0
    tables = Generations(spark, out)
    last = tables.newest("state")
    assert last == len(parts) - 1 and len(list((tmp_path / "out" / "state").glob("epoch=*"))) <= 2  # older generations go
    assert tables.read("open", last, ledger.OPEN).select("run").distinct().count() <= 3 and tables.read("state", last, ledger.STANDING).count() <= len(data)
    # what comes after its run was folded is set aside and counts for nothing
    spark.createDataFrame([("k1", "r00", True), ("new", "r01", True)], df.schema).write.mode("append").parquet(src)
    ledger.run_ledger(spark.readStream.schema(df.schema).parquet(src), out, state)
    assert {r["key"]: shape(r) for r in ledger.read_ledger(spark, out).collect()} == want
    assert sorted((r["key"], r["run"]) for r in ledger.read_late(spark, out).collect()) == [("k1", "r00"), ("new", "r01")]


def test_upsert_keeps_newest(spark):
    old = spark.createDataFrame([("a", "2026-01", 1), ("b", "2026-03", 2)], "k string, t string, v int")
    new = spark.createDataFrame([("a", "2026-02", 9), ("b", "2026-01", 9), ("c", "2026-01", 9)], "k string, t string, v int")
    assert sorted((r["k"], r["v"]) for r in ledger.upsert_latest(old, new, ["k"], "t").collect()) == [("a", 9), ("b", 2), ("c", 9)]


def test_dataset_partitions_and_history(spark, tmp_path):
    p = str(tmp_path / "ds")
    df = spark.createDataFrame([(1,), (2,)], "v int")
    sinks.write_dataset(df, p, "a", "t1")
    sinks.write_dataset(df, p, "b", "t1")
    sinks.write_dataset(df.limit(1), p, "a", "t2")
    assert {(r["source_id"], r["count"]) for r in spark.read.parquet(p).groupBy("source_id").count().collect()} == {("a", 1), ("b", 2)}
    h = str(tmp_path / "hist")
    for run in ("2026-01", "2026-02", "2026-03"):
        sinks.append_snapshot(df, h, run)
    cur, prev = sinks.last_two_runs(spark.read.parquet(h))
    assert {r["run_ts"] for r in cur.collect()} == {"2026-03"} and {r["run_ts"] for r in prev.collect()} == {"2026-02"}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", b', None), (2, None, [1, 2])], "i int, s string, l array<int>")
    sinks.export_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("i").collect()
    assert [tuple(r) for r in back] == [("1", 'a "quoted", b', None), ("2", None, "[1,2]")]
    sinks.export_json(df, str(tmp_path / "j"), "now", "n")
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert '"s":null' in text and '"generated_at":"now"' in text


def test_lookups(spark):
    df = spark.createDataFrame([("SE", 2019), ("SE", 2020), ("AE", 2020)], "country string, year int")
    ref = spark.createDataFrame([("SE", 2020, 38.0), ("SE", 2022, 39.0)], "country string, year int, h double")
    got = {(r["country"], r["year"]): (r["h"], r["used"]) for r in lookups.year_or_latest(df, ref, "country", "year", "h", "used").collect()}
    assert got == {("SE", 2019): (39.0, 2022), ("SE", 2020): (38.0, 2020), ("AE", 2020): (None, None)}
    pts = spark.createDataFrame([("NO", 39.0, -8.31), ("NO", 47.0, 13.27), ("NO", 60.0, 14.41)], "e string, x double, y double")
    ask = spark.createDataFrame([("NO", 22.0), ("NO", 39.0), ("NO", 43.0), ("NO", 60.0), ("NO", 70.0), ("SE", 30.0)], "e string, a double")
    got = [(r["a"], r["v"] and round(r["v"], 9), r["clamped"]) for r in lookups.curve_lookup(ask, pts, ["e"], "a", "x", "y", "v").orderBy("e", "a").collect()]
    assert got == [(22.0, -8.31, "low"), (39.0, -8.31, None), (43.0, 2.48, None), (60.0, 14.41, None), (70.0, 14.41, "high"), (30.0, None, None)]


def test_filter_and_money(spark):
    p = spark.createDataFrame([("1", "SE", "Senior Dev", True), ("2", "SE", "Dev", None), ("3", "NO", "Senior dev", True)], "id string, country string, title string, remote boolean")
    assert [r["id"] for r in plan.filter_postings(p, country="SE", level="senior", remote=True, q=" DEV ").collect()] == ["1"]
    c = spark.createDataFrame([("ok", 100000.0, 70.0, 1000.0, 900.0, 5000.0), ("milan", 66300.0, 60.0, 1500.0, 1797.5, 5400.0), ("never", 20000.0, 70.0, 1000.0, 900.0, 5000.0), ("gap", 100000.0, 70.0, None, 900.0, 5000.0)], "id string, gross double, net_pct double, rent double, living double, price_m2 double")
    got = {r["id"]: r for r in ranking.derive_money(c).collect()}
    assert got["ok"]["savings"] == 47200.0 and got["ok"]["stability"] == "stable" and got["ok"]["missing_inputs"] == []
    assert got["milan"]["savings"] == 210.0 and got["milan"]["stability"] == "unstable"
    assert got["never"]["never"] is True and got["never"]["years_to_home"] is None and got["never"]["m2_per_year"] == 0.0
    assert got["gap"]["missing_inputs"] == ["rent"] and got["gap"]["savings"] is None and got["gap"]["m2_per_year"] is None


def test_series_edges(spark):
    y = spark.createDataFrame([("a", 2000, 10.0), ("a", 2002, 15.0)], "e string, y int, v double")
    assert [r["change_pct"] for r in series.yoy(y, ["e"], "y", "v").collect()] == [50.0]
    assert [r["v"] for r in series.extrapolate(y, ["e"], "y", "v", 2004).orderBy("y").collect()] == [17.5, 20.0]
    assert [r["v"] for r in series.extrapolate(y, ["e"], "y", "v", 2003, anchor=True).orderBy("y").collect()] == [15.0, 17.5]
    g = spark.createDataFrame([("a", 2002, 99.0), ("a", 2003, 10.0), ("a", 2004, -100.0), ("a", 2005, 5.0)], "e string, y int, g double")
    assert [round(r["v"], 6) for r in series.compound(y, g, ["e"], "y", "v", "g").orderBy("y").collect()] == [16.5, 0.0, 0.0]
    d = spark.createDataFrame([("a", 1.0, False), ("a", 9.0, True), ("b", 1.0, False), ("b", 2.0, False), ("b", 9.0, True)], "g string, v double, off boolean")
    assert {r["g"]: (r["lo"], r["hi"]) for r in series.domain(d, ["g"], "v", "off").collect()} == {"a": (1.0, 9.0), "b": (1.0, 2.0)}


def test_composite_redistributes(spark):
    long = spark.createDataFrame([("a", "pay", 10.0, "higher", False), ("b", "pay", 20.0, "higher", False), ("c", "pay", 999.0, "higher", True), ("a", "rent", 1.0, "lower", False), ("b", "rent", None, "lower", False), ("c", "rent", 3.0, "lower", False)], "id string, metric string, value double, direction string, shaky boolean")
    got = {r["id"]: (r["score"], r["missing_weight"], r["missing"]) for r in ranking.composite(long, ["id"], {"pay": 1, "rent": 1}, "shaky").collect()}
    assert got["a"] == (0.5, 0.0, []) and got["b"] == (1.0, 1.0, ["rent"]) and got["c"][0] > 1
