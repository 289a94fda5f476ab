"""Planted distributions: each statistic fires on its own and stays quiet on the normal one."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paylens.functions.draws import mixed, mixed_column, mixed_sql, poisson, poisson_bars, stream
from paylens.operators import bootstrap as resample
from paylens.operators import multivariate, stats


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(15)
    sets = {
        "lognormal": rng.lognormal(11, 0.6, 400),
        "normal": rng.normal(100, 15, 400),
        "heaped": np.round(rng.normal(90000, 20000, 400) / 5000) * 5000,
        "pareto": (rng.pareto(1.2, 600) + 1) * 1000,
        "spiked": np.concatenate([rng.normal(100, 15, 200), [400, 450]]),
        "tiny": np.array([1.0, 2.0, 3.0]),
    }
    rows = [(k, float(x)) for k, v in sets.items() for x in v]
    return sets, spark.createDataFrame(rows, "g string, v double")


def by(df):
    return {r["g"]: r for r in df.collect()}


def test_profile_against_numpy(planted):
    sets, df = planted
    got = by(stats.profile_numeric(df, ["g"], "v"))
    assert "tiny" not in got
    for g in ("lognormal", "normal", "spiked"):
        v = sets[g]
        assert got[g]["n"] == len(v)
        assert np.allclose([got[g]["mean"], got[g]["median"], got[g]["sd"], got[g]["iqr"]], [v.mean(), np.median(v), v.std(ddof=1), np.subtract(*np.percentile(v, [75, 25]))])
    est = by(stats.estimator_error(df, ["g"], "v"))
    assert est["lognormal"]["mean_vs_geomean_pct"] > 10 and abs(est["normal"]["mean_vs_median_pct"]) < 5


def test_tail_steps_and_digits(planted):
    _, df = planted
    hill = by(stats.hill(df, ["g"], "v"))
    assert hill["pareto"]["alpha"] < 2 < hill["normal"]["alpha"] and "tiny" not in hill
    assert by(stats.granularity(df, ["g"], "v"))["heaped"]["step"] == 5000
    digits = by(stats.digit_heaping(df, ["g"], "v"))
    assert digits["heaped"]["rejected"] is True
    even = df.sparkSession.range(1, 2001).select(F.lit("u").alias("g"), F.col("id").cast("double").alias("v"))
    assert by(stats.digit_heaping(even, ["g"], "v"))["u"]["rejected"] is False
    ben = df.sparkSession.range(0, 3000).select(F.lit("b").alias("g"), F.pow(F.lit(1.003), F.col("id")).alias("v"))
    b = by(stats.benford(ben, ["g"], "v"))["b"]
    assert b["mad"] < 0.005 and b["interpretable"] is True


def test_outliers_disagree_where_they_should(planted):
    sets, df = planted
    got = by(stats.outlier_summary(df, ["g"], "v"))
    v = sets["lognormal"]
    q1, q3 = np.percentile(v, [25, 75])
    assert got["lognormal"]["iqr_fence_n"] == int(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).sum())
    lv = np.log(v)
    l1, l3 = np.percentile(lv, [25, 75])
    assert got["lognormal"]["log_fence_n"] == int(((lv < l1 - 1.5 * (l3 - l1)) | (lv > l3 + 1.5 * (l3 - l1))).sum())
    assert got["spiked"]["robust_z_n"] >= 2 and got["normal"]["by_all_n"] <= 3


def test_intervals_agree_with_resampling(planted):
    sets, df = planted
    got = by(stats.median_ci(df, ["g"], "v"))
    bca = by(stats.median_bca(df, ["g"], "v"))
    rng = np.random.default_rng(1)
    for g in ("lognormal", "normal", "spiked"):
        v = sets[g]
        boot = np.median(rng.choice(v, (4000, len(v))), axis=1)
        lo, hi = np.percentile(boot, [2.5, 97.5])
        width = hi - lo
        for r in (got[g], bca[g]):
            assert abs(r["lo"] - lo) < 0.25 * width and abs(r["hi"] - hi) < 0.25 * width
    odd = df.filter("g = 'normal'").limit(399)
    assert by(stats.median_bca(odd, ["g"], "v"))["normal"]["n"] == 399


def test_normality_and_tests(planted, spark):
    _, df = planted
    got = by(stats.normality(df.filter("g IN ('lognormal', 'normal')"), ["g"], "v"))
    assert got["lognormal"]["rejects_normal"] and got["lognormal"]["better_fit"] == "log-normal" and not got["normal"]["rejects_normal"]
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(0.5, 1, 80), 1), np.round(rng.normal(0, 1, 90), 1)
    d = spark.createDataFrame([(True, float(x)) for x in a] + [(False, float(x)) for x in b], "g boolean, v double")
    m = stats.mann_whitney(d, F.col("g"), "v").first()
    u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    assert m["u"] == pytest.approx(u) and m["p"] < 0.05


def test_agreement(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(10, 0.5, 200)
    y = x * 1.2 * np.exp(rng.normal(0, 0.1, 200))
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    ba = stats.bland_altman(df, ["g"], "x", "y").first()
    assert ba["bias"] == pytest.approx(np.exp(np.mean(np.log(y / x)))) and ba["loa_lo"] < ba["bias"] < ba["loa_hi"]
    rank = lambda v: np.argsort(np.argsort(v))
    assert stats.spearman(df, "x", "y").first()["spearman_r"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    dm = stats.deming(df, ["g"], "x", "y").first()
    assert dm["slope"] > dm["ols_slope"] and stats.deming(df.limit(5), ["g"], "x", "y").count() == 0
    far = df.withColumn("y", F.when(F.col("x") == float(x[0]), F.col("y") * 9).otherwise(F.col("y")))
    assert float(x[0]) in {r["x"] for r in stats.ratio_outliers(far, "x", "y").collect()}


def test_noise_against_polyfit(spark):
    rng = np.random.default_rng(4)
    t = np.arange(60)
    smooth = 100 + t + 0.02 * t**2 + np.cumsum(rng.normal(0, 0.3, 60))
    jitter = 100 + 0.1 * t + rng.normal(0, 5, 60)
    rows = [(n, int(i), float(v)) for n, s in (("smooth", smooth), ("jitter", jitter), ("short", smooth[:20])) for i, v in enumerate(s)]
    got = {r["e"]: r for r in stats.noise_test(spark.createDataFrame(rows, "e string, t int, v double"), ["e"], "t", "v").collect()}
    res = jitter - np.polyval(np.polyfit(t, jitter, 3), t)
    res -= res.mean()
    assert got["jitter"]["residual_acf1"] == pytest.approx((res[:-1] @ res[1:]) / (res @ res), abs=1e-8)
    assert got["jitter"]["noisy"] and not got["smooth"]["noisy"] and "short" not in got


def test_multivariate(spark):
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(0, 1, (500, 2)))
    m = np.column_stack([x, x[:, 0] * 2 + x[:, 1] * 0.01 + np.abs(rng.normal(0, 0.05, 500))])
    m[0] = [500, 0.001, 0.01]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "i int, a double, b double, c double")
    cols = ["a", "b", "c"]
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    inv = np.diag(np.linalg.inv(np.corrcoef(z.T)))
    assert np.allclose([r["vif"] for r in multivariate.vif(df, cols).collect()], inv)
    ev = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose([r["variance"] for r in multivariate.pca_dims(df, cols).orderBy("component").collect()], ev / ev.sum())
    flagged = {r["i"] for r in multivariate.mv_outliers(df, cols).filter("flagged").collect()}
    assert 0 in flagged and len(flagged) < 80


def plain_bootstrap(rows, replicates, seed=15):
    """Row by row, draw by draw."""
    out = {}
    bars = poisson_bars()
    for g, v, id_ in rows:
        if v is None:
            continue
        row = int(hashlib.md5(str(id_).encode()).hexdigest()[:8], 16)
        for r in range(replicates):
            key = int(mixed(np.uint32((r * 0x61C88647 + seed * 0x3C6EF35F) % 2**32))[0])
            w = sum(int(mixed(np.uint32(row ^ key))[0]) >= bar for bar in bars)
            n, s = out.get((g, r), (0, 0.0))
            out[g, r] = (n + w, s + w * v)
    return out


def test_bootstrap_against_plain_draws(spark, monkeypatch):
    monkeypatch.setattr(resample, "ROWS", 7)
    monkeypatch.setattr(resample, "REPLICATES", 4)
    monkeypatch.setattr(resample, "GROUPS", 2)
    rows = [(g, None if i % 11 == 0 else float(i), i) for i in range(90) for g in [("a", None, "b", "c|", "d")[i % 5]]] + [("once", 5.0, 3), ("once", 5.0, 3)]
    d = spark.createDataFrame(rows, "g string, v double, id long").repartition(5)
    want = plain_bootstrap(rows, 10)
    for _ in range(2):
        got = {(r["g"], r["replicate"]): (r["n"], r["mean"]) for r in resample.bootstrap(d, ["g"], "v", "id", 10).collect()}
        assert got.keys() == want.keys()
        for k, (n, s) in want.items():
            assert got[k][0] == n and (got[k][1] is None if n == 0 else got[k][1] == pytest.approx(s / n))
    assert any(n == 0 for n, _ in want.values())
    assert resample.bootstrap(d, [], "v", "id", 3).count() == 3 and resample.bootstrap(d.limit(0), ["g"], "v", "id", 3).count() == 0


def test_bootstrap_interval_covers_the_mean(planted):
    _, df = planted
    d = df.filter("g = 'normal'").withColumn("id", F.xxhash64("v"))
    n, mean, sd = (float(x) for x in d.agg(F.count("v"), F.avg("v"), F.stddev("v")).first())
    got = resample.bootstrap_interval(d, ["g"], "v", "id", 3000).first()
    assert got["replicates"] == 3000 and got["lo"] < mean < got["hi"]
    assert got["hi"] - got["lo"] == pytest.approx(2 * 1.96 * sd / n**0.5, rel=0.08)


def test_draws_are_even_and_agree_between_engines(spark):
    x = np.arange(200_000, dtype=np.uint32)
    u = mixed(x ^ stream(7, 1))
    assert abs(u.mean() / 2**32 - 0.5) < 0.004 and abs(np.corrcoef(u, mixed(x ^ stream(8, 1)))[0, 1]) < 0.01
    assert abs(poisson(u).mean() - 1) < 0.01 and abs(poisson(u).var() - 1) < 0.02
    got = [r[0] for r in spark.range(300).select(mixed_column(F.col("id") * 14_316_557)).collect()]
    assert sorted(got) == sorted(mixed((np.arange(300, dtype=np.uint64) * np.uint64(14_316_557)).astype(np.uint32)).tolist())
    sql = f"select h from {mixed_sql('(select i * 14316557 as x from range(0, 300) t(i))', 'x', 'h')}"
    assert sorted(r[0] for r in duckdb.connect().execute(sql).fetchall()) == sorted(got)


def test_pca_query_reads_every_dimension(spark, tmp_path):
    from paylens.queries.statistics import pca_dims

    x = np.random.default_rng(4).normal(size=(300, 13)) @ np.random.default_rng(5).normal(size=(13, 13))
    rows = [(row,) for row in x.tolist()] + [(None,), ([1.0],), ([None] * 13,)]
    d = spark.createDataFrame(rows, "embedding array<double>").repartition(5)
    d.write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    d.limit(0).write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    ev = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1] / 13
    got = pca_dims(spark, str(tmp_path / "a")).orderBy("component").collect()
    assert np.allclose([r["variance"] for r in got], ev, atol=1e-6)
    assert [r["reaches_share"] for r in got].index(True) == int(np.argmax(np.cumsum(ev) >= 0.9))
    assert pca_dims(spark, str(tmp_path / "b")).count() == 0


def test_terms_meet_their_weights_without_being_dealt_by_slot(spark):
    """Weights and coefficients are bounded by the number of slots: rows of terms never move to them."""
    from paylens.operators import classify

    counts = spark.createDataFrame([(1, "w", 3, 2), (1, "c", 9, 1), (2, "w", 3, 1), (3, "w", 4, 1)], "id long, space string, slot int, tf long")
    model = spark.createDataFrame([(-1, "x", 0.5), (-1, "y", 0.0), (3, "x", 2.0), (9, "y", -1.0)], "slot int, class string, coef double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = classify.weighted(counts, classify.idf_table(counts))
        assert "SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString()
        got = {(r["id"], r["class"]): (r["score"], r["proba"]) for r in classify.score(x, model).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = {(1, "x"): 2.5, (1, "y"): -1.0, (2, "x"): 2.5, (2, "y"): 0.0, (3, "x"): 0.5, (3, "y"): 0.0}
    assert {k: round(s, 9) for k, (s, _) in got.items()} == want and abs(got[3, "x"][1] - 1 / (1 + 2.718281828459045**-0.5)) < 1e-9
