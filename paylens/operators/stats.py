"""Statistics that state their own uncertainty, over any number of groups.

Every function is map-side combined aggregation plus the exact order statistics of
:mod:`paylens.operators.quantiles`; no group is collected, nothing is resampled row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions.maths import chi2_tail, normal_cdf, normal_quantile
from paylens.operators.quantiles import group_median, group_quantiles, order_stats, rank_table, value_cell
from paylens.operators.shapiro import shapiro_wilk

# Least numbers of values the statistics are given for.
MIN_PROFILE, MIN_ESTIMATOR, MIN_AGREEMENT, MIN_TAIL, MIN_BENFORD, MIN_SERIES = 12, 12, 8, 20, 50, 36
# Rounding steps tried, largest first.
STEPS = (100_000, 50_000, 25_000, 10_000, 5_000, 1_000, 500, 100, 50, 10, 5, 1)
MAD_SCALE, MAD_LIMIT = 0.6745, 3.5


def _present(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*by, v.alias("v")).filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) <> double('Infinity')")


def _with(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group results null-safe; without groups both are one row."""
    if not by:
        return a.join(F.broadcast(b))
    right = b.select(*[F.col(k).alias(f"__by_{k}") for k in by], *[c for c in b.columns if c not in by])
    cond = F.expr(" AND ".join(f"`{k}` <=> `__by_{k}`" for k in by))
    return a.join(right, cond).drop(*[f"__by_{k}" for k in by])


def _with_left(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """As ``_with``; groups that ``b`` lacks stay."""
    if not by:
        return a.join(F.broadcast(b), how="left")
    right = b.select(*[F.col(k).alias(f"__by_{k}") for k in by], *[c for c in b.columns if c not in by])
    return a.join(right, F.expr(" AND ".join(f"`{k}` <=> `__by_{k}`" for k in by)), "left").drop(*[f"__by_{k}" for k in by])


def estimator_error(df: DataFrame, by: Sequence[str], value: str, min_n: int = MIN_ESTIMATOR) -> DataFrame:
    """How far the mean is from the median and the geometric mean, with shape."""
    d = _present(df, by, value)
    agg = d.groupBy(*by).agg(
        F.avg("v").alias("mean"),
        F.when(F.min("v") > 0, F.exp(F.avg(F.ln(F.when(F.col("v") > 0, F.col("v")))))).alias("geometric_mean"),
        F.skewness("v").alias("skew"),
        F.kurtosis("v").alias("excess_kurtosis"),
    )
    out = _with(group_median(d, by, "v"), agg, by).filter(F.col("n") >= min_n)
    gap = lambda base: 100 * F.try_divide(F.col("mean") - F.col(base), F.col(base))
    return out.withColumns({"mean_vs_median_pct": gap("median"), "mean_vs_geomean_pct": gap("geometric_mean")})


def profile_numeric(df: DataFrame, by: Sequence[str], value: str, min_n: int = MIN_PROFILE) -> DataFrame:
    """Counts, spread and shape of a numeric field."""
    d = _present(df, by, value)
    raw = df.groupBy(*by).agg(F.count(F.lit(1)).alias("raw_n"))
    distinct = d.groupBy(*by, "v").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("one").alias("n_distinct"))
    agg = d.groupBy(*by).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
        F.skewness("v").alias("skew"), F.kurtosis("v").alias("excess_kurtosis"),
        F.when(F.min("v") > 0, F.exp(F.avg(F.ln(F.when(F.col("v") > 0, F.col("v")))))).alias("geometric_mean"),
    )
    q = group_quantiles(d, by, "v", {"median": 0.5, "q1": 0.25, "q3": 0.75}).filter(F.col("n") >= min_n)
    out = _with(_with(_with(q, agg, by), distinct, by), raw, by)
    return out.select(
        *by, "n", (F.col("raw_n") - F.col("n")).alias("n_missing"), "n_distinct",
        (100 * (1 - F.col("n_distinct") / F.col("n"))).alias("duplicate_rate_pct"),
        "min", "max", "mean", "median", "sd", (F.col("q3") - F.col("q1")).alias("iqr"), "skew", "excess_kurtosis", "geometric_mean",
    )


def profile_categorical(df: DataFrame, cols: Sequence[str], min_n: int = MIN_PROFILE) -> DataFrame:
    """Cardinality, mode, singletons and rare levels of several fields in one pass.

    The most frequent level wins; ties go to the smaller text.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("level")) for c in cols]))
    levels = df.select(pairs.alias("p")).select("p.*").groupBy("field", "level").agg(F.count(F.lit(1)).alias("k"))
    total = levels.groupBy("field").agg(F.sum("k").alias("raw_n"), F.sum(F.when(F.col("level").isNotNull(), F.col("k")).otherwise(0)).alias("n"))
    known = levels.filter("level IS NOT NULL").join(F.broadcast(total), "field")  # one row per field
    out = known.groupBy("field").agg(
        F.max("n").alias("n"),
        F.max(F.col("raw_n") - F.col("n")).alias("n_missing"),
        F.count(F.lit(1)).alias("cardinality"),
        F.min(F.struct((-F.col("k")).alias("k"), "level")).alias("m"),
        F.count_if(F.col("k") == 1).alias("singleton_levels"),
        F.count_if(F.col("k") / F.col("n") < 0.01).alias("rare_levels"),
    )
    return out.filter(F.col("n") >= min_n).select(
        "field", "n", "n_missing", "cardinality", F.col("m.level").alias("mode"),
        (100 * -F.col("m.k") / F.col("n")).alias("mode_share_pct"), "singleton_levels", "rare_levels",
    )


def hill(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Hill index of the right tail over the k = max(5, min(n/5, 50)) largest positive values.

    At most 51 values per group survive the rank filter, which Spark applies before the exchange.
    """
    pos = _present(df, by, value).filter("v > 0")
    n = pos.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_TAIL)
    w = Window.partitionBy(*by if by else [F.lit(0)]).orderBy(F.desc("v"))
    top = pos.withColumn("rn", F.row_number().over(w)).filter("rn <= 51")
    k = F.greatest(F.lit(5), F.least(F.floor(F.col("n") / 5), F.lit(50)))
    top = _with(top, n, by).withColumn("k", k)
    agg = top.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("k").alias("k"),
        F.avg(F.when(F.col("rn") <= F.col("k"), F.ln("v"))).alias("m"), F.max(F.when(F.col("rn") == F.col("k") + 1, F.ln("v"))).alias("x"),
    )
    return agg.select(*by, "n", "k", F.when(F.col("m") > F.col("x"), 1.0 / (F.col("m") - F.col("x"))).alias("alpha"))


def granularity(df: DataFrame, by: Sequence[str], value: str, min_n: int = MIN_PROFILE) -> DataFrame:
    """Largest step that at least 90 % of the whole values are multiples of."""
    d = _present(df, by, value).filter("v = floor(v)")
    agg = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("v") % s == 0).alias(f"s{s}") for s in STEPS])
    step = F.coalesce(*[F.when(F.col(f"s{s}") / F.col("n") >= 0.9, s) for s in STEPS])
    return agg.filter(F.col("n") >= min_n).select(*by, "n", step.alias("step"))


def digit_heaping(df: DataFrame, by: Sequence[str], value: str, min_n: int = MIN_PROFILE) -> DataFrame:
    """Terminal digits of whole values against a uniform distribution."""
    d = _present(df, by, value).filter("v = floor(v) AND v <> 0")
    digit = F.abs(F.col("v")) % 10
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("v") % 5 == 0).alias("m5"), F.count_if(F.col("v") % 100 == 0).alias("m100"), F.count_if(F.col("v") % 1000 == 0).alias("m1000"),
        *[F.count_if(digit == i).alias(f"d{i}") for i in range(10)],
    )
    expected = F.col("n") / 10.0
    chi2 = sum(((F.col(f"d{i}") - expected) * (F.col(f"d{i}") - expected) / expected for i in range(10)), F.lit(0.0))
    pct = lambda c: 100 * F.col(c) / F.col("n")
    out = agg.filter(F.col("n") >= min_n).withColumn("chi2", chi2).withColumn("p", chi2_tail(F.col("chi2"), 9))
    return out.select(
        *by, "n", pct("m5").alias("ends_in_0_or_5_pct"), pct("m100").alias("ends_in_00_pct"), pct("m1000").alias("ends_in_000_pct"),
        "chi2", "p", (F.col("p") < 0.01).alias("rejected"),
    )


# ------------------------------------------------------------------ intervals


def _boot_rank(z: str) -> str:
    """Rank (from 0) of the order statistic where the bootstrap distribution of a median passes the
    normal score ``z``: a resampled median is at or below the j-th value when at least half of n draws
    fall there, a binomial event whose score equation solves in closed form."""
    return f"greatest(0, least(CAST(ceil(__n * (0.5D + 0.5D * ({z}) / sqrt(__n + ({z}) * ({z})))) AS BIGINT) - 1, __n - 1))"


def median_ci(df: DataFrame, by: Sequence[str], value: str, min_n: int = MIN_ESTIMATOR, alpha: float = 0.05) -> DataFrame:
    """Median with its percentile bootstrap interval in the limit of many replicates."""
    z = normal_quantile(1 - alpha / 2)
    mid = {"__m0": "floor((__n - 1) / 2)", "__m1": "ceil((__n - 1) / 2)"}
    out = order_stats(df, by, value, {**mid, "lo": _boot_rank(f"-{z!r}D"), "hi": _boot_rank(f"{z!r}D")})
    out = out.withColumn("median", (F.col("__m0") + F.col("__m1")) / 2).filter(F.col("n") >= min_n)
    return out.select(*by, "n", "median", "lo", "hi", (100 * F.try_divide(F.col("hi") - F.col("lo"), 2 * F.col("median"))).alias("half_width_pct"))


def median_bca(df: DataFrame, by: Sequence[str], value: str, min_n: int = MIN_ESTIMATOR, alpha: float = 0.05) -> DataFrame:
    """Median with its bias-corrected and accelerated interval.

    Leaving one value out gives at most three different medians, so bias and acceleration follow
    from the values around the middle; the interval is read off at the corrected ranks.
    """
    around = {"a": "greatest(0, floor((__n - 1) / 2) - 1)", "b": "floor((__n - 1) / 2)", "c": "least(__n - 1, floor((__n - 1) / 2) + 1)"}
    base = order_stats(df, by, value, around).filter(F.col("n") >= min_n)
    odd = F.col("n") % 2 == 1
    half = F.floor(F.col("n") / 2)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    low, mid, high = (a + b) / 2, (a + c) / 2, (b + c) / 2  # one left out above, at, below the middle
    mean = (half * low + mid + half * high) / F.col("n")
    dev = lambda x: mean - x
    cube = half * F.pow(dev(low), 3) + F.pow(dev(mid), 3) + half * F.pow(dev(high), 3)
    square = half * F.pow(dev(low), 2) + F.pow(dev(mid), 2) + half * F.pow(dev(high), 2)
    base = base.select(
        *by, "n",
        F.when(odd, b).otherwise((b + c) / 2).alias("median"),
        F.when(odd, F.lit(-0.5) / F.sqrt(half * (1 - half / F.col("n")))).otherwise(0.0).alias("z0"),
        F.when(odd & (square > 0), cube / (6 * F.pow(square, 1.5))).otherwise(0.0).alias("acceleration"),
    )
    z = normal_quantile(1 - alpha / 2)
    score = lambda t: F.col("z0") + (F.col("z0") + t) / (1 - F.col("acceleration") * (F.col("z0") + t))
    base = base.withColumns({"__zl": score(F.lit(-z)), "__zu": score(F.lit(z))})
    keyed = _with(_present(df, by, value), base.select(*by, "__zl", "__zu"), by)
    groups = [*by, "__zl", "__zu"]  # the scores are a function of the group
    ends = order_stats(keyed, groups, "v", {"lo": _boot_rank("__zl"), "hi": _boot_rank("__zu")})
    return _with(base.drop("__zl", "__zu"), ends.select(*by, "lo", "hi"), by)


def uniform_of(*parts: Column) -> Column:
    """Repeatable uniform number in [0, 1) from the text of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


# ------------------------------------------------------------------- outliers


def outlier_flags(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Every row with three verdicts that are not reconciled: quartile fence, robust z, log fence.

    The log fence takes over where all values are positive and skewed, else it repeats the first.
    """
    d = df.filter(F.col(value).isNotNull())
    ranks = {}
    for name, p in (("q1", 0.25), ("md", 0.5), ("q3", 0.75)):
        ranks[f"{name}l"] = f"floor({p}D * (__n - 1))"
        ranks[f"{name}h"] = f"ceil({p}D * (__n - 1))"
    q = order_stats(d, by, value, ranks)
    frac = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    lin = lambda name, p: F.col(f"{name}l") + (F.col(f"{name}h") - F.col(f"{name}l")) * frac(p)
    log = lambda name, p: F.ln(f"{name}l") + (F.ln(f"{name}h") - F.ln(f"{name}l")) * frac(p)
    shape = d.groupBy(*by).agg(F.min(value).alias("__min"), F.skewness(value).alias("__skew"))
    skewed = F.coalesce((F.col("__min") > 0) & (F.col("__skew") > 0.5), F.lit(False))
    stats = _with(q, shape, by).select(
        *by, lin("q1", 0.25).alias("q1"), lin("md", 0.5).alias("med"), lin("q3", 0.75).alias("q3"), skewed.alias("__skewed"),
        F.when(skewed, log("q1", 0.25)).alias("lq1"), F.when(skewed, log("q3", 0.75)).alias("lq3"),
    )
    if not by:  # one row
        stats = F.broadcast(stats)
    rows = _with(d, stats, by).withColumn("__dev", F.abs(F.col(value) - F.col("med")))
    mad = group_median(rows, by, "__dev", "mad").drop("n")
    if not by:  # one row
        mad = F.broadcast(mad)
    v, iqr, liqr = F.col(value), F.col("q3") - F.col("q1"), F.col("lq3") - F.col("lq1")
    fence = (v < F.col("q1") - 1.5 * iqr) | (v > F.col("q3") + 1.5 * iqr)
    robust = F.coalesce(F.when(F.col("mad") > 0, F.abs(MAD_SCALE * (v - F.col("med")) / F.col("mad")) > MAD_LIMIT), F.lit(False))
    lv = F.ln(F.when(v > 0, v))
    logged = F.when(F.col("__skewed"), (lv < F.col("lq1") - 1.5 * liqr) | (lv > F.col("lq3") + 1.5 * liqr)).otherwise(fence)
    return _with(rows, mad, by).select(*df.columns, fence.alias("iqr_fence"), robust.alias("robust_z"), logged.alias("log_fence"))


def outlier_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    f = outlier_flags(df, by, value)
    votes = sum((F.col(c).cast("int") for c in ("iqr_fence", "robust_z", "log_fence")), F.lit(0))
    return f.withColumn("votes", votes).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("iqr_fence").alias("iqr_fence_n"), F.count_if("robust_z").alias("robust_z_n"),
        F.count_if("log_fence").alias("log_fence_n"), F.count_if(F.col("votes") == 3).alias("by_all_n"), F.count_if(F.col("votes") > 0).alias("by_any_n"),
    )


def ratio_outliers(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose ratio b/a stands more than 3.5 robust z from the median ratio."""
    rows = df.filter((F.col(a) != 0) & (F.col(b) != 0)).withColumn("ratio", F.col(b) / F.col(a))
    med = F.broadcast(group_median(rows, [], "ratio", "ratio_median").drop("n"))
    rows = rows.join(med).withColumn("__dev", F.abs(F.col("ratio") - F.col("ratio_median")))
    mad = F.broadcast(group_median(rows, [], "__dev", "__mad").drop("n"))
    z = F.try_divide(MAD_SCALE * (F.col("ratio") - F.col("ratio_median")), F.col("__mad"))
    return rows.join(mad).withColumn("robust_z", z).drop("__dev", "__mad").filter(F.abs("robust_z") > MAD_LIMIT)


# ------------------------------------------------------------------ agreement


def bland_altman(df: DataFrame, by: Sequence[str], x: str, y: str, log_space: bool = True, min_n: int = MIN_AGREEMENT) -> DataFrame:
    """Bias and limits of agreement of two measurements of the same thing, with Pearson's r."""
    d = df.filter((F.col(x) > 0) & (F.col(y) > 0))
    diff = F.ln(y) - F.ln(x) if log_space else F.col(y) - F.col(x)
    out = d.withColumn("__d", diff).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__d").alias("bias"), F.stddev_samp("__d").alias("__sd"), F.corr(x, y).alias("pearson_r")
    )
    out = out.filter(F.col("n") >= min_n)
    show = F.exp if log_space else (lambda c: c)
    return out.select(
        *by, "n", show(F.col("bias")).alias("bias"), show(F.col("bias") - 1.96 * F.col("__sd")).alias("loa_lo"),
        show(F.col("bias") + 1.96 * F.col("__sd")).alias("loa_hi"), "pearson_r",
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties.

    Both rank tables hold one row per distinct value, so pairs are counted per (x, y) first.
    """
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    pairs = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    weighted = lambda c: pairs.groupBy(F.col(c).alias("v")).agg(F.sum("k").alias("k")).withColumn("__c", value_cell(F.col("v")))
    from paylens.operators.quantiles import _ranked

    rx = _ranked(weighted("x"), []).select(F.col("v").alias("x"), F.col("avg_rank").alias("rx"))
    ry = _ranked(weighted("y"), []).select(F.col("v").alias("y"), F.col("avg_rank").alias("ry"))
    d = pairs.join(rx, "x").join(ry, "y")
    s = lambda e: F.sum(F.col("k") * e)
    m = d.agg(s(F.lit(1.0)).alias("n"), s(F.col("rx")).alias("sx"), s(F.col("ry")).alias("sy"), s(F.col("rx") * F.col("rx")).alias("sxx"),
              s(F.col("ry") * F.col("ry")).alias("syy"), s(F.col("rx") * F.col("ry")).alias("sxy"))
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    return m.select(F.col("n").cast("long").alias("n"), F.try_divide(num, den).alias("spearman_r"))


def deming(df: DataFrame, by: Sequence[str], x: str, y: str, lam: float = 1.0, min_n: int = MIN_AGREEMENT) -> DataFrame:
    """Regression with error on both sides (``lam``: ratio of error variances) beside the ordinary slope."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("sxx"),
        F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"),
    )
    gap = F.col("syy") - lam * F.col("sxx")
    slope = F.try_divide(gap + F.sqrt(gap * gap + 4 * lam * F.col("sxy") * F.col("sxy")), 2 * F.col("sxy"))
    out = d.filter((F.col("n") >= min_n) & (F.col("sxy") != 0)).withColumn("slope", slope)
    return out.select(*by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), F.try_divide("sxy", "sxx").alias("ols_slope"))


def heaping_shares(df: DataFrame, by: Sequence[str], value: str, steps: Sequence[int] = (5, 1000)) -> DataFrame:
    """Per group the number of whole values and the percentage that is a multiple of each step."""
    d = df.filter(F.col(value).isNotNull())
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[(100 * F.count_if(F.col(value) % s == 0) / F.count(F.lit(1))).alias(f"multiples_of_{s}_pct") for s in steps])


def keyword_census(df: DataFrame, by: Sequence[str], text: str, words: Sequence[str]) -> DataFrame:
    """Per group how many texts hold each word, case aside, in one pass; a null text holds none."""
    low = F.lower(text)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.contains(low, F.lit(w.lower()))).alias(f"has_{w.lower()}") for w in words])


def benford(df: DataFrame, by: Sequence[str], value: str, min_n: int = MIN_BENFORD) -> DataFrame:
    """Mean absolute deviation of first digits from Benford's law and whether it may be read at all."""
    import math

    d = _present(df, by, value).filter("v > 0").withColumn("d", F.substring(F.format_string("%.10e", "v"), 1, 1))
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.log10(F.max("v") / F.min("v")).alias("orders"), *[F.count_if(F.col("d") == str(i)).alias(f"d{i}") for i in range(1, 10)]
    )
    mad = sum((F.abs(F.col(f"d{i}") / F.col("n") - math.log10(1 + 1 / i)) for i in range(1, 10)), F.lit(0.0)) / 9
    return agg.filter(F.col("n") >= min_n).select(*by, "n", mad.alias("mad"), "orders", (F.col("orders") >= 3).alias("interpretable"))


def mann_whitney(df: DataFrame, group: Column, value: str) -> DataFrame:
    """One-sided test that rows where ``group`` holds tend to be larger; ties corrected.

    Works on distinct values with their counts, so no row is ranked twice.
    """
    d = df.select(F.col(value).cast("double").alias("v"), group.cast("int").alias("g")).dropna()
    ranks = rank_table(d, [], "v").select("v", F.col("k").alias("ties"), "avg_rank", "n")
    first = d.groupBy("v").agg(F.sum("g").alias("k1"))
    t = F.col("ties").cast("double")
    m = ranks.join(first, "v").agg(
        F.max("n").cast("double").alias("n"), F.sum("k1").cast("double").alias("n1"), F.sum(F.col("k1") * F.col("avg_rank")).alias("r1"),
        F.sum(t * t * t - t).alias("tie"),
    )
    n, n1 = F.col("n"), F.col("n1")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1))))
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, sigma)
    return m.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), z.alias("z"), (1 - normal_cdf(z)).alias("p"))


def normality(df: DataFrame, by: Sequence[str], value: str, min_n: int = MIN_PROFILE) -> DataFrame:
    """Distance from a fitted normal on the raw and on the log scale, and which fits better.

    Kolmogorov's D, the Anderson-Darling statistic and Shapiro-Wilk's W with its p, from the exact ranks
    of distinct values. The log scale fits better where its p is larger; groups beyond the sizes of
    that test, and those where both p are nil, are told by D.
    """
    pos = _present(df, by, value).filter("v > 0").withColumn("lv", F.ln("v"))
    m = pos.groupBy(*by).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.avg("lv").alias("lm"), F.stddev_samp("lv").alias("ls"))
    r = _with(rank_table(pos, by, "v"), m, by)
    eps = 1e-12
    clip = lambda c: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), c))
    lo, hi = F.col("below") / F.col("n"), (F.col("below") + F.col("k")) / F.col("n")

    def measures(cdf: Column, tag: str) -> list[Column]:
        gap = F.greatest(hi - cdf, cdf - lo)
        # sum over tied ranks i of (2i-1) ln F + (2(n-i)+1) ln(1-F)
        odd = F.col("k") * (2 * F.col("below") + F.col("k"))
        even = F.col("k") * 2 * F.col("n") - odd
        return [F.max(gap).alias(f"ks_{tag}"), F.sum(odd * F.ln(cdf) + even * F.ln(1 - cdf)).alias(f"__a_{tag}")]

    raw = clip(normal_cdf((F.col("v") - F.col("m")) / F.col("s")))
    log = clip(normal_cdf((F.ln("v") - F.col("lm")) / F.col("ls")))
    r = r.filter("s > 0 AND ls > 0").withColumns({"__raw": raw, "__log": log})
    out = r.groupBy(*by).agg(F.max("n").alias("n"), *measures(F.col("__raw"), "raw"), *measures(F.col("__log"), "log"))
    ad = lambda t: -F.col("n") - F.col(f"__a_{t}") / F.col("n")
    # fixed values: the 5 % point of the statistic with fitted mean and deviation, and its correction for n rows
    bar = F.round(F.lit(0.787) / (1 + 4 / F.col("n") - 25 / (F.col("n") * F.col("n"))), 3)
    sw = [shapiro_wilk(pos, by, c).drop("n").withColumnsRenamed({"w": f"w_{tag}", "p": f"p_{tag}"}) for c, tag in (("v", "raw"), ("lv", "log"))]
    told = out.filter(F.col("n") >= min_n).select(*by, "n", "ks_raw", "ks_log", ad("raw").alias("ad_raw"), ad("log").alias("ad_log"), (ad("raw") > bar).alias("rejects_normal"))
    for s in sw:
        told = _with_left(told, s, by)
    by_p = F.when(F.greatest("p_raw", "p_log") > 0, F.col("p_log") > F.col("p_raw"))
    log_fits = F.coalesce(by_p, F.col("ks_log") < F.col("ks_raw"))
    return told.withColumn("better_fit", F.when(log_fits, "log-normal").otherwise("normal-ish"))


# ------------------------------------------------------------------- by field


def missingness(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Missing values per field and group, one pass."""
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("of"), *[F.count_if(F.col(f).isNull()).alias(f"__{f}") for f in fields])
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("missing")) for f in fields]
    return agg.select(*by, "of", F.explode(F.array(*rows)).alias("r")).select(*by, "of", "r.*")


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson's r of every pair of columns, one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    agg = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    return agg.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def lineage(df: DataFrame, derived_from: dict[str, Sequence[str]], cols: Sequence[str]) -> DataFrame:
    """Pairs of columns where one is computed from the other, with their log correlation:
    agreement by definition, not evidence."""
    edges = [(d, s) for d, srcs in derived_from.items() for s in srcs if d in cols and s in cols]
    logs = df.filter(" AND ".join(f"`{c}` > 0" for c in cols)).select(*[F.ln(c).alias(c) for c in cols])
    agg = logs.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in edges])
    rows = [F.struct(F.lit(a).alias("derived"), F.lit(b).alias("input"), F.col(f"`{a}|{b}`").alias("r")) for a, b in edges]
    return agg.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def implied_yield(df: DataFrame, by: Sequence[str], rent: str, price: str, m2: float = 60.0) -> DataFrame:
    """Median of 12 x rent over (m2 x price per m2), rows without either left out."""
    d = df.filter((F.col(rent) != 0) & (F.col(price) != 0)).withColumn("__y", 12 * F.col(rent) / (m2 * F.col(price)))
    return group_median(d, by, "__y", "median_yield")


def temporal_gap(df: DataFrame, entity: Sequence[str], year: str, value: str, min_n: int = 6) -> DataFrame:
    """Mean against median of the points of one year: what averaging within a year costs."""
    d = df.filter(F.col(value) > 0)
    keys = [*entity, year]
    med = group_median(d, keys, value).filter(F.col("n") >= min_n)
    out = _with(med, d.groupBy(*keys).agg(F.avg(value).alias("mean")), keys)
    return out.withColumn("gap_pct", F.abs(100 * (F.col("mean") - F.col("median")) / F.col("median")))


def noise_test(df: DataFrame, entity: Sequence[str], t: str, value: str, min_n: int = MIN_SERIES) -> DataFrame:
    """Tells a smooth level series from one with independent jitter on every point.

    Lag-1 and lag-2 autocorrelation of the residual about a cubic trend, and lag-1 of the period
    change. The trend comes from polynomials that are orthogonal on equally spaced points, whose
    coefficients are plain sums. Windows run over the points of one series.
    """
    w = Window.partitionBy(*entity).orderBy(t)
    whole = Window.partitionBy(*entity)
    s = df.filter(F.col(value).isNotNull()).select(*entity, t, F.col(value).cast("double").alias("y"))
    s = s.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(whole)}).filter(F.col("n") >= min_n)
    n = F.col("n").cast("double")
    x = F.col("i") - (n - 1) / 2
    s = s.withColumns({"p1": x, "p2": x * x - (n * n - 1) / 12, "p3": x * x * x - x * (3 * n * n - 7) / 20})
    coef = lambda p: F.sum(F.col("y") * F.col(p)).over(whole) / F.sum(F.col(p) * F.col(p)).over(whole)
    fit = F.avg("y").over(whole) + sum((coef(p) * F.col(p) for p in ("p1", "p2", "p3")), F.lit(0.0))
    prev = F.lag("y").over(w)
    s = s.select(*entity, t, "n", (F.col("y") - fit).alias("r"), F.try_divide(F.col("y") - prev, prev).alias("c"))
    s = s.withColumns({"r": F.col("r") - F.avg("r").over(whole), "cm": F.col("c") - F.avg("c").over(whole)})
    s = s.withColumns({"r1": F.lag("r", 1).over(w), "r2": F.lag("r", 2).over(w), "c1": F.lag("cm", 1).over(w)})
    acf = lambda a, b: F.try_divide(F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) * F.col(a)))
    out = s.groupBy(*entity).agg(
        F.max("n").alias("n"), acf("r", "r1").alias("residual_acf1"), acf("r", "r2").alias("residual_acf2"),
        acf("cm", "c1").alias("change_acf1"), (100 * F.stddev_samp("c")).alias("change_sd_pct"),
    )
    return out.withColumn("noisy", (F.col("residual_acf1") < 0.60) & (F.col("change_acf1") < -0.25))
