"""Shapiro-Wilk test of normality by Royston's approximation, from exact ranks.

The weight of a rank depends on the size of the group alone, so weights are made once per size and
joined to ranks; a group is never sorted in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.maths import normal_cdf, normal_quantile_sql, polynomial_sql
from paylens.operators.quantiles import rank_table

#: Sizes for which the approximation is published; other groups give no row.
SMALLEST, LARGEST = 3, 5000
# The published coefficients of algorithm AS R94, lowest power first.
#: Of the two outermost weights, in 1 / sqrt(n).
OUTERMOST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
#: Bound, mean and log deviation of the transformed statistic up to 11 rows, in n; mean and log deviation from 12 on, in ln n.
SMALL_BOUND = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
SMALL_DEVIATION = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_DEVIATION = (-0.4803, -0.082676, 0.0030302)

SCORE = normal_quantile_sql("(i - 0.375::DOUBLE) / (n + 0.25::DOUBLE)")
FIRST_SCORE, SECOND_SCORE = (normal_quantile_sql(f"({i} - 0.375::DOUBLE) / (n + 0.25::DOUBLE)") for i in (1, 2))
#: SQL of the weights of a size ``n``: of the outermost rank, the next, and what the other scores are divided by. ``m1``, ``m2``: first scores, ``mm``: sum of squared scores.
FIRST_WEIGHT = f"({polynomial_sql(OUTERMOST, '(1 / sqrt(n))')} - m1 / sqrt(mm))"
SECOND_WEIGHT = f"({polynomial_sql(SECOND, '(1 / sqrt(n))')} - m2 / sqrt(mm))"
DIVISOR = "CASE WHEN n > 5 THEN sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) ELSE sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)) END"
#: SQL of the weight of rank ``i``.
WEIGHT = """CASE WHEN n = 3 THEN (i - 2) * sqrt(0.5::DOUBLE) WHEN i = 1 THEN -a1 WHEN i = n THEN a1 WHEN n > 5 AND i = 2 THEN -a2 WHEN n > 5 AND i = n - 1 THEN a2 ELSE m / divisor END"""
#: SQL of the standardised statistic; up to 11 rows it has a bound beyond which nothing is more unlikely.
SMALL_Z = f"(-ln({polynomial_sql(SMALL_BOUND, 'n')} - ln(1 - w)) - {polynomial_sql(SMALL_MEAN, 'n')}) / exp({polynomial_sql(SMALL_DEVIATION, 'n')})"
LARGE_Z = f"(ln(1 - w) - {polynomial_sql(LARGE_MEAN, 'ln(n)')}) / exp({polynomial_sql(LARGE_DEVIATION, 'ln(n)')})"
Z = f"CASE WHEN n = 3 THEN NULL WHEN n <= 11 AND ln(1 - w) >= {polynomial_sql(SMALL_BOUND, 'n')} THEN 40.0::DOUBLE WHEN n <= 11 THEN {SMALL_Z} ELSE {LARGE_Z} END"


def weights(sizes: DataFrame) -> DataFrame:
    """``n, i, a`` for every size in ``sizes`` (n)."""
    scores = sizes.selectExpr("n", "explode(sequence(1, n)) AS i").selectExpr("n", "i", f"{SCORE} AS m")
    total = scores.groupBy("n").agg(F.sum(F.col("m") * F.col("m")).alias("mm")).selectExpr("n", "mm", f"{FIRST_SCORE} AS m1", f"{SECOND_SCORE} AS m2")
    total = total.selectExpr("*", f"{FIRST_WEIGHT} AS a1", f"{SECOND_WEIGHT} AS a2").selectExpr("*", f"{DIVISOR} AS divisor")
    return scores.join(total, "n").selectExpr("n", "i", f"{WEIGHT} AS a")


def shapiro_wilk(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by, n, w, p`` of the groups of 3 to 5000 values that are not all equal; nulls are left out."""
    by = list(by)
    ranks = rank_table(df, by, value).filter(F.col("n").between(SMALLEST, LARGEST)).withColumn("n", F.col("n").cast("int"))
    ranks = ranks.selectExpr(*[f"`{k}`" for k in by], "n", "v", "explode(sequence(CAST(below AS INT) + 1, CAST(below + k AS INT))) AS i")
    w = weights(ranks.select("n").distinct())
    sums = ranks.join(w, ["n", "i"]).groupBy(*by, "n").agg(F.sum(F.col("a") * F.col("v")).alias("s"), (F.var_pop("v") * F.count("v")).alias("ss"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out = sums.filter("lo < hi").withColumn("w", F.least(F.lit(1.0), F.col("s") * F.col("s") / F.col("ss")))
    # of three values W has a closed distribution
    three = F.greatest(F.lit(0.0), F.lit(6 / math.pi) * (F.asin(F.sqrt("w")) - F.lit(math.asin(math.sqrt(0.75)))))
    z = F.expr(Z)
    return out.withColumn("z", z).select(*by, "n", "w", F.when(F.col("n") == 3, three).when(F.col("w") >= 1, 1.0).otherwise(1 - normal_cdf(F.col("z"))).alias("p"))
