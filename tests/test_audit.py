from pyspark.sql import functions as F

from paylens.plans.audit import Evidence, statistical_audit


def test_findings_are_settled_in_groups(spark):
    """The result reads written findings; before, it was one plan over all of them."""
    posts = spark.range(200).select(
        F.concat(F.lit("p"), F.col("id") % 2).alias("provider"), F.concat(F.lit("c"), F.col("id") % 30).alias("company"), F.concat(F.lit("l"), F.col("id") % 3).alias("country"),
        F.when(F.col("id") % 4 == 0, "BUILDING F").otherwise("OTHER O").alias("title"), (1000.0 + 37 * (F.col("id") % 50)).alias("pay"), (2000 + F.col("id") % 5).cast("int").alias("year"),
    )
    series = spark.range(12).select(F.concat(F.lit("e"), F.col("id") % 3).alias("entity"), (2000 + (F.col("id") / 3).cast("int")).alias("year"), (100.0 + F.col("id")).alias("value"))
    homes = spark.range(60).select(F.concat(F.lit("h"), F.col("id") % 2).alias("group"), (10.0 + F.col("id")).alias("rent"), (1000.0 + F.col("id") * F.col("id")).alias("price"))
    derived = spark.range(50).select((1.0 + F.col("id")).alias("net"), (2.0 + F.col("id") % 7).alias("gross"))
    out = statistical_audit(posts, series, more=Evidence(homes=homes, derived=derived, graph={"net": ["gross"]}))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    findings = {r["finding"] for r in rows}
    assert {"keyword_census", "exact_duplicates", "heaping", "estimator_error", "benford", "growth", "missingness", "implied_yield", "yield_test", "lineage"} <= findings
    assert [r["value"] for r in rows if (r["finding"], r["measure"]) == ("keyword_census", "n")] == [200.0]
    assert plan.count("Aggregate") < 10 and plan.count("Window") < 10
