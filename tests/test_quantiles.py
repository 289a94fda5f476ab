"""Order statistics and ranks of values that crowd into few cells."""

import pytest
from pyspark.sql import functions as F

from paylens.operators import quantiles
from paylens.operators.quantiles import group_quantiles, rank_table


def parts_of(df, by, value):
    """Rows of the fullest sorted part, and number of parts."""
    counts = quantiles.value_counts(df, by, value).withColumn("__c", quantiles.value_cell(F.col("v")))
    ends = counts.groupBy(*by, "__c").agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("__min"), F.max("v").alias("__max"))
    placed = counts.withColumn("__v", F.col("v")).join(ends, [*by, "__c"]).selectExpr(*by, "__c", f"{quantiles._sub_cell('rows')} AS s")
    sizes = placed.groupBy(*by, "__c", "s").count()
    return sizes.agg(F.max("count"), F.count(F.lit(1))).first()


def test_consecutive_seconds_are_spread(spark):
    d = spark.range(2_000_000).select((F.lit(1_700_000_000) + F.col("id")).alias("t"), (F.col("id") % 3 == 0).alias("g"))
    most, parts = parts_of(d, [], "t")
    assert parts > 100 and most <= 2 * quantiles.PART_ROWS
    got = group_quantiles(d, [], "t", {"q1": 0.25, "md": 0.5, "q3": 0.75, "hi": 1.0}).first()
    want = d.selectExpr("percentile(t, array(0.25, 0.5, 0.75, 1.0)) AS p").first()["p"]
    assert [got["q1"], got["md"], got["q3"], got["hi"]] == want
    for r in group_quantiles(d, ["g"], "t", {"p": 0.9}).collect():
        assert r["p"] == pytest.approx(d.filter(F.col("g") == r["g"]).selectExpr("percentile(t, 0.9) AS p").first()["p"], rel=1e-15)


@pytest.mark.parametrize("part_rows", [1, 7, 4096])
def test_ranks_and_quantiles_with_small_parts(spark, monkeypatch, part_rows):
    monkeypatch.setattr(quantiles, "PART_ROWS", part_rows)
    rows = [(g, v) for g in ("a", None) for v in [5.0] * 40 + [1e9 + i * 1e-3 for i in range(300)] + [-1e9 - i for i in range(50)] + [0.0, -0.0, None, 1e308, -1e308]]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {f"p{i}": i / 13 for i in range(14)}
    values = sorted(v for g, v in rows if g == "a" and v is not None)
    for r in group_quantiles(d, ["g"], "v", probs).collect():
        for name, p in probs.items():
            at = p * (len(values) - 1)
            lo, hi = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert r[name] == pytest.approx(lo + (hi - lo) * (at - int(at)), rel=1e-12)
    got = {(r["g"], r["v"]): r for r in rank_table(d, ["g"], "v").collect()}
    for v in set(values):
        r = got["a", v]
        assert r["below"] == sum(x < v for x in values) and r["k"] == values.count(v) and r["n"] == len(values)
