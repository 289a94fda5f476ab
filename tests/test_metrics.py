"""The metric registry."""

import pytest

from paylens.plans.metrics import METRICS, Metric, by_theme, in_steps, metric_rows, with_metrics


def test_registry_is_whole_and_ordered():
    assert len({m.key for m in METRICS}) == len(METRICS) == 30 and {m.theme for m in METRICS} == {"money", "visa", "jobs", "housing", "people", "life", "climate"}
    steps = in_steps(METRICS[::-1])
    seen = set()
    for step in steps:
        assert all(seen.issuperset(m.needs) for m in step)
        seen |= {m.key for m in step}
    assert len(steps) == 4 and [m.key for m in by_theme("jobs")] == ["ict_specialists", "ict_share"]
    for bad in ((Metric("a", "t", "higher", "x", "u", "b", ("b",)), Metric("b", "t", "higher", "x", "u", "a", ("a",))), (Metric("a", "t", "higher", "x", "u", "c", ("c",)),)):
        with pytest.raises(ValueError):
            in_steps(bad)


def test_metrics_follow_from_each_other(spark):
    kinds = (Metric("half", "t", "lower", "x", "u", "whole / 2"), Metric("whole", "t", "lower", "x", "u", "half * 4", ("half",)), Metric("both", "t", "lower", "x", "u", "CASE WHEN half > 1 THEN whole + half END", ("half", "whole")))
    d = spark.createDataFrame([(1, 8.0), (2, None), (3, 1.0)], "id int, whole double")
    got = {(r["id"], r["metric"]): r["value"] for r in metric_rows(d, ["id"], kinds).collect()}
    assert [got[1, k] for k in ("half", "whole", "both")] == [4.0, 16.0, 20.0] and got[2, "both"] is None and got[3, "both"] is None and got[3, "whole"] == 2.0
    plan = with_metrics(d, kinds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    with pytest.raises(ValueError):
        with_metrics(d.withColumnRenamed("whole", "metric_half"), kinds)
