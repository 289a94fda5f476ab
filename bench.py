"""Times the headline queries once each and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from paylens.queries import QUERIES  # noqa: E402
from paylens.session import build_session  # noqa: E402

HEADLINE = [
    "pay_summary_by_country",
    "fx_refusals",
    "annualise_by_period",
    "resolve_entity",
    "crosswalk_pairs",
    "parse_pay",
    "country_from_location",
    "strip_html",
    "exact_dupes_by_source",
    "near_dupe_pairs",
    "profile_numeric",
    "quartiles_exclusive",
    "median_ci",
    "outlier_rules",
    "spearman",
    "mann_whitney",
    "noise_test",
    "estimate_and_position",
    "composite",
    "top_k_per_group",
    "findings_magnitude",
    "findings_reconcile",
    "run_snapshot",
    "ledger_merge",
    "cube_flatten",
    "props_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("bench", cpus, cpus)
    names = sys.argv[1:] or HEADLINE
    QUERIES["null_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    secs: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        secs[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {secs[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(secs.values()), 3), "unit": "sec", "queries": secs, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
