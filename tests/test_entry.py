import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "pay_summary_by_country", "resolve_set", "parse_pay", "median_ci", "composite", "ledger_merge", "findings_drift", "cube_flatten", "fx_refusals", "postings_usd", "postings_merge",
    "keyed_upsert", "snapshot_append", "dataset_write", "near_dupe_pairs", "near_dupe_clusters", "indicator_pages", "sdmx_rows", "population_export", "outlook_projections", "wage_table_de",
    "wage_table_uk", "wage_table_au", "wage_table_qa", "metro_quarters", "price_months", "daily_months", "vintage_edition", "board_lever", "board_government", "board_feed", "board_list_detail",
]


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    mine = sorted(repr([r[c] for c in sorted(cols)]) for r in df.collect())
    theirs = sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in cur.fetchall())
    assert mine == theirs
