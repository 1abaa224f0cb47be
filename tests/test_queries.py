"""A cross-section of the registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["b07_quantile_cap", "d03_windowed_rfm", "e01_lag_gap", "e02_nth_purchase", "e11_fold_assign", "h04_elbow_chord",
         "j05_expected_purchases", "k04_kaplan_meier", "k17_concordance", "k28_brier_ipcw", "l05_scorecard", "m06b_auc"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events").split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert got == sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_previous_time_plan_is_never_one_partition(spark):
    plan = entry.queries()["e01_lag_gap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["b09_clean", "d01_customer_summary", "k04_kaplan_meier"])
def test_log_is_cleaned_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # what is left reads the written lines
    assert "lineitem.parquet" not in plan and "Expand" not in plan
