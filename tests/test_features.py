import pytest
from pyspark.sql import functions as F

from tenure.operators import btyd, clean, features, labels, report


def test_gap_statistics(tx):
    stats = {r.customer_id: r for r in features.gap_stats(features.gaps(features.invoice_dates(tx))).collect()}
    assert 2 not in stats
    assert (stats[1].avg_gap, stats[1].min_gap, stats[1].max_gap, stats[1].last_gap) == (3.0, 0, 6, 6)
    assert stats[3].std_gap == 0 and stats[3].last_gap == 0


def test_first_and_second_purchase_and_label(tx):
    cp = labels.first_second(features.invoice_dates(tx))
    got = {r.customer_id: (r.total_invoices, r.label) for r in labels.conversion(cp, features.observation_end(tx), 20).collect()}
    assert got == {1: (3, 1), 2: (1, 0), 3: (2, 1)}


def test_first_invoice_breaks_ties_by_invoice(spark):
    df = spark.createDataFrame([(1, "b", "2020-01-01"), (1, "a", "2020-01-01")], "customer_id int, invoice string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert features.first_invoice(df).first().invoice == "a"


def test_first_invoice_features(tx):
    row = {r.customer_id: r for r in features.first_invoice_features(tx, "X", {}, {"has_a": "A"}).collect()}
    assert row[1].first_num_lines == 2 and row[1].first_spend_concentration == pytest.approx(0.5) and row[1].has_a == 1
    assert (row[1].is_uk, row[2].is_uk) == (1, 0)


def test_rfm_counts_days(tx):
    got = {r.customer_id: r for r in btyd.rfm(tx).collect()}
    assert (got[1].frequency, got[1].recency, got[1].monetary_value) == (1.0, 7.0, 12.0)
    assert (got[2].frequency, got[2].recency, got[2].monetary_value) == (0.0, 0.0, 0.0)
    assert got[3].recency == 1.0


def test_clean_rules(spark):
    rows = [("1", 1, 1.0, 5), ("C2", 1, 1.0, 5), ("3", -1, 1.0, 5), ("4", 1, 0.0, 5), ("5", 1, 1.0, None), ("1", 1, 1.0, 5)]
    df = spark.createDataFrame(rows, "invoice string, quantity int, price double, customer_id int")
    assert clean.clean(df, outlier="none").count() == 1
    assert clean.clean(df, dedup_rows=False, outlier="none").count() == 2


def test_iqr_is_sequential(spark):
    rows = [(q, float(p)) for q, p in [(1, 10), (2, 11), (3, 12), (2, 13), (1, 14), (500, 900)]]
    df = spark.createDataFrame(rows, "quantity int, price double")
    assert clean.iqr_fence(df).count() == 5


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "v double")
    assert [r.bin for r in features.bin_equal_width(df, "v", 10).orderBy("v").collect()] == [1, 1, 2, 10]


def test_histogram_top_edge_and_density(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    got = features.histogram(df, "v", 2, density=True).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in got] == [(1, 1), (2, 2)]
    assert sum(r.density * 5 for r in got) == pytest.approx(1)


def test_ground_truth_keeps_missing_as_zero(tx):
    train, holdout = labels.cutoff_split(tx, 1)
    got = {r.customer_id: (r.actual_clv_6m, r.returned) for r in labels.ground_truth(train, holdout).collect()}
    assert got == {1: (0.0, 0), 2: (0.0, 0)}


def test_split_is_stable_under_repartition(spark):
    df = spark.range(200).withColumnRenamed("id", "customer_id")
    a = {r.customer_id: r.split for r in labels.split(df).collect()}
    b = {r.customer_id: r.split for r in labels.split(df.repartition(7)).collect()}
    assert a == b and sum(v == "test" for v in a.values()) == 40


def test_overlapping_split_raises(spark):
    df = spark.createDataFrame([("train", "2020-02-01"), ("test", "2020-01-01")], "split string, d string").withColumn("first_purchase_date", F.col("d").cast("timestamp"))
    with pytest.raises(Exception):
        labels.assert_no_overlap(df).collect()


def test_crosstab_margins(spark):
    df = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "x")], "a string, b string")
    got = {r.a: (r.x, r.y, r.All) for r in report.crosstab(df, "a", "b", ["x", "y"], margins=True).collect()}
    assert got == {"g": (1, 1, 2), "h": (1, 0, 1), "All": (2, 1, 3)}
