import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenure.operators import ecdf, metrics, models, segment, survmodels


def scores(spark, s, y):
    return spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "customer_id int, score double, label int")


def test_average_precision_steps(spark):
    assert metrics.average_precision(scores(spark, [0.9, 0.8, 0.7], [1, 0, 1])).first()[0] == pytest.approx(0.8333333333)


def test_auc_counts_ties_half(spark):
    assert metrics.auc(scores(spark, [0.5, 0.5], [1, 0])).first()[0] == 0.5
    assert metrics.auc(scores(spark, [0.9, 0.1, 0.4], [1, 0, 1])).first()[0] == 1.0


def test_ks_of_disjoint_samples(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0)], "a double, b double")
    assert metrics.ks(df, "a", "b").first().statistic == 1.0


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    want = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert metrics.spearman(df, "a", "b").first()[0] == pytest.approx(want)


def test_class_metrics(spark):
    r = metrics.classification(scores(spark, [0.9, 0.8, 0.2, 0.1], [1, 0, 1, 0])).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.accuracy) == (1, 1, 1, 1, 0.5, 0.5, 0.5)


def test_youden_takes_the_highest_of_equal_thresholds(spark):
    r = metrics.youden(scores(spark, [0.9, 0.7, 0.3], [1, 0, 0])).first()
    assert (r.threshold, r.j) == (0.9, 1.0)


def test_td_auc_orders(spark):
    df = spark.createDataFrame([(5, 1, 3.0), (10, 1, 2.0), (30, 0, 1.0), (40, 1, 0.5)], "duration int, event_observed int, risk double")
    assert metrics.td_auc(df, df, [20]).first().auc == pytest.approx(1.0)


def test_elbow_of_a_bent_curve(spark):
    grid = spark.createDataFrame([(d, min(1.0, d / 40)) for d in range(121)], "day int, cdf double")
    assert ecdf.elbow_chord(grid).first().elbow_day == 40
    smooth = {r.day: r.smooth for r in ecdf.gaussian(grid).collect()}
    assert smooth[20] == pytest.approx(0.5) and smooth[100] == pytest.approx(1.0)


def test_standardise_and_pca(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=300)
    rows = [(float(a), float(2 * a + e), float(f)) for a, e, f in zip(base, rng.normal(size=300) * 0.1, rng.normal(size=300))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    z = segment.standardize(df, ["a", "b"]).agg(F.avg("a_z"), F.stddev_pop("a_z")).first()
    assert list(z) == pytest.approx([0, 1], abs=1e-9)
    _, load, shares = segment.pca(df, ["a", "b", "c"], 2)
    assert shares[0] > 0.6 and load[:, 0].max() == pytest.approx(np.abs(load[:, 0]).max())


def test_segments_are_named_by_money(spark):
    rows = [(i, float(f), 10.0, 20.0, float(m)) for i, (f, m) in enumerate([(1, 10), (2, 11), (1, 12), (5, 100), (6, 101), (20, 900), (21, 905)])]
    df = spark.createDataFrame(rows, "customer_id int, frequency double, recency double, T double, monetary_value double")
    got = segment.segment_repeat(df, ["frequency", "monetary_value"], restarts=3).groupBy("segment").agg(F.avg("monetary_value").alias("m")).collect()
    order = [r.segment for r in sorted(got, key=lambda r: -r.m)]
    assert order == ["Gold", "Silver", "Bronze"]


def test_person_periods_keep_every_event(spark):
    df = spark.createDataFrame([(1, 95, 1), (2, 10, 0), (3, 0, 1)], "customer_id int, duration int, event_observed int")
    rows = survmodels.person_periods(df, 30)
    assert rows.agg(F.sum("_y")).first()[0] == 2 and rows.count() == 6


def test_permuting_a_constant_changes_nothing(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(t), 1, float(-t), 1.0) for i, t in enumerate(rng.integers(1, 50, 60))]
    df = spark.createDataFrame(rows, "customer_id int, duration int, event_observed int, x double, k double")
    got = {r.feature: r.importance_mean for r in survmodels.permutation_importance(
        df, ["x", "k"], lambda d: d.withColumn("risk", F.col("x") + F.col("k")), repeats=2).collect()}
    assert got["k"] == pytest.approx(0) and got["x"] > 0.2


def test_out_of_fold_predictions_cover_all_rows(spark):
    df = spark.createDataFrame([(i, float(i), 3.0 * i) for i in range(40)], "customer_id int, x double, y double")
    out = models.oof_regress(df, ["x"], "y", "linear", k=4)
    joined = out.join(df, "customer_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("pred") - F.col("y"))).alias("e")).first()
    assert joined.n == 40 and joined.e < 1e-6
