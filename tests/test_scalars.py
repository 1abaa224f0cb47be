import math

import pytest
from pyspark.sql import functions as F

from tenure.functions import scalars as S


def one(spark, *cols, **values):
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in values.items()})
    return df.select(*cols).first()


def test_elapsed_days_floor_not_midnights(spark):
    row = one(spark, S.elapsed_days(F.lit("2024-01-01 23:00:00").cast("timestamp"), F.lit("2024-01-02 01:00:00").cast("timestamp")).alias("d"))
    assert row.d == 0


def test_month_shift_clamps_and_keeps_time(spark):
    row = one(spark, S.minus_months(F.lit("2011-08-31 13:30:00").cast("timestamp"), 6).cast("string").alias("d"))
    assert row.d == "2011-02-28 13:30:00"


def test_week_starts_monday(spark):
    parts = S.date_parts(F.lit("2024-01-01 05:00:00").cast("timestamp"))
    row = one(spark, *[c.alias(n) for n, c in parts.items()])
    assert (row.hour, row.day_of_week, row.is_weekend, row.month, row.is_holiday_season) == (5, 0, 0, 1, 0)


def test_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(0,), (2,), (3,), (10,), (5000,)], "v int")
    got = [r.b for r in df.select(S.bin_right_closed("v", (-1, 0, 2, 10, 1000), ("a", "b", "c", "d")).alias("b")).collect()]
    assert got == ["a", "b", "c", "c", None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (5.0,), (50.0,)], "v double")
    assert [r.c for r in df.select(S.clip("v", 0.0, 10.0).alias("c")).collect()] == [None, 0.0, 5.0, 10.0]


def test_finite_and_ratios(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (float("inf"), 2.0), (3.0, 6.0)], "a double, b double")
    got = df.select(S.finite("a").alias("f"), S.ratio_or("b", "b", 9.0).alias("r"), S.safe_ratio("b", F.lit(0.0)).alias("s")).collect()
    assert [tuple(r) for r in got] == [(None, 9.0, 0.0), (None, 1.0, 2.0), (3.0, 1.0, 6.0)]


@pytest.mark.parametrize("z", [-4.0, -1.0, 0.0, 0.5, 3.0])
def test_norm_cdf(spark, z):
    row = one(spark, S.norm_cdf(F.lit(z)).alias("p"))
    assert row.p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=2e-7)


def test_strict_and_lenient_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("bad",)], "t string")
    assert [r.x is None for r in df.select(S.parse_ts("t", "yyyy-MM-dd HH:mm:ss", strict=False).alias("x")).collect()] == [False, True]
    with pytest.raises(Exception):
        df.select(S.parse_ts("t", "yyyy-MM-dd HH:mm:ss")).collect()


def test_one_hot_drops_first_level(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "g string")
    assert S.one_hot(df, "g", "g").columns == ["g", "g_b", "g_c"]


def test_first_token(spark):
    df = spark.createDataFrame([(" red  heart box",), ("",), (None,)], "d string")
    assert [r.t for r in df.select(S.first_token("d").alias("t")).collect()] == ["RED", None, None]


def test_top_bins_are_open(spark):
    from tenure import constants as c
    from tenure.functions.scalars import bin_right_closed

    df = spark.createDataFrame([(1500.0, 20000.0, 250.0, 900.0)], "f double, r double, cv double, b double")
    row = df.select(*[bin_right_closed(x, *bins).alias(x) for x, bins in (
        ("f", c.FREQUENCY_BINS), ("r", c.RECENCY_BINS), ("cv", c.CV_BINS), ("b", c.BUCKET_BINS))]).first()
    assert tuple(row) == ("High Freq (10+)", "Dormant (>180d)", "Very High CV (>1.5)", "20+")


def test_segment_errors_keep_every_customer(spark):
    from tenure.operators import report

    df = spark.createDataFrame([("High", 1.0, 2.0), (None, 3.0, 3.0)], "seg string, y double, p double")
    assert sum(r.n for r in report.errors_by(df, "seg", "y", {"m": "p"}).collect()) == 2
