"""Labels, temporal and random splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.constants import CHURN_WINDOW, CHURN_WINDOWS, CONVERSION_WINDOW, CONVERSION_WINDOWS
from tenure.functions.scalars import elapsed_days, minus_months, money_sum, month_of, shift_days
from tenure.operators.ordered import previous_time, row_index, shuffled

KEY = "customer_id"


def churn(df: DataFrame, windows: Sequence[int] = CHURN_WINDOWS) -> DataFrame:
    """A 0/1 column per window: inactive for strictly more days."""
    return df.withColumns({f"churn_{w}": (F.col("recency") > w).cast("int") for w in windows})


def churn_rates(df: DataFrame, windows: Sequence[int] = CHURN_WINDOWS) -> DataFrame:
    one = df.agg(F.count("*").alias("n"),
                 *[F.sum((F.col("recency") > w).cast("long")).alias(f"c{w}") for w in windows])
    rows = ", ".join(f"{w}, c{w}" for w in windows)
    return one.selectExpr("n", f"stack({len(windows)}, {rows}) AS (window_days, churned)").select(
        "window_days", "churned", "n", (F.col("churned") * 100.0 / F.col("n")).alias("churn_pct"))


def stability(df: DataFrame, windows: Sequence[int] = CHURN_WINDOWS) -> DataFrame:
    """Agreement, flips and rescues between consecutive windows, in one aggregate."""
    r = F.col("recency")
    pairs = list(zip(windows, windows[1:]))
    aggs = [F.count("*").alias("n")]
    for a, b in pairs:
        aggs.append(F.sum(((r > a) != (r > b)).cast("long")).alias(f"f_{a}_{b}"))
        aggs.append(F.sum(((r > a) & (r <= b)).cast("long")).alias(f"r_{a}_{b}"))
    rows = ", ".join(f"{a}, {b}, f_{a}_{b}, r_{a}_{b}" for a, b in pairs)
    out = df.agg(*aggs).selectExpr(
        "n", f"stack({len(pairs)}, {rows}) AS (window_a, window_b, flipped, rescued)")
    return out.select("window_a", "window_b", "flipped", "rescued",
                      ((F.col("n") - F.col("flipped")) * 100.0 / F.col("n")).alias("agreement_pct"))


def confusion(df: DataFrame, ref: int = CHURN_WINDOW,
              others: Sequence[int] = (30, 40, 50, 60)) -> DataFrame:
    """2x2 counts of the reference window against the others."""
    r = F.col("recency")
    rows = ", ".join(f"{w}, cast(recency > {w} as int)" for w in others)
    long = df.select("recency").withColumn("ref_label", (r > ref).cast("int")).selectExpr(
        "ref_label", f"stack({len(others)}, {rows}) AS (window_days, other_label)")
    return long.groupBy("window_days", "ref_label", "other_label").agg(F.count("*").alias("n"))


def first_second(inv: DataFrame) -> DataFrame:
    """First and second purchase times and the invoice count.

    The second purchase is the earliest invoice that has a predecessor, so no ordered
    list per customer is built.
    """
    prev = previous_time(inv.select(KEY, "invoice", "ts"))
    return prev.groupBy(KEY).agg(
        F.min("ts").alias("first_purchase_date"),
        F.min(F.when(F.col("prev_ts").isNotNull(), F.col("ts"))).alias("second_purchase_date"),
        F.count("*").alias("total_invoices"),
    )


def conversion(cp: DataFrame, obs_end: Column, window: int = CONVERSION_WINDOW) -> DataFrame:
    """1 returned, 0 observed long enough without return, -1 censored."""
    out = cp.withColumns({
        "obs_days": elapsed_days(F.col("first_purchase_date"), obs_end),
        "days_to_second": elapsed_days("first_purchase_date", "second_purchase_date"),
    })
    return out.withColumn("label", F.when(F.col("total_invoices") > 1, 1)
                          .when(F.col("obs_days") >= window, 0).otherwise(-1))


def sensitivity(cp: DataFrame, windows: Sequence[int] = CONVERSION_WINDOWS) -> DataFrame:
    """Label counts per observation window, in one aggregate."""
    repeat = F.col("total_invoices") > 1
    aggs = [F.sum(repeat.cast("long")).alias("rep")]
    for w in windows:
        aggs.append(F.sum((~repeat & (F.col("obs_days") >= w)).cast("long")).alias(f"one_{w}"))
        aggs.append(F.sum((~repeat & (F.col("obs_days") < w)).cast("long")).alias(f"cen_{w}"))
    rows = ", ".join(f"{w}, one_{w}, cen_{w}" for w in windows)
    out = cp.agg(*aggs).selectExpr(
        "rep AS repeaters", f"stack({len(windows)}, {rows}) AS (window_days, one_timers, censored)")
    labeled = F.col("repeaters") + F.col("one_timers")
    return out.select("window_days", labeled.alias("labeled"), "one_timers", "repeaters", "censored",
                      (F.col("repeaters") * 100.0 / labeled).alias("repeater_pct"))


def cohort_mix(cp: DataFrame) -> DataFrame:
    """Label counts per first-purchase month."""
    return cp.groupBy(month_of("first_purchase_date").cast("date").alias("cohort_month"), "label").agg(
        F.count("*").alias("n"))


def temporal_split(df: DataFrame, cutoff: Column, end: Column, window: int = CONVERSION_WINDOW,
                   date: str = "first_purchase_date") -> DataFrame:
    """'train' before the cutoff, 'test' from it to the end minus the window; others drop out."""
    d = F.col(date)
    part = F.when(d < cutoff, "train").when((d >= cutoff) & (d <= shift_days(end, -window)), "test")
    return df.withColumn("split", part).where(F.col("split").isNotNull())


def assert_no_overlap(split: DataFrame, date: str = "first_purchase_date") -> DataFrame:
    """Raise while running if a training date is not before all test dates."""
    latest = F.max(F.when(F.col("split") == "train", F.col(date)))
    earliest = F.min(F.when(F.col("split") == "test", F.col(date)))
    return split.agg(
        F.sum((F.col("split") == "train").cast("long")).alias("n_train"),
        F.sum((F.col("split") == "test").cast("long")).alias("n_test"),
        latest.alias("train_last"), earliest.alias("test_first"),
    ).where(F.coalesce(F.assert_true(F.coalesce(F.col("train_last") < F.col("test_first"), F.lit(True)),
                                     F.lit("training and test dates overlap")).cast("boolean"),
                       F.lit(True)))


def cutoff_date(tx: DataFrame, months: int = 6, ts: str = "invoice_date") -> Column:
    """Latest time minus whole months, as a scalar subquery."""
    return tx.agg(minus_months(F.max(ts), months)).scalar()


def cutoff_split(tx: DataFrame, months: int = 6) -> tuple[DataFrame, DataFrame]:
    """Training rows up to the cutoff (included) and holdout rows after it."""
    cutoff = cutoff_date(tx, months)
    return tx.where(F.col("invoice_date") <= cutoff), tx.where(F.col("invoice_date") > cutoff)


def holdout_spend(holdout: DataFrame) -> DataFrame:
    return holdout.groupBy(KEY).agg(money_sum("line_total").alias("actual_clv_6m"))


def ground_truth(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Holdout spend of every training customer; nothing bought means 0 and churned."""
    out = train.select(KEY).distinct().join(holdout_spend(holdout), KEY, "left").fillna(
        0.0, ["actual_clv_6m"])
    return out.withColumn("returned", (F.col("actual_clv_6m") > 0).cast("int"))


def split(df: DataFrame, key: str = KEY, test: float = 0.2, seed: int = 42,
          stratify: str | None = None) -> DataFrame:
    """Exact-share random split by ranked seeded hash, per stratum when given.

    Depends only on the keys, so it is the same under any partitioning.
    """
    by = [stratify] if stratify else []
    hashed = df.withColumn("_h", shuffled(key, seed))
    index = row_index(hashed.select(*by, "_h"), "_h", by)
    if by:
        total = df.groupBy(*by).agg(F.count("*").alias("_total"))
        placed = hashed.join(index, [*by, "_h"]).join(total, by)
    else:
        placed = hashed.join(index, "_h").withColumn(
            "_total", df.agg(F.count("*").alias("n")).scalar())
    is_test = F.col("rn") <= F.round(F.col("_total") * test)
    return placed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop(
        "_h", "rn", "_total")
