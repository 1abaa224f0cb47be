"""Survival data, Kaplan-Meier curves, log-rank tests and lookups on curves.

Durations are whole days, so a risk table has at most one row per day of the observed
period and group; windows over risk tables are bounded by that.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.constants import CHURN_WINDOW, HORIZONS
from tenure.functions.scalars import elapsed_days

KEY = "customer_id"
Z95 = 1.959963984540054


def customer_dates(tx: DataFrame, obs_end: Column) -> DataFrame:
    """First and last purchase, lifetime and idle days."""
    agg = tx.groupBy(KEY).agg(F.min("invoice_date").alias("first_purchase"),
                              F.max("invoice_date").alias("last_purchase"))
    return agg.withColumns({
        "duration": elapsed_days("first_purchase", "last_purchase"),
        "days_since_last": elapsed_days(F.col("last_purchase"), obs_end),
    })


def dataset(tx: DataFrame, obs_end: Column, window: int = CHURN_WINDOW) -> DataFrame:
    """Duration and churn event per customer: idle for strictly more than the window."""
    return customer_dates(tx, obs_end).select(
        KEY, "duration", (F.col("days_since_last") > window).cast("int").alias("event_observed"))


def clip_duration(df: DataFrame) -> DataFrame:
    return df.withColumn("duration", F.greatest("duration", F.lit(1)))


def attach(df: DataFrame, segments: DataFrame, key: str = KEY) -> DataFrame:
    """Left join the segment of each customer."""
    return df.join(segments.select(key, "segment"), key, "left")


def risk_table(df: DataFrame, by: Sequence[str] = (), duration: str = "duration",
               event: str = "event_observed") -> DataFrame:
    """Events, censored and at-risk counts per distinct time."""
    by = list(by)
    counts = df.groupBy(*by, F.col(duration).alias("t")).agg(
        F.sum(F.col(event).cast("long")).alias("events"),
        F.sum((1 - F.col(event)).cast("long")).alias("censored"))
    later = W.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("at_risk", F.sum(F.col("events") + F.col("censored")).over(later))


def km(df: DataFrame, by: Sequence[str] = (), duration: str = "duration",
       event: str = "event_observed") -> DataFrame:
    """Kaplan-Meier curve S(t) per distinct time."""
    return km_from_risk(risk_table(df, by, duration, event), by)


def km_from_risk(risk: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w = W.partitionBy(*by).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    d, n = F.col("events"), F.col("at_risk")
    logs = F.sum(F.when(d < n, F.log1p(-(d / n)))).over(w)
    gone = F.max((d == n).cast("int")).over(w)
    return risk.withColumn("s", F.when(gone == 1, 0.0).otherwise(F.exp(logs)))


def km_ci(curve: DataFrame, by: Sequence[str] = (), z: float = Z95) -> DataFrame:
    """Greenwood band on the log(-log) scale; NULL where S is 0 or 1."""
    w = W.partitionBy(*by).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    d, n, s = F.col("events"), F.col("at_risk"), F.col("s")
    greenwood = F.sum(F.when(d < n, F.try_divide(d, n * (n - d)))).over(w)
    inside = (s > 0) & (s < 1)
    theta = z * F.sqrt("_g") / F.abs(F.log(F.when(inside, s)))
    return curve.withColumn("_g", greenwood).withColumns({
        "s_lower": F.when(inside, F.pow(s, F.exp(theta))),
        "s_upper": F.when(inside, F.pow(s, F.exp(-theta))),
    }).drop("_g")


def cdf(curve: DataFrame) -> DataFrame:
    return curve.withColumn("f", 1.0 - F.col("s"))


def median(curve: DataFrame, by: Sequence[str] = (), fallback: float | None = None) -> DataFrame:
    """First time with S <= 0.5; infinity, or a fallback, where the curve stays above."""
    other = F.lit(float("inf") if fallback is None else float(fallback))
    first = F.min(F.when(F.col("s") <= 0.5, F.col("t"))).cast("double")
    return curve.groupBy(*by).agg(F.coalesce(first, other).alias("median"))


def step_at(curve: DataFrame, times: Sequence[float], by: Sequence[str] = (),
            names: Sequence[str] | None = None) -> DataFrame:
    """S at each requested time: last curve value at or before it, 1 before the first."""
    names = names or [f"s_{t}" for t in times]
    aggs = [F.coalesce(F.max_by(F.when(F.col("t") <= t, F.col("s")),
                                F.when(F.col("t") <= t, F.col("t"))), F.lit(1.0)).alias(n)
            for t, n in zip(times, names)]
    return curve.groupBy(*by).agg(*aggs)


def at_horizons(curve: DataFrame, horizons: Sequence[float] = HORIZONS, by: Sequence[str] = (),
                names: Sequence[str] | None = None) -> DataFrame:
    """S at the curve time nearest to each horizon; ties go to the earlier time."""
    names = names or [f"s_{h}" for h in horizons]
    return curve.groupBy(*by).agg(*[
        F.min_by("s", F.struct(F.abs(F.col("t") - h), F.col("t"))).alias(n)
        for h, n in zip(horizons, names)])


def time_points(df: DataFrame, by: str, times: Sequence[int]) -> DataFrame:
    """S per group at fixed times."""
    return step_at(km(df, [by]), times, [by])


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution by its closed forms and recursion."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= (x / 2) / k
            total += term
        return math.exp(-x / 2) * total
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(3, df + 1, 2):
        total += term
        term *= x / k
    return total


def _group_table(df: DataFrame, by: str, groups: Sequence, duration: str, event: str) -> DataFrame:
    """Pooled times with per-group events and at-risk counts."""
    aggs = []
    for i, g in enumerate(groups):
        here = F.col(by) == g
        aggs.append(F.sum(F.when(here, F.col(event)).otherwise(0).cast("double")).alias(f"d{i}"))
        aggs.append(F.sum(here.cast("double")).alias(f"c{i}"))
    counts = df.where(F.col(by).isin(list(groups))).groupBy(F.col(duration).alias("t")).agg(*aggs)
    later = W.orderBy(F.col("t").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = counts.withColumns({f"n{i}": F.sum(f"c{i}").over(later) for i in range(len(groups))})
    return out.withColumns({
        "d": sum((F.col(f"d{i}") for i in range(len(groups))), F.lit(0.0)),
        "n": sum((F.col(f"n{i}") for i in range(len(groups))), F.lit(0.0)),
    })


def logrank(df: DataFrame, by: str, groups: Sequence | None = None, duration: str = "duration",
            event: str = "event_observed") -> DataFrame:
    """k-group log-rank statistic and p-value, one row.

    One aggregate yields the k observed-minus-expected sums and their covariance; the
    (k-1)-dimensional solve runs on those few numbers.
    """
    if groups is None:
        groups = sorted(r[0] for r in df.select(by).distinct().collect() if r[0] is not None)
    k = len(groups)
    table = _group_table(df, by, groups, duration, event)
    d, n = F.col("d"), F.col("n")
    aggs = []
    for i in range(k - 1):
        aggs.append(F.sum(F.col(f"d{i}") - F.col(f"n{i}") * d / n).alias(f"z{i}"))
        for j in range(i, k - 1):
            part = F.col(f"n{i}") / n * (F.lit(1.0 if i == j else 0.0) - F.col(f"n{j}") / n)
            v = F.when(n > 1, d * (n - d) / (n - 1) * part).otherwise(0.0)
            aggs.append(F.sum(v).alias(f"v{i}_{j}"))
    row = table.agg(*aggs).first()
    z = np.array([row[f"z{i}"] or 0.0 for i in range(k - 1)])
    v = np.array([[row[f"v{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k - 1)] for i in range(k - 1)])
    stat = float(z @ np.linalg.pinv(v) @ z) if k > 1 else 0.0
    return df.sparkSession.createDataFrame(
        [(stat, k - 1, chi2_sf(stat, k - 1))], "statistic double, df int, p_value double")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def logrank_pairs(df: DataFrame, by: str, groups: Sequence, duration: str = "duration",
                  event: str = "event_observed") -> DataFrame:
    """Two-group log-rank of every pair of a few groups, in one job over the risk tables."""
    table = _group_table(df, by, groups, duration, event)
    aggs, pairs = [], []
    for i in range(len(groups)):
        for j in range(i + 1, len(groups)):
            d = F.col(f"d{i}") + F.col(f"d{j}")
            n = F.col(f"n{i}") + F.col(f"n{j}")
            share = F.try_divide(F.col(f"n{i}"), n)
            aggs.append(F.sum(F.col(f"d{i}") - d * share).alias(f"z{i}_{j}"))
            aggs.append(F.sum(F.when(n > 1, d * F.try_divide(n - d, n - 1) * share * (1 - share))
                              .otherwise(0.0)).alias(f"v{i}_{j}"))
            pairs.append((i, j))
    row = table.agg(*aggs).first()
    rows = []
    for i, j in pairs:
        z, v = row[f"z{i}_{j}"] or 0.0, row[f"v{i}_{j}"] or 0.0
        stat = z * z / v if v > 0 else 0.0
        rows.append((groups[i], groups[j], stat, chi2_sf(stat, 1)))
    kind = df.schema[by].dataType.simpleString()
    out = df.sparkSession.createDataFrame(
        rows, f"group_a {kind}, group_b {kind}, statistic double, p_value double")
    return out.withColumn("significance", stars(F.col("p_value")))
