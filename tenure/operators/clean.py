"""Cleaning of transaction lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.constants import CAP_QUANTILE, IQR_FACTOR
from tenure.functions.scalars import finite
from tenure.operators.ordered import quantiles
from tenure.session import written


def drop_null_key(df: DataFrame, key: str = "customer_id") -> DataFrame:
    return df.where(F.col(key).isNotNull())


def cast_key(df: DataFrame, key: str = "customer_id") -> DataFrame:
    return df.withColumn(key, F.col(key).cast("long"))


def drop_cancelled(df: DataFrame, col: str = "invoice", prefix: str = "C") -> DataFrame:
    return df.where(~F.col(col).cast("string").startswith(prefix))


def positive_lines(df: DataFrame) -> DataFrame:
    return df.where((F.col("quantity") > 0) & (F.col("price") > 0))


def dedup(df: DataFrame, enabled: bool = True) -> DataFrame:
    return df.dropDuplicates() if enabled else df


def line_total(df: DataFrame) -> DataFrame:
    return df.withColumn("line_total", F.col("quantity") * F.col("price"))


def quantile_cap(df: DataFrame, col: str = "line_total", q: float = CAP_QUANTILE) -> DataFrame:
    """Keep rows at or below the exact q-quantile of a column."""
    cap = quantiles(df, col, [q], ["cap"])
    return df.where(F.col(col) <= cap.scalar())


def iqr_fence(df: DataFrame, cols: Sequence[str] = ("quantity", "price"),
              k: float = IQR_FACTOR) -> DataFrame:
    """Keep rows inside the quartile fences, one column after the other.

    The second column's quartiles are those of the rows the first fence kept.
    """
    out = df
    for col in cols:
        fences = quantiles(out, col, [0.25, 0.75], ["q1", "q3"]).select(F.struct(
            (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo"),
            (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi"),
        ).alias("f"))
        fence = fences.scalar()
        out = out.where((F.col(col) >= fence["lo"]) & (F.col(col) <= fence["hi"]))
    return out


def clean(df: DataFrame, dedup_rows: bool = True, outlier: str = "quantile") -> DataFrame:
    """Identified, uncancelled, positive, distinct lines with totals and the outlier rule."""
    out = positive_lines(drop_cancelled(cast_key(drop_null_key(df))))
    out = line_total(dedup(out, dedup_rows))
    # the rules read the lines for their quantiles and again for the result
    if outlier == "quantile":
        return quantile_cap(written(out))
    if outlier == "iqr":
        return line_total(iqr_fence(written(out)))
    if outlier == "none":
        return out
    raise ValueError(outlier)


def finite_cols(df: DataFrame, cols: Sequence[str], how: str = "fill", value: float = 0.0) -> DataFrame:
    """NaN and infinities to NULL, then fill or drop."""
    out = df.withColumns({c: finite(c) for c in cols})
    return out.fillna(value, list(cols)) if how == "fill" else out.dropna(subset=list(cols))


def overview(df: DataFrame, stage: str) -> DataFrame:
    """Row, customer and invoice counts with the date range of one stage."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("customer_id").alias("n_customers"),
        F.count_distinct("invoice").alias("n_invoices"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
    ).select(F.lit(stage).alias("stage"), "*")


def funnel(stages: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in stages.items():
        one = overview(df, name)
        out = one if out is None else out.unionByName(one)
    return out
