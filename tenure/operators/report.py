"""Summary tables: descriptions, counts, pivots, cross tables and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.operators.ordered import quantiles


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, range and exact quartiles, one row per column."""
    out = None
    for c in cols:
        moments = df.agg(
            F.lit(c).alias("variable"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"))
        quarts = quantiles(df, c, [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).withColumn(
            "variable", F.lit(c))
        one = moments.join(quarts, "variable", "left").select(
            "variable", "n", "mean", "std", "min", "q25", "q50", "q75", "max")
        out = one if out is None else out.unionByName(one)
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share per category."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy(col).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts per row key and listed value, zero filled."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0)


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str], margins: bool = False,
             normalize: bool = False) -> DataFrame:
    """Counts of a x b with an 'All' margin, or shares within each row."""
    if normalize:
        counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
        share = F.col("n") / F.sum("n").over(W.partitionBy(a))
        return (counts.withColumn("s", share).groupBy(a).pivot(b, list(values))
                .agg(F.first("s")).fillna(0.0))
    if not margins:
        return pivot_counts(df, a, b, values)
    cube = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_ga"),
                             F.grouping(b).alias("_gb"))
    named = cube.select(
        F.when(F.col("_ga") == 1, "All").otherwise(F.col(a)).alias(a),
        F.when(F.col("_gb") == 1, "All").otherwise(F.col(b)).alias(b), "n")
    return named.groupBy(a).pivot(b, [*values, "All"]).agg(F.first("n")).fillna(0)


def profile(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Group means and their ratio to the largest group mean."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])
    # one row per group
    top = means.agg(F.struct(*[F.max(c).alias(c) for c in cols]).alias("m")).scalar()
    return means.withColumns({f"{c}_rel": F.try_divide(F.col(c), top[c]) for c in cols})


def stack_predictions(df: DataFrame, preds: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Prediction columns to long form (model, pred) beside the kept columns."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("pred"))
                      for m, c in preds.items()])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.model", "_p.pred")


def errors_by(df: DataFrame, seg: str, actual: str, preds: Mapping[str, str]) -> DataFrame:
    """MAE and RMSE per segment and model beside size, churned share and mean actual."""
    a = F.col(actual)
    aggs = [F.count("*").alias("n"),
            F.avg((a == 0).cast("double") * 100).alias("churn_pct"),
            F.avg(a).alias("avg_actual")]
    for m, c in preds.items():
        aggs.append(F.avg(F.abs(a - F.col(c))).alias(f"mae_{m}"))
        aggs.append(F.sqrt(F.avg((a - F.col(c)) * (a - F.col(c)))).alias(f"rmse_{m}"))
    return df.groupBy(seg).agg(*aggs)
