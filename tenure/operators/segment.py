"""Standardising, principal components, clustering and value tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.constants import ONE_TIMER, TIERS
from tenure.operators.ordered import quantiles

KEY = "customer_id"


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                suffix: str = "_z") -> DataFrame:
    """z-scores with the population deviation; constant columns become 0."""
    source = fit_on if fit_on is not None else df
    stats = source.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).alias("_z")).scalar()
    scored = df.withColumn("_z", stats)
    return scored.withColumns({f"{c}{suffix}": F.when(F.col(f"_z.s_{c}") > 0, F.try_divide(
        F.col(c) - F.col(f"_z.m_{c}"), F.col(f"_z.s_{c}"))).otherwise(
        F.when(F.col(c).isNotNull(), 0.0)) for c in cols}).drop("_z")


def _vector(df: DataFrame, cols: Sequence[str], out: str = "_vec") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def pca(df: DataFrame, cols: Sequence[str], k: int = 3):
    """Fitted components of standardised columns: (model, loadings, explained shares).

    Signs are fixed so each component's largest loading is positive.
    """
    vec = _vector(standardize(df, cols), [f"{c}_z" for c in cols])
    model = PCA(k=k, inputCol="_vec", outputCol="_pc").fit(vec)
    load = model.pc.toArray().copy()
    for j in range(k):
        big = max(range(len(cols)), key=lambda i: (abs(load[i, j]), -i))
        if load[big, j] < 0:
            load[:, j] = -load[:, j]
    return model, load, list(model.explainedVariance)


def pca_scores(df: DataFrame, cols: Sequence[str], load, prefix: str = "pc") -> DataFrame:
    """Component scores as column expressions over the standardised columns."""
    z = standardize(df, cols)
    scores = {f"{prefix}{j + 1}": sum((F.col(f"{c}_z") * float(load[i, j]) for i, c in enumerate(cols)), F.lit(0.0))
              for j in range(load.shape[1])}
    return z.withColumns(scores).drop(*[f"{c}_z" for c in cols])


def pca_table(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    _, load, shares = pca(df, cols, k)
    rows = [(j + 1, c, float(load[i, j]), float(shares[j])) for j in range(k) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "component int, feature string, loading double, explained double")


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, restarts: int = 10, seed: int = 42,
           out: str = "cluster") -> DataFrame:
    """Best of several seeded runs by training cost."""
    vec = _vector(df, cols).persist()
    try:
        best = None
        for i in range(restarts):
            model = KMeans(k=k, seed=seed + i, featuresCol="_vec", predictionCol=out).fit(vec)
            cost = model.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, model)
    finally:
        vec.unpersist()
    return best[1].transform(_vector(df, cols)).drop("_vec")


def tiers(clustered: DataFrame, cluster: str = "cluster", money: str = "monetary_value",
          names: Sequence[str] = TIERS, out: str = "segment") -> DataFrame:
    """Name clusters by falling mean money."""
    means = clustered.groupBy(cluster).agg(F.avg(money).alias("_m"))
    # one row per cluster
    ranked = means.select(cluster, F.get(F.array(*[F.lit(n) for n in names]),
                                         F.row_number().over(W.orderBy(F.desc("_m"), cluster)) - 1).alias(out))
    return clustered.join(F.broadcast(ranked), cluster)


def segment_repeat(rfm: DataFrame, cols: Sequence[str], k: int = 3, restarts: int = 10, seed: int = 42) -> DataFrame:
    """Standardise, reduce, cluster and name the repeat customers."""
    repeat = rfm.where(F.col("frequency") > 0)
    _, load, _ = pca(repeat, cols, min(3, len(cols)))
    scored = pca_scores(repeat, cols, load)
    pcs = [f"pc{j + 1}" for j in range(load.shape[1])]
    return tiers(kmeans(scored, pcs, k, restarts, seed))


def attach(rfm: DataFrame, segments: DataFrame, key: str = KEY) -> DataFrame:
    """All customers with a segment; those without one are one-timers."""
    return rfm.join(segments.select(key, "segment"), key, "left").withColumn(
        "segment", F.coalesce("segment", F.lit(ONE_TIMER)))


def tiers_by_rank(rfm: DataFrame, money: str = "monetary_value", names: Sequence[str] = TIERS) -> DataFrame:
    """Deterministic tiers of repeat customers by spend thirds."""
    repeat = rfm.where(F.col("frequency") > 0)
    cuts = quantiles(repeat, money, [1 / 3, 2 / 3], ["lo", "hi"]).select(F.struct("lo", "hi").alias("q")).scalar()
    return repeat.withColumn("segment", F.when(F.col(money) > cuts["hi"], names[0])
                             .when(F.col(money) > cuts["lo"], names[1]).otherwise(names[2]))
