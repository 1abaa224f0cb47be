"""Certificates of fits: what must hold at an optimum, computed from the rows again by other formulas than the fit's.

A certificate has a row for each parameter (or component, or cluster), the number of rows it was computed from, and flags
that are 1 where the condition holds. Each reads the rows once, or once for each aggregate that its formula needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.operators import btyd, segment
from tenure.operators.btyd import BgNbd, GammaGamma
from tenure.operators.cox import Cox

#: Step on the log scale to a parameter's neighbours, and how far off (in steps) the parabola's top may lie.
STEP, OFF = 0.05, 0.2


def _beside(theta: Sequence[float]) -> np.ndarray:
    """The parameters, then each one a step up and a step down."""
    moves = np.vstack([np.zeros(len(theta)), *[s * STEP * np.eye(len(theta))[i] for i in range(len(theta)) for s in (1, -1)]])
    return np.array(theta) * np.exp(moves)


def _tops(spark, names: Sequence[str], f: np.ndarray, n: int) -> DataFrame:
    """Whether the objective is largest in the middle, and the parabola through three points has its top there."""
    rows = []
    for i, name in enumerate(names):
        up, down = f[1 + 2 * i], f[2 + 2 * i]
        bend = 2 * f[0] - up - down
        rows.append((name, n, int(bend > 0 and abs(up - down) / (2 * bend) <= OFF), int(f[0] >= max(up, down))))
    return spark.createDataFrame(rows, "parameter string, customers long, stationary int, largest int")


def bgnbd(df: DataFrame, m: BgNbd, penalty: float = 0.0, prior_sigma: float | None = None) -> DataFrame:
    """The fit's objective against that of its neighbours, by the likelihood's column expression."""
    thetas = _beside((m.r, m.alpha, m.a, m.b))
    cells = df.groupBy("frequency", "recency", "T").agg(F.count("*").alias("n"))
    row = cells.agg(F.sum("n").alias("n"), F.max("T").alias("T"),
                    *[F.sum(F.col("n") * btyd.loglik_column(BgNbd(*map(float, t)))).alias(f"f{i}") for i, t in enumerate(thetas)]).first()
    f = np.array([row[f"f{i}"] for i in range(len(thetas))]) / row["n"]
    if prior_sigma:
        f = f - (thetas**2).sum(1) / (2 * prior_sigma**2 * row["n"])
    scaled = thetas * [1.0, 10.0 / max(1.0, row["T"]), 1.0, 1.0]
    return _tops(df.sparkSession, ("r", "alpha", "a", "b"), f - penalty * (scaled**2).sum(1), row["n"])


def gamma_gamma(df: DataFrame, g: GammaGamma, penalty: float = 0.0) -> DataFrame:
    """The same for the spend model, spend in units of its mean."""
    rows = df.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    total = rows.agg(F.count("*").alias("n"), F.avg("monetary_value").alias("unit")).first()
    thetas = _beside((g.p, g.q, g.v / total.unit))
    spend = rows.select("frequency", (F.col("monetary_value") / total.unit).alias("m"), F.lit(1).alias("n"))
    f = btyd.draw_logliks(spend, thetas, btyd._gg_loglik, ("frequency", "m")) / total.n - penalty * (thetas**2).sum(1)
    return _tops(df.sparkSession, ("p", "q", "v"), f, total.n)


def cox_score(df: DataFrame, model: Cox, penalty: float, duration: str = "duration", event: str = "event_observed", tol: float = 1e-4) -> DataFrame:
    """Efron's score of every feature from sums per day, tie by tie, less the ridge term: zero at the fit."""
    k = range(len(model.cols))
    z = [(F.col(c) - m) / s for c, m, s in zip(model.cols, model.means, model.stds)]
    rows = df.select(F.col(duration).alias("t"), F.col(event).cast("double").alias("e"), *[x.cast("double").alias(f"z{i}") for i, x in zip(k, z)])
    rows = rows.withColumn("w", F.exp(sum((F.col(f"z{i}") * float(model.beta[i]) for i in k), F.lit(0.0))))
    w, e = F.col("w"), F.col("e")
    days = rows.groupBy("t").agg(
        F.count("*").alias("n"), F.sum("e").alias("d"), F.sum("w").alias("s"), F.sum(w * e).alias("es"),
        *[F.sum(w * F.col(f"z{i}")).alias(f"s{i}") for i in k], *[F.sum(w * e * F.col(f"z{i}")).alias(f"es{i}") for i in k],
        *[F.sum(e * F.col(f"z{i}")).alias(f"x{i}") for i in k])
    # one row per distinct day
    later = W.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, 0)
    risk = days.withColumns({c: F.sum(c).over(later) for c in ["s", *[f"s{i}" for i in k]]})
    ties = risk.where("d > 0").withColumn("l", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)))
    share = F.col("l") / F.col("d")
    per_tie = ties.agg(*[F.sum(F.col(f"x{i}") / F.col("d") - (F.col(f"s{i}") - share * F.col(f"es{i}")) / (F.col("s") - share * F.col("es"))).alias(f"g{i}") for i in k]).first()
    n = days.agg(F.sum("n")).first()[0]
    out = [(c, n, int(abs(per_tie[f"g{i}"] / n - penalty * float(model.beta[i])) < tol)) for i, c in zip(k, model.cols)]
    return df.sparkSession.createDataFrame(out, "feature string, customers long, score_zero int")


def logistic_score(train: DataFrame, cols: Sequence[str], model, label: str = "label", c: float = 1.0, tol: float = 1e-3) -> DataFrame:
    """Mean score of every feature and of the intercept, with the ridge term: zero at the fit."""
    z = segment.standardize(train, cols)
    beta = [float(b) for b in model.coefficients]
    eta = sum((F.col(f"{x}_z") * b for x, b in zip(cols, beta)), F.lit(float(model.intercept)))
    resid = F.col(label).cast("double") - 1 / (1 + F.exp(-eta))
    row = z.agg(F.count("*").alias("n"), F.avg(resid).alias("g"), *[F.avg(resid * F.col(f"{x}_z")).alias(f"g{i}") for i, x in enumerate(cols)]).first()
    out = [("(intercept)", row["n"], int(abs(row["g"]) < tol))]
    out += [(x, row["n"], int(abs(row[f"g{i}"] - b / (c * row["n"])) < tol)) for i, (x, b) in enumerate(zip(cols, beta))]
    return train.sparkSession.createDataFrame(out, "feature string, customers long, score_zero int")


def components(df: DataFrame, cols: Sequence[str], load: np.ndarray, shares: Sequence[float], tol: float = 1e-6) -> DataFrame:
    """Covariance times loading is the loading times its variance, loadings have length 1, and variances fall."""
    z = segment.standardize(df, cols)
    p = len(cols)
    row = z.agg(F.count("*").alias("n"), *[F.covar_pop(f"{cols[i]}_z", f"{cols[j]}_z").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    out, before = [], math.inf
    for j in range(load.shape[1]):
        v = load[:, j]
        variance = float(v @ cov @ v)
        holds = np.max(np.abs(cov @ v - variance * v)) < tol and abs(v @ v - 1) < tol and abs(variance / np.trace(cov) - shares[j]) < tol
        out.append((j + 1, row["n"], int(holds), int(variance <= before + tol)))
        before = variance
    return df.sparkSession.createDataFrame(out, "component int, customers long, eigenvector int, falling int")


def clusters(clustered: DataFrame, cols: Sequence[str], cluster: str = "cluster", slack: float = 1e-3) -> DataFrame:
    """Squared distances to the means of the assigned clusters are, up to ``slack``, those to the nearest means."""
    means = clustered.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols]).orderBy(cluster).collect()

    def squared(r) -> Column:
        return sum(((F.col(c) - float(r[c])) * (F.col(c) - float(r[c])) for c in cols), F.lit(0.0))

    own = None
    for r in means:
        own = F.when(F.col(cluster) == r[cluster], squared(r)) if own is None else own.when(F.col(cluster) == r[cluster], squared(r))
    got = clustered.agg(F.count("*").alias("n"), F.sum(own).alias("own"), F.sum(F.least(*[squared(r) for r in means])).alias("least")).first()
    return clustered.sparkSession.createDataFrame([(len(means), got.n, int(got.own <= got.least * (1 + slack) + 1e-9))], "clusters int, customers long, nearest int")
