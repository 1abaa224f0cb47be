"""Accelerated failure time with normal errors: log duration = x b + sigma e, right-censored.

The fit works on b / sigma and 1 / sigma, in which the log-likelihood is concave, so Newton steps with
halving reach the one maximum. A step is one pass: tasks reduce their rows to sums (numpy over Arrow batches),
the sums are added by a grouping, and the driver receives a number for each entry of the gradient and of the information.

A censored row adds log Q(z), Q the normal tail; its slope is the inverse Mills ratio h(z) and its curvature
h(z) (h(z) - z). Beyond ``TAIL`` both come from the continued fraction of Mills' ratio, which neither
underflows nor cancels however far the tail.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.scalars import clip, norm_cdf
from tenure.operators.cox import scaling

#: From here on the tail is a continued fraction, of this many terms.
TAIL, TERMS = 2.0, 80
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_tail(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Q(z), h(z) = phi(z) / Q(z), and h(z) - z."""
    z = np.asarray(z, np.float64)
    far = z > TAIL
    # h - z = 1 / (z + 2 / (z + 3 / (z + ...)))
    x = np.where(far, z, TAIL)
    below = x.copy()
    for k in range(TERMS, 1, -1):
        below = x + k / below
    over = 1 / below
    log_phi = -0.5 * z * z - _HALF_LOG_2PI
    q = 0.5 * _erfc(np.where(far, TAIL, z) / math.sqrt(2)).astype(np.float64)
    h = np.where(far, x + over, np.exp(log_phi) / q)
    return np.where(far, log_phi - np.log(x + over), np.log(q)), h, np.where(far, over, h - z)


@dataclass(frozen=True)
class Aft:
    """Coefficients are for standardised features; ``beta[0]`` is the intercept."""

    cols: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    beta: np.ndarray
    sigma: float
    gradient: np.ndarray
    information: np.ndarray
    loglik: float
    iterations: int
    n: int
    events: int
    converged: bool


def scaled_rows(df: DataFrame, cols: Sequence[str], means, stds, duration: str, event: str) -> DataFrame:
    """(y, e, x): log duration, event flag, and the standardised features after a leading 1."""
    x = [((F.col(c) - m) / s).cast("double") for c, m, s in zip(cols, means, stds)]
    return df.select(F.log(F.col(duration).cast("double")).alias("y"), F.col(event).cast("double").alias("e"), F.array(F.lit(1.0), *x).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def score_sums(rows: DataFrame, gamma: np.ndarray, theta: float) -> dict[int, float]:
    """Log-likelihood, gradient and information at (gamma, theta), as numbered sums over all rows.

    Entry -1 is the log-likelihood; then come the gradient's entries and the upper triangle of the information.
    """
    p = len(gamma)
    upper = np.triu_indices(p + 1)
    weights = np.append(gamma, theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + p + 1 + len(upper[0]))
        for batch in batches:
            if not batch.num_rows:
                continue
            y, e = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "e"))
            a = np.column_stack([_matrix(batch.column("x"), p), -y])
            z = -(a @ weights)
            log_q, h, over = normal_tail(z)
            seen = e > 0
            total[0] += np.where(seen, math.log(theta) - 0.5 * z * z - _HALF_LOG_2PI - y, log_q).sum()
            slope = a.T @ np.where(seen, z, h)
            slope[-1] += seen.sum() / theta
            info = a.T @ (a * np.where(seen, 1.0, h * over)[:, None])
            info[-1, -1] += seen.sum() / theta**2
            total[1:p + 2] += slope
            total[p + 2:] += info[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total) - 1), pa.int32()), pa.array(total)], names=["i", "v"])

    summed = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return {r.i: r.v for r in summed.collect()}


def _state(rows: DataFrame, gamma: np.ndarray, theta: float) -> tuple[float, np.ndarray, np.ndarray]:
    sums = score_sums(rows, gamma, theta)
    p = len(gamma) + 1
    info = np.zeros((p, p))
    upper = np.triu_indices(p)
    info[upper] = [sums[p + k] for k in range(len(upper[0]))]
    return sums[-1], np.array([sums[k] for k in range(p)]), info + np.triu(info, 1).T


def fit_aft(df: DataFrame, cols: Sequence[str], duration: str = "duration", event: str = "event_observed", max_iter: int = 50, tol: float = 1e-8) -> Aft:
    """Maximum likelihood; durations must be positive, and some event must have been seen."""
    means, stds = scaling(df, cols)
    rows = scaled_rows(df, cols, means, stds, duration, event).persist()
    try:
        start = rows.agg(F.count("*").alias("n"), F.sum("e").alias("events"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")).first()
        if not start.events:
            raise ValueError("no event was observed: sigma has no maximum likelihood estimate")
        n, theta = start.n, 1 / max(start.std, 1e-6)
        gamma = np.zeros(len(cols) + 1)
        gamma[0] = start.mean * theta
        loglik, slope, info = _state(rows, gamma, theta)
        converged = False
        for step_no in range(1, max_iter + 1):  # noqa: B007
            # a feature that is constant or a copy leaves a flat direction, which the smallest step takes
            step = np.linalg.lstsq(info, slope, rcond=1e-12)[0]
            if slope @ step < 2 * tol:
                converged = True
                break
            size = 1.0
            while True:
                at = theta + size * step[-1]
                new = _state(rows, gamma + size * step[:-1], at) if at > 0 else None
                if new is not None and new[0] >= loglik + 1e-4 * size * float(slope @ step):
                    break
                size /= 2
                if size < 1e-6:
                    break
            if size < 1e-6:
                break
            gamma, theta, (loglik, slope, info) = gamma + size * step[:-1], at, new
    finally:
        rows.unpersist()
    return Aft(tuple(cols), tuple(means), tuple(stds), gamma / theta, 1 / theta, slope, info, float(loglik), step_no, n, int(start.events), converged)


def aft_scores(df: DataFrame, fit: Aft, out: str = "mu") -> DataFrame:
    """Predicted mean of log duration; its negative is the risk."""
    mu = F.lit(float(fit.beta[0]))
    for c, m, s, b in zip(fit.cols, fit.means, fit.stds, fit.beta[1:]):
        mu = mu + (F.col(c) - m) * float(b / s)
    return df.withColumn(out, mu).withColumn("risk", -F.col(out))


def aft_curves(df: DataFrame, fit: Aft, times: Sequence[int], mu: str = "mu", prefix: str = "s_") -> DataFrame:
    """S(t) of the fitted model: its own mean per row and its own sigma."""
    return df.withColumns({f"{prefix}{t}": clip(1.0 - norm_cdf((math.log(t) - F.col(mu)) / fit.sigma), 1e-10, 1.0) for t in times})
