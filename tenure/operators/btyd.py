"""Buy-till-you-die models: purchase counts (BG/NBD) and spend (Gamma-Gamma).

Fits are Newton steps in log parameters. Each step is one aggregate over the customers
collapsed to distinct (frequency, recency, age); terms that depend on the frequency
alone come from its histogram, which has at most one row per observed day. Scores are
column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tenure.functions.scalars import money_sum
from tenure.operators.ordered import n_ranges, quantiles

KEY = "customer_id"


@dataclass(frozen=True)
class BgNbd:
    r: float
    alpha: float
    a: float
    b: float
    loglik: float = float("nan")
    iterations: int = 0
    hessian: tuple = field(default=(), compare=False)


@dataclass(frozen=True)
class GammaGamma:
    p: float
    q: float
    v: float
    loglik: float = float("nan")
    iterations: int = 0
    hessian: tuple = field(default=(), compare=False)


# Inputs ---------------------------------------------------------------------------


def rfm(tx: DataFrame, obs_end: Column | None = None) -> DataFrame:
    """Frequency, recency, age and spend from calendar days with purchases.

    Frequency counts repeat days; spend is the mean daily total after the first day.
    """
    end = obs_end if obs_end is not None else tx.agg(F.max("invoice_date")).scalar()
    days = tx.groupBy(KEY, F.to_date("invoice_date").alias("day")).agg(
        money_sum("line_total").alias("total"))
    agg = days.groupBy(KEY).agg(
        F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"),
        money_sum("total").alias("spend"), F.min_by("total", "day").alias("first_total"))
    x = F.col("n") - 1
    later = F.col("spend").cast("decimal(18,4)") - F.col("first_total").cast("decimal(18,4)")
    return agg.select(
        KEY, x.cast("double").alias("frequency"),
        F.datediff("last", "first").cast("double").alias("recency"),
        F.datediff(F.to_date(end), F.col("first")).cast("double").alias("T"),
        F.when(x > 0, later.cast("double") / x).otherwise(0.0).alias("monetary_value"))


def split_one_timers(df: DataFrame, col: str = "frequency") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(col) > 0), df.where(F.col(col) == 0)


def calibration_end(tx: DataFrame, frac: float = 0.7) -> Column:
    """First time plus a share of the whole days observed."""
    lo, hi = F.min("invoice_date"), F.max("invoice_date")
    days = F.floor((F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))) / 86_400_000_000)
    return tx.agg(lo.alias("lo"), F.floor(days * F.lit(frac)).cast("int").alias("d")).select(
        F.expr("lo + make_dt_interval(d)")).scalar()


def calibration_holdout(tx: DataFrame, frac: float = 0.7) -> DataFrame:
    """RFM of the calibration period and purchase days of the holdout."""
    cut = calibration_end(tx, frac)
    end = tx.agg(F.max("invoice_date")).scalar()
    day = F.to_date("invoice_date")
    cal = rfm(tx.where(day <= F.to_date(cut)), cut)
    held = tx.where(day > F.to_date(cut)).groupBy(KEY).agg(F.count_distinct(day).alias("frequency_holdout"))
    return cal.select(
        KEY, F.col("frequency").alias("frequency_cal"), F.col("recency").alias("recency_cal"),
        F.col("T").alias("T_cal"),
    ).join(held, KEY, "left").fillna(0, ["frequency_holdout"]).withColumn(
        "duration_holdout", F.datediff(F.to_date(end), F.to_date(cut)).cast("double"))


def independence_corr(df: DataFrame) -> DataFrame:
    return df.where(F.col("frequency") > 0).agg(F.corr("frequency", "monetary_value").alias("corr"))


# Likelihoods ------------------------------------------------------------------------


def _mix(x: Column, tx: Column, T: Column, m: BgNbd) -> tuple[Column, Column]:
    """Log of the alive + dropped-out term, and the dropped-out share."""
    u = -(x + m.r) * F.ln(T + m.alpha)
    v = F.when(x > 0, math.log(m.a) - F.ln(x + (m.b - 1)) - (x + m.r) * F.ln(tx + m.alpha))
    top = F.greatest(u, v)
    value = top + F.when(x > 0, F.log1p(F.exp(-F.abs(u - v)))).otherwise(0.0)
    share = F.when(x > 0, 1 / (1 + F.exp(u - v))).otherwise(0.0)
    return value, share


def _log_rising(base: float, x: Column) -> Column:
    """ln base(base+1)...(base+x-1)."""
    terms = F.sequence(F.lit(0), x.cast("int") - 1)
    return F.when(x > 0, F.aggregate(terms, F.lit(0.0), lambda s, i: s + F.ln(i + F.lit(float(base)))))\
        .otherwise(0.0)


def loglik_column(m: BgNbd, x: str = "frequency", tx: str = "recency", T: str = "T") -> Column:
    x_, t_, T_ = F.col(x), F.col(tx), F.col(T)
    value, _ = _mix(x_, t_, T_, m)
    return (_log_rising(m.r, x_) + m.r * math.log(m.alpha) + _log_rising(m.b, x_)
            - _log_rising(m.a + m.b, x_) + value)


def loglik(df: DataFrame, m: BgNbd) -> DataFrame:
    """Log-likelihood at given parameters, on customers collapsed to distinct histories."""
    cells = df.groupBy("frequency", "recency", "T").agg(F.count("*").alias("n"))
    return cells.agg(F.sum(F.col("n") * loglik_column(m)).alias("loglik"), F.sum("n").alias("n"))


def _newton(value: Callable, start: Sequence[float], max_iter: int, tol: float = 1e-8):
    """Maximise over logs of positive parameters; ``value`` gives (f, gradient, Hessian)."""
    phi = np.log(np.asarray(start, dtype=float))
    lam, steps = 1e-3, 0
    f, g, h = value(np.exp(phi))

    def logs(theta, g, h):
        return theta * g, np.diag(theta * g) + np.outer(theta, theta) * h

    while steps < max_iter:
        gl, hl = logs(np.exp(phi), g, h)
        if np.max(np.abs(gl)) < tol:
            break
        w, q = np.linalg.eigh(-hl)
        step = q @ ((q.T @ gl) / (np.abs(w) + lam))
        step *= min(1.0, 2.0 / max(1e-300, np.max(np.abs(step))))
        steps += 1
        f2, g2, h2 = value(np.exp(phi + step))
        if np.isfinite(f2) and f2 >= f - 1e-13 * max(1.0, abs(f)):
            small = np.max(np.abs(step)) < 1e-9
            phi, f, g, h = phi + step, f2, g2, h2
            lam = max(lam / 10, 1e-12)
            if small:
                break
        else:
            lam = max(lam * 10, 1e-6)
            if lam > 1e10:
                break
    theta = np.exp(phi)
    gl, hl = logs(theta, g, h)
    return theta, f, steps, hl


def fit_bgnbd(df: DataFrame, penalty: float = 0.0, prior_sigma: float | None = None,
              start: Sequence[float] = (1.0, 1.0, 1.0, 1.0), max_iter: int = 60) -> BgNbd:
    """Maximum (penalised) likelihood, or the posterior mode under half-normal priors.

    The penalty applies to the mean log-likelihood with time scaled so the largest age is
    10; the priors apply to unscaled parameters.
    """
    cells = df.groupBy("frequency", "recency", "T").agg(F.count("*").alias("n")).persist()
    try:
        hist = {int(r.x): r.n for r in cells.groupBy(F.col("frequency").alias("x")).agg(
            F.sum("n").alias("n")).collect()}
        total = sum(hist.values())
        scale = 10.0 / max(1.0, cells.agg(F.max("T")).first()[0])
        top = max(hist)
        xs = np.array(sorted(hist))
        ns = np.array([hist[x] for x in sorted(hist)], dtype=float)

        raw: dict[str, float] = {}

        def rising(base: float, order: int) -> np.ndarray:
            i = base + np.arange(top)
            f = {0: np.log(i), 1: 1 / i, 2: -1 / i ** 2}[order] if top else np.zeros(0)
            return np.concatenate([[0.0], np.cumsum(f)])[xs]

        def value(theta):
            r, alpha, a, b = theta
            m = BgNbd(r, alpha, a, b)
            x, t, T = F.col("frequency"), F.col("recency") * scale, F.col("T") * scale
            f, p = _mix(x, t, T, m)
            n, live = F.col("n"), 1 - p
            lu, lv = F.ln(T + alpha), F.ln(t + alpha)
            iu, iv = 1 / (T + alpha), 1 / (t + alpha)
            ib = F.when(x > 0, 1 / (x + (b - 1))).otherwise(0.0)
            rx = x + r
            gu = [-lu, -rx * iu, F.lit(0.0), F.lit(0.0)]
            gv = [-lv, -rx * iv, F.lit(1 / a), -ib]
            cols = {"f": f}
            for i in range(4):
                cols[f"g{i}"] = live * gu[i] + p * gv[i]
                for j in range(i, 4):
                    cols[f"h{i}{j}"] = live * p * (gv[i] - gu[i]) * (gv[j] - gu[j])
            cols["h01"] = cols["h01"] - live * iu - p * iv
            cols["h11"] = cols["h11"] + rx * (live * iu * iu + p * iv * iv)
            cols["h22"] = cols["h22"] - p / (a * a)
            cols["h33"] = cols["h33"] + p * ib * ib
            row = cells.agg(*[F.sum(n * c).alias(k) for k, c in cols.items()]).first()
            val = row["f"] + float(ns @ (rising(r, 0) + rising(b, 0) - rising(a + b, 0))) + total * r * math.log(alpha)
            grad = np.array([row[f"g{i}"] for i in range(4)])
            hess = np.array([[row[f"h{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
            ab1, ab2 = float(ns @ rising(a + b, 1)), float(ns @ rising(a + b, 2))
            grad += [float(ns @ rising(r, 1)) + total * math.log(alpha), total * r / alpha,
                     -ab1, float(ns @ rising(b, 1)) - ab1]
            hess[0, 0] += float(ns @ rising(r, 2))
            hess[0, 1] += total / alpha
            hess[1, 0] += total / alpha
            hess[1, 1] -= total * r / alpha ** 2
            hess[2:, 2:] -= ab2
            hess[3, 3] += float(ns @ rising(b, 2))
            # in unscaled time each repeat purchase carries the density's unit
            raw["loglik"] = val + float(ns @ xs) * math.log(scale)
            val, grad, hess = val / total, grad / total, hess / total
            if prior_sigma:
                k = np.array([1.0, 1.0 / scale ** 2, 1.0, 1.0]) / (prior_sigma ** 2 * total)
                val -= float(k @ theta ** 2) / 2
                grad, hess = grad - k * theta, hess - np.diag(k)
            if penalty:
                val -= penalty * float(theta @ theta)
                grad, hess = grad - 2 * penalty * theta, hess - 2 * penalty * np.eye(4)
            return val, grad, hess

        theta, _, steps, hess = _newton(value, start, max_iter)
        value(theta)
    finally:
        cells.unpersist()
    r, alpha, a, b = (float(v) for v in theta)
    return BgNbd(r, alpha / scale, a, b, raw["loglik"], steps, tuple(map(tuple, hess * total)))


def _digamma(x: np.ndarray, order: int = 0) -> np.ndarray:
    """Digamma (0) or trigamma (1) by upward recurrence and the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(15):
        low = x < 15
        out = out + np.where(low, -1 / x if order == 0 else 1 / x ** 2, 0.0)
        x = np.where(low, x + 1, x)
    i2 = 1 / x ** 2
    if order == 0:
        return out + np.log(x) - 0.5 / x - i2 * (1 / 12 - i2 * (1 / 120 - i2 / 252))
    return out + 1 / x + 0.5 * i2 + i2 / x * (1 / 6 - i2 * (1 / 30 - i2 / 42))


def fit_gamma_gamma(df: DataFrame, penalty: float = 0.0, prior_sigma: float | None = None,
                    start: Sequence[float] = (1.0, 1.0, 1.0), max_iter: int = 100,
                    scale_spend: bool = True) -> GammaGamma:
    """Spend model on repeat customers; gamma terms need only the frequency histogram.

    Spend is scaled to mean 1 while fitting, so a penalty does not depend on the currency;
    ``scale_spend=False`` applies the penalty to parameters in spend units.
    """
    rows = df.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0)).select(
        F.col("frequency").alias("x"), F.col("monetary_value").alias("m")).persist()
    try:
        hist = {int(r.x): r.n for r in rows.groupBy("x").agg(F.count("*").alias("n")).collect()}
        xs = np.array(sorted(hist), dtype=float)
        ns = np.array([hist[int(x)] for x in xs], dtype=float)
        total = float(ns.sum())
        unit = float(rows.agg(F.avg("m")).first()[0]) if scale_spend else 1.0
        m, x = F.col("m") / unit, F.col("x")
        fixed = rows.agg(F.sum(F.ln(m)).alias("lm"), F.sum(x * F.ln(m)).alias("xlm")).first()
        xlx = float(ns @ (xs * np.log(xs)))
        lg = np.vectorize(math.lgamma)

        def value(theta):
            p, q, v = (float(t) for t in theta)
            d = x * m + v
            row = rows.agg(
                F.sum(F.ln(d)).alias("s1"), F.sum(x * F.ln(d)).alias("s2"), F.sum(1 / d).alias("s3"),
                F.sum(x / d).alias("s4"), F.sum(1 / (d * d)).alias("s5"), F.sum(x / (d * d)).alias("s6")).first()
            pq, px = p * xs + q, p * xs
            val = (float(ns @ (lg(pq) - lg(px))) - total * math.lgamma(q) + total * q * math.log(v)
                   + p * fixed.xlm - fixed.lm + p * xlx - p * row.s2 - q * row.s1)
            psi, psi_px = _digamma(pq), _digamma(px)
            tri, tri_px = _digamma(pq, 1), _digamma(px, 1)
            grad = np.array([
                float(ns @ (xs * (psi - psi_px))) + fixed.xlm + xlx - row.s2,
                float(ns @ psi) - total * float(_digamma(q)) + total * math.log(v) - row.s1,
                total * q / v - p * row.s4 - q * row.s3])
            hpq = float(ns @ (xs * tri))
            hess = np.array([
                [float(ns @ (xs ** 2 * (tri - tri_px))), hpq, -row.s4],
                [hpq, float(ns @ tri) - total * float(_digamma(q, 1)), total / v - row.s3],
                [-row.s4, total / v - row.s3, -total * q / v ** 2 + p * row.s6 + q * row.s5]])
            val, grad, hess = val / total, grad / total, hess / total
            if prior_sigma:
                k = 1 / (prior_sigma ** 2 * total)
                val -= k * float(theta @ theta) / 2
                grad, hess = grad - k * theta, hess - k * np.eye(3)
            if penalty:
                val -= penalty * float(theta @ theta)
                grad, hess = grad - 2 * penalty * theta, hess - 2 * penalty * np.eye(3)
            return val, grad, hess

        theta, f, steps, hess = _newton(value, start, max_iter)
    finally:
        rows.unpersist()
    p, q, v = (float(t) for t in theta)
    shift = -total * math.log(unit) if unit != 1.0 else 0.0
    return GammaGamma(p, q, v * unit, float(f * total) + shift, steps, tuple(map(tuple, hess * total)))


# Scores -----------------------------------------------------------------------------


def p_alive_column(m: BgNbd, x: Column, tx: Column, T: Column) -> Column:
    odds = F.try_divide(F.lit(m.a), x + (m.b - 1)) * F.exp((x + m.r) * (F.ln(T + m.alpha) - F.ln(tx + m.alpha)))
    return F.when(x > 0, 1 / (1 + odds)).otherwise(1.0)


def _purchases(m: BgNbd, t, x: np.ndarray, tx: np.ndarray, T: np.ndarray) -> np.ndarray:
    """Expected purchases in the next t days for a batch of customers; a column of times gives a row for each.

    The hypergeometric series is in its transformed form, whose terms do not grow with
    the purchase count. A customer's sum is done when a geometric bound on all terms that
    are left falls below rounding; there is no limit on the number of terms.
    """
    a = m.a + 1e-6 if abs(m.a - 1) < 1e-6 else m.a
    z = t / (m.alpha + T + t)
    A, B, C = a + m.b - 1 - m.r, a - 1, a + m.b + x - 1
    total = _series(A, B, C, z)
    gone = np.exp(B * (np.log(m.alpha + T) - np.log(m.alpha + T + t))) * total
    return C / B * (1 - gone) * _alive(m, x, tx, T)


def _series(A: float, B: float, C: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Gauss hypergeometric series at 0 <= z < 1, term by term for the rows not yet done.

    With several rows of ``z``, a step's factors that depend on ``C`` alone are computed once for all of them.
    """
    C, z = np.asarray(C, float), np.asarray(z, float)
    shape = np.broadcast_shapes(C.shape, z.shape)
    C = np.broadcast_to(C, shape[-1:]).ravel()
    z = np.broadcast_to(z, shape).reshape(math.prod(shape[:-1]), len(C))
    out, open_ = np.zeros(z.shape), np.arange(len(C))
    term, total, k = np.ones(z.shape), np.zeros(z.shape), 0
    while len(open_):
        total += term
        ratio = (A + k) * (B + k) / ((C + k) * (k + 1)) * z
        term *= ratio
        k += 1
        if k % 16 == 0:
            # from here on, ratios stay below the larger of this one and z
            worst = np.maximum(np.abs(ratio), z)
            left = np.abs(term) / np.maximum(1 - worst, 1e-300)
            done = ((term == 0) | np.isnan(term) | ((worst < 1) & (k > max(abs(A), abs(B))) & (left <= 1e-16 * np.abs(total)))).all(axis=0)
            if done.any():
                out[:, open_[done]] = total[:, done]
                keep = ~done
                open_, term, total, C, z = open_[keep], term[:, keep], total[:, keep], C[keep], z[:, keep]
    return out.reshape(shape)


def _alive(m: BgNbd, x: np.ndarray, tx: np.ndarray, T: np.ndarray) -> np.ndarray:
    odds = m.a / np.where(x > 0, m.b + x - 1, 1.0) * np.exp((m.r + x) * (np.log(m.alpha + T) - np.log(m.alpha + tx)))
    return np.where(x > 0, 1 / (1 + odds), 1.0)


def _spend(g: GammaGamma, x: np.ndarray, money: np.ndarray) -> np.ndarray:
    w = g.p * x / (g.p * x + g.q - 1)
    return w * money + (1 - w) * g.p * g.v / (g.q - 1)


def _value(m: BgNbd, spend, x, tx, T, months: int, rate: float, month_days: int = 30) -> np.ndarray:
    return spend * _discounted(_purchases(m, _months(months, month_days), x, tx, T), rate)


def _months(n: int, month_days: int = 30) -> np.ndarray:
    """The ends of the next n months, as a column."""
    return float(month_days) * np.arange(1, n + 1)[:, None]


def _discounted(grown: np.ndarray, rate: float) -> np.ndarray:
    """Purchases of each month, from those up to its end, discounted and added up."""
    total, before = 0.0, 0.0
    for k, now in enumerate(grown, 1):
        total = total + (now - before) / (1 + rate) ** k
        before = now
    return total


# The series has no built-in counterpart. As a higher-order function it is interpreted
# term by term; over Arrow batches numpy sums it for all rows at once.


def expected_purchases_column(m: BgNbd, t: float | Column, x: Column, tx: Column, T: Column) -> Column:
    """Expected purchases in the next t days."""
    @F.pandas_udf("double")
    def series(t_: pd.Series, x_: pd.Series, tx_: pd.Series, T_: pd.Series) -> pd.Series:
        return pd.Series(_purchases(m, *(c.to_numpy(dtype=float) for c in (t_, x_, tx_, T_))))

    return series(t if isinstance(t, Column) else F.lit(float(t)), x, tx, T)


def expected_spend_column(g: GammaGamma, x: Column, money: Column) -> Column:
    w = F.try_divide(x * g.p, x * g.p + (g.q - 1))
    return w * money + (1 - w) * F.lit(g.p * g.v / (g.q - 1))


def clv_column(m: BgNbd, spend: Column, x: Column, tx: Column, T: Column, months: int = 6, rate: float = 0.01) -> Column:
    """Discounted value of the purchases expected in each of the next 30-day months."""
    @F.pandas_udf("double")
    def value(s_: pd.Series, x_: pd.Series, tx_: pd.Series, T_: pd.Series) -> pd.Series:
        return pd.Series(_value(m, *(c.to_numpy(dtype=float) for c in (s_, x_, tx_, T_)), months, rate))

    return value(spend, x, tx, T)


def p_alive(df: DataFrame, m: BgNbd, out: str = "p_alive") -> DataFrame:
    return df.withColumn(out, p_alive_column(m, F.col("frequency"), F.col("recency"), F.col("T")))


def expected_purchases(df: DataFrame, m: BgNbd, t: float | Column = 180.0, out: str = "expected_purchases") -> DataFrame:
    return df.withColumn(out, expected_purchases_column(m, t, F.col("frequency"), F.col("recency"), F.col("T")))


def expected_spend(df: DataFrame, g: GammaGamma, out: str = "expected_spend", fill_median: bool = False) -> DataFrame:
    """Expected spend of repeat customers; one-timers get NULL or the repeat median."""
    spend = F.when(F.col("frequency") > 0, expected_spend_column(g, F.col("frequency"), F.col("monetary_value")))
    scored = df.withColumn(out, spend)
    if not fill_median:
        return scored
    mid = quantiles(scored.where(F.col(out).isNotNull()), out, [0.5], ["m"]).scalar()
    return scored.withColumn(out, F.coalesce(F.col(out), mid))


def clv(df: DataFrame, m: BgNbd, g: GammaGamma, months: int = 6, rate: float = 0.01, out: str = "clv") -> DataFrame:
    """Discounted value of repeat customers; NULL for one-timers."""
    x, tx, T = F.col("frequency"), F.col("recency"), F.col("T")
    value = clv_column(m, expected_spend_column(g, x, F.col("monetary_value")), x, tx, T, months, rate)
    return df.withColumn(out, F.when(x > 0, value))


def clv_simple(df: DataFrame, purchases: str = "expected_purchases", spend: str = "expected_spend", out: str = "clv_simple") -> DataFrame:
    return df.withColumn(out, F.col(purchases) * F.col(spend))


def clv_fill(df: DataFrame, col: str = "clv") -> DataFrame:
    """One-timers get 0."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(0.0)))


def validate(cal: DataFrame, m: BgNbd) -> DataFrame:
    """Predicted against actual purchases of the holdout."""
    from tenure.operators import metrics
    scored = cal.withColumn("predicted_holdout", expected_purchases_column(
        m, F.col("duration_holdout"), F.col("frequency_cal"), F.col("recency_cal"), F.col("T_cal")))
    base = metrics.regression(scored, "frequency_holdout", "predicted_holdout").drop("r2")
    return base.withColumn("spearman", metrics.spearman(scored, "frequency_holdout", "predicted_holdout").scalar())


def score_grid(df: DataFrame, m: BgNbd, t: float = 30.0) -> DataFrame:
    """P(alive) and expected purchases on the frequency x recency grid the data spans.

    Both axes run to the largest observed value, at the largest observed age.
    """
    span = df.agg(F.max("frequency").cast("int").alias("x"), F.max("recency").cast("int").alias("r"), F.max("T").alias("T")).first()
    if span["x"] is None:
        span = {"x": -1, "r": 0, "T": None}
    # the frequencies are dealt to tasks before a row of recencies grows from each
    rows = df.sparkSession.range(span["x"] + 1).repartition(n_ranges(df), "id")
    cells = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(span["r"]))).alias("r"))
    grid = cells.select(F.col("id").cast("double").alias("frequency"), F.col("r").cast("double").alias("recency"), F.lit(span["T"]).cast("double").alias("T"))
    return expected_purchases(p_alive(grid, m), m, t)


# Posterior --------------------------------------------------------------------------


#: Degrees of freedom of the proposal, and its widest standard deviation on the log scale.
PROPOSAL_DF, WIDEST = 5, 20.0


def _proposal(mode: Sequence[float], hessian: Sequence[Sequence[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, axes and widths of the normal approximation on the log scale, as the curvature has them.

    A direction without curvature gets the widest spread there is: most draws along it are then far off, which
    their weights show.
    """
    w, q = np.linalg.eigh(-np.array(hessian))
    return np.log(np.array(mode)), q, 1 / np.sqrt(np.maximum(np.abs(w), WIDEST**-2))


def _propose(mode: Sequence[float], hessian: Sequence[Sequence[float]], n: int, seed: int, df: int | None = PROPOSAL_DF) -> tuple[np.ndarray, np.ndarray]:
    """Draws of positive parameters around the mode, and the log density (up to a constant) of their logs.

    Tails are those of Student's t, so that no part of a longer-tailed posterior is out of reach; ``df`` None is the normal.
    """
    centre, q, sd = _proposal(mode, hessian)
    rng = np.random.default_rng(seed)
    noise = rng.standard_normal((n, len(mode)))
    if df is None:
        density = -0.5 * (noise**2).sum(1)
    else:
        noise /= np.sqrt(rng.chisquare(df, n) / df)[:, None]
        density = -0.5 * (df + len(mode)) * np.log1p((noise**2).sum(1) / df)
    return np.exp(centre + (noise * sd) @ q.T), density


def draws(m: BgNbd, g: GammaGamma | None, n: int = 500, seed: int = 42) -> list[dict[str, float]]:
    """Draws of the normal approximation around the fitted modes: a small parameter table."""
    return _table(_propose((m.r, m.alpha, m.a, m.b), m.hessian, n, seed, None)[0],
                  _propose((g.p, g.q, g.v), g.hessian, n, seed + 1, None)[0] if g is not None else None)


def _table(bg: np.ndarray, gg: np.ndarray | None) -> list[dict[str, float]]:
    out = [dict(draw=i, r=float(v[0]), alpha=float(v[1]), a=float(v[2]), b=float(v[3])) for i, v in enumerate(bg)]
    if gg is not None:
        for d, v in zip(out, gg):
            d.update(p=float(v[0]), q=float(v[1]), v=float(v[2]))
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma by upward recurrence and Stirling's series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(12):
        low = x < 12
        shift -= np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    i = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680)))


def _bg_loglik(theta: np.ndarray, x: np.ndarray, tx: np.ndarray, T: np.ndarray) -> np.ndarray:
    """BG/NBD log-likelihood of a history (rows) at parameters (columns)."""
    r, alpha, a, b = theta.T[:, None, :]
    # gamma terms depend on the purchase count alone
    counts, of = np.unique(x, return_inverse=True)
    k = counts[:, None]
    gammas = (_lgamma(r + k) - _lgamma(r) + r * np.log(alpha) + _lgamma(a + b) + _lgamma(b + k) - _lgamma(b) - _lgamma(a + b + k))[of]
    x, tx, T = x[:, None], tx[:, None], T[:, None]
    alive = -(r + x) * np.log(alpha + T)
    gone = np.where(x > 0, np.log(a) - np.log(np.where(x > 0, b + x - 1, 1.0)) - (r + x) * np.log(alpha + tx), -np.inf)
    return gammas + np.logaddexp(alive, gone)


def _gg_loglik(theta: np.ndarray, x: np.ndarray, money: np.ndarray) -> np.ndarray:
    """Gamma-gamma log-likelihood of a customer's mean spend (rows) at parameters (columns)."""
    p, q, v = theta.T[:, None, :]
    counts, of = np.unique(x, return_inverse=True)
    k = counts[:, None]
    gammas = (_lgamma(p * k + q) - _lgamma(p * k) - _lgamma(q) + q * np.log(v) + p * k * np.log(k))[of]
    x, money = x[:, None], money[:, None]
    return gammas + (p * x - 1) * np.log(money) - (p * x + q) * np.log(x * money + v)


def draw_logliks(rows: DataFrame, theta: np.ndarray, loglik: Callable, cols: Sequence[str]) -> np.ndarray:
    """Log-likelihood of all rows at every draw, in one pass; ``n`` counts a row's copies.

    A task works on slices of its rows and hands on one number for each draw.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(theta))
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at:at + 1000]
                with np.errstate(all="ignore"):
                    total += part["n"].to_numpy(float) @ loglik(theta, *(part[c].to_numpy(float) for c in cols))
        yield pd.DataFrame({"i": np.arange(len(theta)), "f": total})

    sums = rows.select("n", *cols).mapInPandas(run, "i int, f double").groupBy("i").agg(F.sum("f").alias("f")).collect()
    out = np.full(len(theta), -np.inf)
    for r in sums:
        out[r.i] = r.f
    return out


@dataclass(frozen=True)
class Posterior:
    """Equally weighted draws, and how many independent draws each of the two models' weights are worth."""

    rows: list[dict[str, float]]
    ess_purchases: float
    ess_spend: float | None


def _resample(theta: np.ndarray, target: np.ndarray, density: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, float]:
    """Draws in proportion to target over density (systematic resampling), and the effective sample size."""
    logs = np.where(np.isfinite(target), target, -np.inf) - density
    w = np.exp(logs - logs.max())
    w /= w.sum()
    at = (np.arange(n) + np.random.default_rng(seed).random()) / n
    picked = theta[np.minimum(np.searchsorted(np.cumsum(w), at), len(theta) - 1)]
    return np.random.default_rng(seed + 1).permutation(picked), float(1 / (w @ w))


def posterior_draws(df: DataFrame, m: BgNbd, g: GammaGamma | None, n: int = 500, proposals: int = 2000, seed: int = 42,
                    prior_sigma: float = 10.0) -> Posterior:
    """Draws from the posterior itself: proposals around the mode, weighted by their exact likelihood and prior.

    Parameters have half-normal priors. The likelihood of all proposals is one aggregate over the distinct histories (and one over repeat customers' spend, in units of
    its mean). The effective sample size says what the draws are worth: it is low where the mode's curvature does not
    describe the posterior, as along a flat direction.
    """
    theta, density = _propose((m.r, m.alpha, m.a, m.b), m.hessian, proposals, seed)
    cells = df.groupBy("frequency", "recency", "T").agg(F.count("*").alias("n"))
    prior = -(theta**2).sum(1) / (2 * prior_sigma**2) + np.log(theta).sum(1)
    bg, ess = _resample(theta, draw_logliks(cells, theta, _bg_loglik, ("frequency", "recency", "T")) + prior, density, n, seed)
    if g is None:
        return Posterior(_table(bg, None), ess, None)
    spenders = df.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    unit = spenders.agg(F.avg("monetary_value")).first()[0] or 1.0
    theta, density = _propose((g.p, g.q, g.v / unit), g.hessian, proposals, seed + 1)
    spend = spenders.select("frequency", (F.col("monetary_value") / unit).alias("m"), F.lit(1).alias("n"))
    prior = -(theta**2).sum(1) / (2 * prior_sigma**2) + np.log(theta).sum(1)
    gg, ess_spend = _resample(theta, draw_logliks(spend, theta, _gg_loglik, ("frequency", "m")) + prior, density, n, seed + 2)
    return Posterior(_table(bg, gg * [1.0, 1.0, unit]), ess, ess_spend)


def thin(rows: Sequence[dict], k: int = 2) -> list[dict]:
    """Every k-th draw."""
    return [d for d in rows if d["draw"] % k == 0]


POSTERIOR = ("purchases", "p_alive", "spend", "clv")


def posterior(df: DataFrame, rows: Sequence[dict], t: float = 180.0, months: int = 6, rate: float = 0.01,
              what: Sequence[str] = POSTERIOR) -> DataFrame:
    """Mean and deviation over draws per customer; spend and value only for repeat customers.

    The draws are a small table that travels with the task; each Arrow batch of customers
    is scored under every draw in turn, so no join and no shuffle is needed. A batch's equal
    histories are scored once, all times at once, and times that nobody asks for are left out.
    """
    models = [(BgNbd(d["r"], d["alpha"], d["a"], d["b"]),
               GammaGamma(d["p"], d["q"], d["v"]) if "p" in d else None) for d in rows]
    fields = [f"{k}_{s}" for k in what for s in ("mean", "std")]
    ends = _months(months)
    # the last month may end at t
    at_t = int(np.flatnonzero(ends[:, 0] == t)[0]) if "clv" in what and t in ends else len(ends) if "clv" in what else 0
    times = ends if "clv" in what else ends[:0]
    if "purchases" in what and at_t == len(times):
        times = np.vstack([times, [[float(t)]]])

    @F.pandas_udf(", ".join(f"{f} double" for f in fields))
    def score(x_: pd.Series, tx_: pd.Series, T_: pd.Series, money_: pd.Series) -> pd.DataFrame:
        x, tx, T, money = (c.to_numpy(dtype=float) for c in (x_, tx_, T_, money_))
        cells, of = np.unique(np.column_stack([x, tx, T]), axis=0, return_inverse=True)
        of = of.ravel()
        once, more = cells[cells[:, 0] == 0].T, cells[cells[:, 0] != 0].T
        cx, ctx, cT = cells.T
        again = x != 0
        # place of a repeat customer's history among those of repeat customers
        place = (np.cumsum(cx != 0) - 1)[of[again]]
        sizes = {"purchases": len(cells), "p_alive": len(cells), "spend": int(again.sum()), "clv": int(again.sum())}
        total, squares = ({k: np.zeros(sizes[k]) for k in what} for _ in range(2))
        for i, (m, g) in enumerate(models, 1):
            grown = _purchases(m, times, *more) if len(times) else None
            spend = _spend(g, x[again], money[again]) if g is not None else None
            for k in what:
                if k == "purchases":
                    v = np.empty(len(cells))
                    v[cx == 0], v[cx != 0] = _purchases(m, float(t), *once), grown[at_t]
                elif k == "p_alive":
                    v = _alive(m, cx, ctx, cT)
                elif k == "spend":
                    v = spend
                else:
                    v = spend * _discounted(grown[:months], rate)[place]
                # running mean and squared deviations
                step = v - total[k]
                total[k] += step / i
                squares[k] += step * (v - total[k])
        out = {}
        for k in what:
            for s, found in (("mean", total[k]), ("std", np.sqrt(squares[k] / len(models)))):
                if k in ("purchases", "p_alive"):
                    out[f"{k}_{s}"] = found[of]
                else:
                    out[f"{k}_{s}"] = np.full(len(x), np.nan)
                    out[f"{k}_{s}"][again] = found
        return pd.DataFrame(out)[fields]

    scored = df.withColumn("_p", score("frequency", "recency", "T", "monetary_value"))
    return scored.withColumns({f: F.when(~F.isnan(F.col(f"_p.{f}")), F.col(f"_p.{f}")) for f in fields}).drop("_p")


def params_frame(spark: SparkSession, **models) -> DataFrame:
    """Fitted parameters, one row per model and parameter."""
    rows = [(name, k, float(v)) for name, m in models.items() for k, v in vars(m).items()
            if k not in ("hessian", "iterations")]
    return spark.createDataFrame(rows, "model string, parameter string, value double")


def compare_params(spark: SparkSession, a, b, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two fits side by side with their relative difference."""
    rows = [(k, float(vars(a)[k]), float(vars(b)[k])) for k in vars(a) if k not in ("hessian", "iterations")]
    df = spark.createDataFrame(rows, f"parameter string, {names[0]} double, {names[1]} double")
    return df.withColumn("diff_pct", F.try_divide((F.col(names[1]) - F.col(names[0])) * 100, F.abs(names[0])))
