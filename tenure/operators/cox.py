"""Cox regression from per-day sufficient sums, its ridge and elastic-net fits.

Rows are ranged by duration once. Each Newton step is one pass: tasks reduce the rows of a day to
weighted sums by one matrix product (numpy over Arrow batches), and the sums of a model's days are added up. Risk-set
totals are suffix sums over days. All models of a path (penalties times cross-validation folds) share a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.operators import metrics, ordered, survival

KEY = "customer_id"
#: (model, day) rows that a task holds before it hands them on.
DAY_ROWS = 20_000


@dataclass(frozen=True)
class Cox:
    """Coefficients are for standardised features; the baseline is at their means."""

    cols: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    beta: np.ndarray
    information: np.ndarray
    gradient: np.ndarray
    times: tuple[float, ...]
    h0: tuple[float, ...]
    loglik: float
    iterations: int
    n: int
    days: pd.DataFrame | None = None
    converged: bool = True


def scaling(df: DataFrame, cols: Sequence[str]) -> tuple[list[float], list[float]]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
    stds = [float(row[f"s{i}"] or 0.0) or 1.0 for i in range(len(cols))]
    return means, stds


def _scaled(df: DataFrame, cols, means, stds, duration, event, fold: Column | None = None) -> DataFrame:
    z = [((F.col(c) - m) / s).cast("double").alias(f"z{i}") for i, (c, m, s) in enumerate(zip(cols, means, stds))]
    rows = df.select(F.col(duration).cast("double").alias("t"), F.col(event).cast("double").alias("e"),
                     (fold if fold is not None else F.lit(-1)).cast("int").alias("fold"), *z)
    # a day with many rows is cut by their hash
    return rows.withColumn("cut", F.xxhash64(*[f"z{i}" for i in range(len(cols))])).repartitionByRange("t", "cut").sortWithinPartitions("t").drop("cut")


def _reduce(keys: np.ndarray, vals: np.ndarray, logs: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum rows of equal key; the 2q weighted columns are relative to exp(logs) and brought to the key's largest."""
    order = np.argsort(keys, kind="stable")
    k, v, s = keys[order], vals[order].copy(), logs[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
    top = np.maximum.reduceat(s, starts)
    v[:, 1:1 + 2 * q] *= np.exp(s - np.repeat(top, np.diff(np.append(starts, len(k)))))[:, None]
    return k[starts], np.add.reduceat(v, starts, axis=0), top


def _day_rows(rows: DataFrame, models: dict[int, tuple[int, np.ndarray]], p: int) -> DataFrame:
    """(m, t, v, s): per task, day and model the sums the likelihood needs; a model leaves its held-out fold out.

    ``models`` gives fold and coefficients by number. All models share the pass: a day's rows meet the weights of all
    models in one matrix product, and products with features of events take event rows only. A task that gets its rows in the order of days
    emits each day once.
    """
    iu = np.triu_indices(p)
    names = [f"z{i}" for i in range(p)]
    numbers = np.array(list(models), np.int32)
    folds = np.array([f for f, _ in models.values()])
    betas = np.column_stack([b for _, b in models.values()])

    def one_day(x: np.ndarray, full: np.ndarray, e: np.ndarray, score: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # weights are relative to the largest of their day, whose logarithm is kept
        top = score.max(0)
        w = np.exp(score - np.where(np.isfinite(top), top, 0.0))
        seen = np.flatnonzero(e > 0)
        with_event = has[seen].astype(np.float64)
        return np.hstack([with_event.sum(0)[:, None], w.T @ full, w[seen].T @ full[seen], with_event.T @ x[seen]]), top

    def join(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        top = np.maximum(old[1], new[1])
        base = np.where(np.isfinite(top), top, 0.0)
        out = np.zeros_like(old[0])
        for v, s in (old, new):
            scaled = v.copy()
            scaled[:, 1:v.shape[1] - p] *= np.exp(s - base)[:, None]
            out += scaled
        return out, top

    def packed(days: list[tuple[float, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        has = [np.isfinite(s) for _, _, s in days]
        values = np.concatenate([v[k] for (_, v, _), k in zip(days, has)])
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([numbers[k] for k in has])), pa.array(np.concatenate([np.full(k.sum(), t) for (t, _, _), k in zip(days, has)])),
            pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel())),
            pa.array(np.concatenate([s[k] for (_, _, s), k in zip(days, has)]))], names=["m", "t", "v", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[float, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, e, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "e", "fold"))
            order = np.argsort(t, kind="stable")
            t, e, fold = t[order], e[order], fold[order]
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])[order]
            full = np.hstack([np.ones((len(t), 1)), x, x[:, iu[0]] * x[:, iu[1]]])
            has = (fold[:, None] != folds[None, :]) | (folds < 0)[None, :]
            score = np.where(has, x @ betas, -np.inf)
            starts = np.append(0, np.flatnonzero(np.diff(t)) + 1)
            for at, to in zip(starts, np.append(starts[1:], len(t))):
                new = one_day(x[at:to], full[at:to], e[at:to], score[at:to], has[at:to])
                if done and done[-1][0] == t[at]:
                    done[-1] = (t[at], *join(done[-1][1:], new))
                else:
                    if len(done) * len(numbers) >= DAY_ROWS:
                        yield packed(done)
                        done = []
                    done.append((t[at], *new))
        if done:
            yield packed(done)

    return rows.mapInArrow(run, "m int, t double, v array<double>, s double")


def _one_model(pdf: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = 1 + p + p * (p + 1) // 2
    return _reduce(pdf["t"].to_numpy(), np.stack(pdf["v"].to_numpy()), pdf["s"].to_numpy(), q)


def _day_sums(rows: DataFrame, betas: dict[int, np.ndarray], p: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per model (its held-out fold excluded) the days, their sums and the logarithms these are relative to."""
    out = _day_rows(rows, {m: (m, b) for m, b in betas.items()}, p).toPandas()
    return {int(m): _one_model(part, p) for m, part in out.groupby("m")}


def _states(rows: DataFrame, models: dict[int, tuple[int, np.ndarray]], p: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Log-likelihood, gradient and information of many models in one job.

    The days of a model meet in one task, which hands on its p x p numbers only.
    """
    betas = {m: b for m, (_, b) in models.items()}

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ll, grad, info, *_ = _likelihood(*_one_model(pdf, p), betas[key[0]], p)
        return pd.DataFrame({"m": [key[0]], "ll": [ll], "grad": [grad], "info": [info.ravel()]})

    got = _day_rows(rows, models, p).groupBy("m").applyInPandas(finish, "m int, ll double, grad array<double>, info array<double>").collect()
    return {r.m: (r.ll, np.array(r.grad), np.array(r.info).reshape(p, p)) for r in got}


def _log_gamma_fall(x: float, n: float) -> float:
    """log Gamma(x) - log Gamma(x - n), for x - n of 17 or more, by Stirling's series."""
    y = x - n
    tail = sum(b * (x ** -(2 * k - 1) - y ** -(2 * k - 1)) for k, b in enumerate((1 / 12, -1 / 360, 1 / 1260, -1 / 1680), 1))
    return n * math.log(x) - (y - 0.5) * math.log1p(-n / x) - n + tail


def _reciprocals(x: float, n: float) -> tuple[float, float]:
    """Sums of 1/v and 1/v^2 over v = x - n, ..., x - 1, for x - n of 17 or more.

    These are digamma and trigamma differences, taken term by term of their series.
    """
    y = x - n
    one = -math.log1p(-n / x) + n / (2 * x * y)
    two = n / (x * y)
    for k, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66), 1):
        one += b / (2 * k) * (y ** (-2 * k) - x ** (-2 * k))
        two += b * (y ** (-2 * k - 1) - x ** (-2 * k - 1))
    return one, two + (y ** -2 - x ** -2) / 2


def _tie_sums(s0: float, e0: float, d: int) -> tuple[float, ...]:
    """Sums over ties l = 0..d-1 of the Efron terms at c = l/d.

    A term's denominator is e0/d (u - l) with u = s0 d / e0, so the sums are gamma function
    differences: the same formula and cost for any number of ties. The last 16 terms, near
    the singularity, are written out.
    """
    step = e0 / d
    u = s0 / step
    few = min(d, 16)
    near = u - np.arange(d - few, d)
    lg, r1, r2 = float(np.log(near).sum()), float((1 / near).sum()), float((1 / near**2).sum())
    if d > few:
        lg += _log_gamma_fall(u + 1, d - few)
        more = _reciprocals(u + 1, d - few)
        r1, r2 = r1 + more[0], r2 + more[1]
    lg, r1, r2 = lg + d * math.log(step), r1 / step, r2 / step**2
    r1c = (s0 * r1 - d) / e0
    r2c = (s0 * r2 - r1) / e0
    return lg, r1, r1c, r2, r2c, (s0 * r2c - r1c) / e0


def _at_risk(base: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix sums over days, each relative to the largest weight from its day on."""
    top = np.maximum.accumulate(logs[::-1])[::-1]
    risk = base * np.exp(logs - top)[:, None]
    for i in range(len(base) - 2, -1, -1):
        risk[i] += risk[i + 1] * np.exp(top[i + 1] - top[i])
    return risk, top


def _likelihood(t: np.ndarray, v: np.ndarray, logs: np.ndarray, beta: np.ndarray, p: int):
    """Efron log-likelihood, gradient, information and baseline hazard steps."""
    iu = np.triu_indices(p)
    q = 1 + p + len(iu[0])
    d = np.rint(v[:, 0]).astype(int)
    risk, top = _at_risk(v[:, 1:1 + q], logs)
    ev = v[:, 1 + q:1 + 2 * q] * np.exp(logs - top)[:, None]
    ex = v[:, 1 + 2 * q:]

    def square(row):
        m = np.zeros((p, p))
        m[iu] = row[1 + p:]
        return m + np.triu(m, 1).T

    ll, grad, info = 0.0, np.zeros(p), np.zeros((p, p))
    hazard = np.zeros(len(t))
    for i in np.flatnonzero(d):
        s, e = risk[i], ev[i]
        lg, r1, r1c, r2, r2c, r2cc = _tie_sums(s[0], e[0], d[i])
        s1, e1 = s[1:1 + p], e[1:1 + p]
        ll += float(ex[i] @ beta) - lg - d[i] * top[i]
        grad += ex[i] - (s1 * r1 - e1 * r1c)
        cross = np.outer(s1, e1)
        info += (square(s) * r1 - square(e) * r1c
                 - (np.outer(s1, s1) * r2 - (cross + cross.T) * r2c + np.outer(e1, e1) * r2cc))
        hazard[i] = d[i] / s[0] * math.exp(-top[i])
    return ll, grad, info, hazard, risk, d, ex


def fit_cox(df: DataFrame, cols: Sequence[str], penalty: float = 0.0, duration: str = "duration",
            event: str = "event_observed", max_iter: int = 30, tol: float = 1e-7) -> Cox:
    """Ridge-penalised Cox fit with Efron ties; the penalty is n/2 * penalty * |b|^2."""
    p = len(cols)
    means, stds = scaling(df, cols)
    rows = _scaled(df, cols, means, stds, duration, event).persist()
    try:
        n = rows.count()
        beta = np.zeros(p)

        def at(b):
            t, v, logs = _day_sums(rows, {-1: b}, p)[-1]
            ll, g, info, *rest = _likelihood(t, v, logs, b, p)
            return ll - n * penalty / 2 * b @ b, g - n * penalty * b, info + n * penalty * np.eye(p), ll, t, rest

        cur = at(beta)
        for it in range(1, max_iter + 1):
            step = np.linalg.solve(cur[2] + 1e-9 * np.eye(p), cur[1])
            size = 1.0
            while True:
                new = at(beta + size * step)
                if new[0] >= cur[0] - 1e-9 * abs(cur[0]) or size < 1e-4:
                    break
                size /= 2
            beta, cur = beta + size * step, new
            converged = bool(np.max(np.abs(cur[1])) < tol * n or np.max(np.abs(size * step)) < 1e-9)
            if converged:
                break
    finally:
        rows.unpersist()
    hazard, risk, d, ex = cur[5]
    t = cur[4]
    days = pd.DataFrame({"t": t, "d": d})
    days["resid"] = list(ex - d[:, None] * risk[:, 1:1 + p] / risk[:, :1])
    return Cox(tuple(cols), tuple(means), tuple(stds), beta, cur[2], cur[1], tuple(t),
               tuple(np.cumsum(hazard)), float(cur[3]), it, n, days, converged)


def cox_summary(spark, model: Cox) -> DataFrame:
    """Coefficients per feature unit with hazard ratio, error, test and interval."""
    cov = np.linalg.inv(model.information)
    rows = []
    for i, c in enumerate(model.cols):
        b, se = model.beta[i] / model.stds[i], math.sqrt(cov[i, i]) / model.stds[i]
        z = b / se
        rows.append((c, float(b), float(math.exp(min(b, 700))), float(se), float(z), math.erfc(abs(z) / math.sqrt(2)),
                     float(b - survival.Z95 * se), float(b + survival.Z95 * se)))
    return spark.createDataFrame(rows, "feature string, coef double, hazard_ratio double, se double, z double, "
                                       "p_value double, lower double, upper double")


def linear_predictor(model: Cox) -> Column:
    return sum(((F.col(c) - m) * float(b / s) for c, m, s, b in zip(model.cols, model.means, model.stds, model.beta)),
               F.lit(0.0))


def partial_hazard(df: DataFrame, model: Cox, out: str = "hazard") -> DataFrame:
    """exp of the centred linear predictor."""
    return df.withColumn(out, F.exp(linear_predictor(model)))


def baseline(df: DataFrame, hazard: str = "hazard", duration: str = "duration", event: str = "event_observed") -> DataFrame:
    """Breslow cumulative baseline hazard per distinct day."""
    from pyspark.sql import Window as W
    days = df.groupBy(F.col(duration).alias("t")).agg(
        F.sum(F.col(event).cast("double")).alias("d"), F.sum(hazard).alias("w"))
    risk = F.sum("w").over(W.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, 0))
    steps = days.withColumn("risk", risk).withColumn("h", F.col("d") / F.col("risk"))
    return steps.select("t", F.sum("h").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)).alias("h0"))


def h0_at(model: Cox, t: float, nearest: bool = False) -> float:
    times = np.asarray(model.times)
    if nearest:
        return float(model.h0[int(np.argmin(np.abs(times - t)))])
    k = int(np.searchsorted(times, t, side="right"))
    return float(model.h0[k - 1]) if k else 0.0


def cox_curves(df: DataFrame, model: Cox, times: Sequence[float], nearest: bool = False, prefix: str = "s_") -> DataFrame:
    """S(t | x) columns; the baseline at the requested times is a handful of literals."""
    h = F.exp(linear_predictor(model))
    return df.withColumns({f"{prefix}{t}": F.exp(-h * h0_at(model, t, nearest)) for t in times})


def ph_test(spark, df: DataFrame, model: Cox, duration: str = "duration", event: str = "event_observed") -> DataFrame:
    """Correlation of scaled Schoenfeld residuals with time on the survival scale.

    Residual sums per day come from the last fitting pass; a day's events share its time.
    """
    curve = survival.km(df, duration=duration, event=event).select("t", "s").toPandas().set_index("t")["s"]
    days = model.days[model.days["d"] > 0]
    d = days["d"].to_numpy(dtype=float)
    r = np.stack(days["resid"].to_numpy())
    g = 1.0 - curve.reindex(days["t"].astype(int)).to_numpy()
    centred = g - (d @ g) / d.sum()
    cov = np.linalg.inv(model.information)
    scaled = r @ cov * d.sum()
    spread = float(d @ centred ** 2)
    rows = []
    for i, c in enumerate(model.cols):
        stat = float(centred @ scaled[:, i]) ** 2 / (d.sum() * cov[i, i] * spread)
        p = survival.chi2_sf(stat, 1)
        rows.append((c, float(stat), float(p), int(p < 0.05)))
    return spark.createDataFrame(rows, "feature string, statistic double, p_value double, violated int")


def _soft_step(g: np.ndarray, info: np.ndarray, beta: np.ndarray, alpha: float, l1: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on the quadratic model of the penalised likelihood at ``beta``."""
    b = (beta if start is None else start).copy()
    left = g + info @ (beta - b)
    diagonal = np.diag(info).tolist()
    moved = math.inf
    while moved > 1e-10 * max(1.0, float(np.max(np.abs(b)))):
        moved = 0.0
        for j, h in enumerate(diagonal):
            old = float(b[j])
            rho = float(left[j]) + h * old
            new = math.copysign(max(abs(rho) - alpha * l1, 0.0), rho) / (h + alpha * (1 - l1) + 1e-12)
            if new != old:
                left -= info[:, j] * (new - old)
                b[j] = new
                moved = max(moved, abs(new - old))
    return b


@dataclass(frozen=True)
class CoxnetFit:
    model: Cox
    alpha: float
    path: list[tuple[float, float, int]]
    passes: int = 0
    converged: bool = True


def _violation(grad: np.ndarray, beta: np.ndarray, alpha: float, l1: float) -> float:
    """How far the elastic net's optimality conditions are from holding, largest coefficient."""
    slope = grad - alpha * (1 - l1) * beta
    return float(np.max(np.where(beta != 0, np.abs(slope - alpha * l1 * np.sign(beta)), np.maximum(np.abs(slope) - alpha * l1, 0))))


def coxnet_path(rows: DataFrame, sizes: dict[int, int], p: int, l1: float, n_alphas: int, min_ratio: float, tol: float,
                max_passes: int = 60) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray], int, bool]:
    """Coefficients of every fold (-1: all rows) and penalty.

    Models start from the path of the quadratic model at zero, and all that are not done take a proximal Newton
    step in one job. A step that does not lower a model's penalised loss is halved. A model is done
    when its optimality conditions hold to ``tol`` times the largest penalty.
    """
    folds = list(sizes)
    start = _states(rows, {k: (k, np.zeros(p)) for k in folds}, p)
    top = max(np.max(np.abs(start[-1][1])) / sizes[-1] / l1, 1e-12)
    alphas = top * np.geomspace(1.0, min_ratio, n_alphas)

    def loss(state, beta, k, alpha):
        return -state[0] / sizes[k] + alpha * (l1 * np.abs(beta).sum() + (1 - l1) / 2 * beta @ beta)

    keys = [(k, a) for k in folds for a in range(n_alphas)]
    accepted, trial = {}, {}
    for k in folds:
        beta = np.zeros(p)
        for a in range(n_alphas):
            accepted[k, a] = (np.zeros(p), start[k], loss(start[k], np.zeros(p), k, alphas[a]))
            beta = trial[k, a] = _soft_step(start[k][1] / sizes[k], start[k][2] / sizes[k], np.zeros(p), alphas[a], l1, beta)
    passes = 1
    while trial and passes < max_passes:
        tried = {keys.index(key): (key[0], beta) for key, beta in trial.items()}
        states = _states(rows, tried, p)
        passes += 1
        for i, (k, beta) in tried.items():
            key, alpha = keys[i], alphas[keys[i][1]]
            old, _, old_loss = accepted[key]
            new_loss = loss(states[i], beta, k, alpha)
            if not new_loss <= old_loss + 1e-12 * abs(old_loss):
                trial[key] = (beta + old) / 2
                if np.max(np.abs(beta - old)) > 1e-12:
                    continue
                del trial[key]
                continue
            accepted[key] = (beta, states[i], new_loss)
            grad, info = states[i][1] / sizes[k], states[i][2] / sizes[k]
            if _violation(grad, beta, alpha, l1) <= tol * top:
                del trial[key]
            else:
                trial[key] = _soft_step(grad, info, beta, alpha, l1, beta)
    return alphas, {key: accepted[key][0] for key in keys}, passes, not trial


def fit_coxnet(df: DataFrame, cols: Sequence[str], l1_ratio: float = 0.9, folds: int = 5, n_alphas: int = 20,
               min_ratio: float = 0.01, tol: float = 1e-6, key: str = KEY, duration: str = "duration",
               event: str = "event_observed", seed: int = 42) -> CoxnetFit:
    """Elastic-net path, with the penalty chosen by held-out concordance.

    The whole path of the full fit and of every fold is found in as many jobs as the slowest model needs steps.
    """
    p = len(cols)
    means, stds = scaling(df, cols)
    assigned = df.join(ordered.folds(df, key, folds, "shuffled", seed).withColumnRenamed("fold", "_fold"), key)
    rows = _scaled(assigned, cols, means, stds, duration, event, F.col("_fold")).persist()
    try:
        held = {r.fold: r.n for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        total = sum(held.values())
        sizes = {-1: total} | {k: total - held.get(k, 0) for k in range(1, folds + 1)}
        alphas, betas, passes, converged = coxnet_path(rows, sizes, p, l1_ratio, n_alphas, min_ratio, tol)
        # held-out risk for every penalty, scored together
        x = [F.col(f"z{i}") for i in range(p)]

        def risk(k: int) -> Column:
            return F.array(*[F.struct(F.lit(a).alias("a"), sum((c * float(b) for c, b in zip(x, betas[k, a]) if b), F.lit(0.0)).alias("risk"))
                             for a in range(n_alphas)])

        own = risk(1)
        for k in range(2, folds + 1):
            own = F.when(F.col("fold") == k, risk(k)).otherwise(own)
        scored = rows.select(F.col("t").alias(duration), F.col("e").cast("int").alias(event), "fold", F.explode(own).alias("s")).select(
            duration, event, "fold", "s.a", "s.risk")
        got = metrics.cindex(scored, "risk", duration, event, by=["a", "fold"]).groupBy("a").agg(
            F.avg("c_index").alias("c")).collect()
        score = {r.a: r.c or 0.0 for r in got}
        best = max(range(n_alphas), key=lambda a: (round(score.get(a, 0.0), 10), alphas[a]))
        beta = betas[-1, best]
        t, v, logs = _day_sums(rows, {-1: beta}, p)[-1]
        ll, g, info, hazard, risk_sums, d, ex = _likelihood(t, v, logs, beta, p)
    finally:
        rows.unpersist()
    model = Cox(tuple(cols), tuple(means), tuple(stds), beta, info, g, tuple(t), tuple(np.cumsum(hazard)), float(ll),
                passes, total, converged=converged)
    table = [(float(alphas[a]), float(score.get(a, float("nan"))), int(np.count_nonzero(betas[-1, a]))) for a in range(n_alphas)]
    return CoxnetFit(model, float(alphas[best]), table, passes, converged)
