"""Normal-error accelerated failure time: the fit against a long-hand likelihood."""

import math

import numpy as np
import pytest

from tenure.operators import aft


def cohort(n, seed, far=0.0):
    """Rows with a third censored; ``far`` pushes some censored rows deep into the tail."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [2.0, 0.5] + [1.0, -3.0]
    y = 4.0 + 0.3 * x[:, 0] - 0.8 * x[:, 1] + 0.6 * rng.normal(size=n)
    c = 4.0 + 0.3 * x[:, 0] - 0.8 * x[:, 1] + 0.6 * rng.normal(0.4, 1.2, n) + far * (rng.random(n) < 0.02)
    t, e = np.exp(np.minimum(y, c)), (y <= c).astype(int)
    return [(i, float(d), int(s), float(a), float(b)) for i, (d, s, a, b) in enumerate(zip(t, e, x[:, 0], x[:, 1]))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "customer_id int, duration double, event_observed int, x1 double, x2 double")


def loglik(rows, intercept, b1, b2, sigma):
    """Term by term; the tail from its integral representation by erfc, in the range where that holds."""
    out = 0.0
    for _, t, e, x1, x2 in rows:
        z = (math.log(t) - intercept - b1 * x1 - b2 * x2) / sigma
        out += -0.5 * z * z - 0.5 * math.log(2 * math.pi) - math.log(sigma) - math.log(t) if e else math.log(0.5 * math.erfc(z / math.sqrt(2)))
    return out


def natural(fit):
    slopes = fit.beta[1:] / np.array(fit.stds)
    return [fit.beta[0] - slopes @ np.array(fit.means), *slopes, fit.sigma]


@pytest.mark.parametrize("far", [0.0, 8.0])
def test_the_fit_is_the_maximum_of_the_likelihood(spark, far):
    rows = cohort(1500, 1, far)
    fit = aft.fit_aft(frame(spark, rows).repartition(7), ["x1", "x2"])
    at = natural(fit)
    assert fit.converged and fit.events == sum(r[2] for r in rows) and 0 < fit.events < len(rows)
    assert fit.loglik == pytest.approx(loglik(rows, *at), rel=1e-10)
    for k in range(4):  # the score equations, by differences of the long-hand likelihood
        up, down = list(at), list(at)
        up[k] += 1e-5
        down[k] -= 1e-5
        assert (loglik(rows, *up) - loglik(rows, *down)) / 2e-5 == pytest.approx(0, abs=2e-3)
        assert loglik(rows, *up) < fit.loglik + 1e-9 and loglik(rows, *down) < fit.loglik + 1e-9
    if not far:
        assert at[1:] == pytest.approx([0.3, -0.8, 0.6], abs=0.08)


def test_information_is_the_slope_of_the_gradient(spark):
    rows = aft.scaled_rows(frame(spark, cohort(300, 2)), ["x1", "x2"], [0, 0], [1, 1], "duration", "event_observed").cache()
    gamma, theta = np.array([5.0, 0.4, -1.0]), 1.3
    _, _, info = aft._state(rows, gamma, theta)
    for k in range(4):
        d = np.eye(4)[k] * 1e-5
        up, down = (aft._state(rows, gamma + s * d[:3], theta + s * d[3])[1] for s in (1, -1))
        assert -(up - down) / 2e-5 == pytest.approx(info[k], rel=1e-5, abs=1e-4)


def test_tails_neither_underflow_nor_cancel():
    z = np.array([-40.0, -3.0, 0.0, 1.999, 2.001, 5.0, 37.0, 100.0, 1e4, 1e8])
    log_q, h, over = aft.normal_tail(z)
    assert log_q[:6] == pytest.approx([math.log(0.5 * math.erfc(x / math.sqrt(2))) for x in z[:6]], rel=1e-12, abs=1e-300)
    assert np.isfinite(log_q).all() and (h > 0).all() or h[0] == 0
    # asymptotics: h ~ z + 1/z - 2/z^3, log Q ~ -z^2/2 - log(z sqrt(2 pi))
    assert over[6:] == pytest.approx(1 / z[6:] - 2 / z[6:] ** 3, rel=1e-5)
    assert log_q[6:] == pytest.approx(-z[6:] ** 2 / 2 - np.log(z[6:] * math.sqrt(2 * math.pi)), rel=1e-5)
    assert (np.diff(h[1:]) > 0).all()


def test_flat_directions_and_partitions(spark):
    rows = [(*r, 1.0, r[3]) for r in cohort(400, 3)]
    df = spark.createDataFrame(rows, "customer_id int, duration double, event_observed int, x1 double, x2 double, one double, copy double")
    a = aft.fit_aft(df.repartition(1), ["x1", "x2", "one", "copy"])
    b = aft.fit_aft(df.repartition(11), ["x1", "x2"])
    assert a.converged and a.loglik == pytest.approx(b.loglik, rel=1e-10) and a.sigma == pytest.approx(b.sigma, rel=1e-6)
    mu = {r.customer_id: r.mu for r in aft.aft_scores(df, a).collect()}
    assert all(mu[r.customer_id] == pytest.approx(r.mu, abs=1e-6) for r in aft.aft_scores(df, b).collect())


def test_curves_are_those_of_the_fitted_normal(spark):
    df = frame(spark, cohort(500, 4))
    fit = aft.fit_aft(df, ["x1", "x2"])
    for r in aft.aft_curves(aft.aft_scores(df, fit), fit, [5, 60, 900]).limit(40).collect():
        for t in (5, 60, 900):
            want = 0.5 * math.erfc((math.log(t) - r.mu) / fit.sigma / math.sqrt(2))
            assert r[f"s_{t}"] == pytest.approx(want, abs=1e-6) and r.risk == -r.mu


def test_without_events_there_is_no_fit(spark):
    with pytest.raises(ValueError, match="no event"):
        aft.fit_aft(frame(spark, [(i, 5.0 + i, 0, float(i), 0.0) for i in range(9)]), ["x1", "x2"])
