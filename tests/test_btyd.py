import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import btyd

REF = btyd.BgNbd(0.7, 60.0, 0.3, 2.4)


@pytest.fixture(scope="module")
def customers(spark):
    """Purchase histories drawn from known parameters (fixed seed)."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        lam, p = rng.gamma(0.8) / 30.0, rng.beta(0.9, 2.5)
        T, t, x, last = float(rng.integers(100, 400)), 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / lam)
            if t > T:
                break
            x, last = x + 1, t
            if rng.random() < p:
                break
        nu = 15.0 / rng.gamma(4.0)  # mean spend per purchase varies by customer
        m = rng.gamma(6.0 * max(x, 1)) / max(x, 1) * nu if x else 0.0
        rows.append((i, float(x), float(last), T, float(m)))
    return spark.createDataFrame(rows, "customer_id int, frequency double, recency double, T double, monetary_value double").cache()


def test_expected_purchases_reference_values(spark):
    df = spark.createDataFrame([(0.0, 0.0, 300.0), (2.0, 100.0, 300.0), (20.0, 690.0, 700.0)], "frequency double, recency double, T double")
    got = [r[0] for r in btyd.expected_purchases(df, REF, 180.0).select("expected_purchases").collect()]
    assert got == pytest.approx([0.3356178522, 0.7168907260, 4.6646173830], abs=1e-9)


def test_p_alive_is_one_without_repeats(spark):
    df = spark.createDataFrame([(0.0, 0.0, 300.0), (5.0, 10.0, 300.0)], "frequency double, recency double, T double")
    a, b = (r.p_alive for r in btyd.p_alive(df, REF).collect())
    assert a == 1 and 0 < b < 0.5


def test_fit_recovers_parameters_and_is_an_optimum(customers):
    m = btyd.fit_bgnbd(customers)
    assert m.r == pytest.approx(0.8, rel=0.2) and m.alpha == pytest.approx(30, rel=0.25)
    assert m.a / (m.a + m.b) == pytest.approx(0.9 / 3.4, rel=0.25)
    best = btyd.loglik(customers, m).first().loglik
    assert best == pytest.approx(m.loglik, abs=1e-4)
    for k in ("r", "alpha", "a", "b"):
        for f in (0.95, 1.05):
            other = btyd.BgNbd(**{**{c: getattr(m, c) for c in ("r", "alpha", "a", "b")}, k: getattr(m, k) * f})
            assert btyd.loglik(customers, other).first().loglik < best


def test_prior_pulls_and_fit_is_partition_invariant(customers):
    a = btyd.fit_bgnbd(customers.repartition(1), prior_sigma=10.0)
    b = btyd.fit_bgnbd(customers.repartition(8), prior_sigma=10.0)
    assert (a.r, a.alpha, a.a, a.b) == pytest.approx((b.r, b.alpha, b.a, b.b), rel=1e-6)
    assert a.alpha < btyd.fit_bgnbd(customers).alpha


def test_gamma_gamma_recovers_mean_spend(customers):
    g = btyd.fit_gamma_gamma(customers)
    assert g.q == pytest.approx(4.0, rel=0.3)
    assert g.p * g.v / (g.q - 1) == pytest.approx(6.0 * 15.0 / 3.0, rel=0.15)


def test_clv_discounts_monthly_steps(customers):
    g = btyd.GammaGamma(6.0, 4.0, 15.0)
    row = btyd.clv(customers.where("frequency = 3").limit(1), REF, g)
    row = btyd.expected_spend(row, g)
    for k in range(1, 7):
        row = btyd.expected_purchases(row, REF, 30.0 * k, out=f"e{k}")
    r = row.first()
    e = [0.0] + [r[f"e{k}"] for k in range(1, 7)]
    assert r.clv == pytest.approx(sum(r.expected_spend * (e[k] - e[k - 1]) / 1.01 ** k for k in range(1, 7)))


def test_posterior_of_one_draw_has_no_spread(customers):
    d = [dict(draw=0, r=0.7, alpha=60.0, a=0.3, b=2.4, p=6.0, q=4.0, v=15.0)]
    out = btyd.posterior(customers.limit(50), d)
    both = btyd.p_alive(out, REF).agg(F.max(F.abs(F.col("p_alive") - F.col("p_alive_mean"))).alias("d"), F.max("p_alive_std").alias("s")).first()
    assert both.d < 1e-12 and both.s == 0


def test_draws_centre_on_the_mode(customers):
    m = btyd.fit_bgnbd(customers, prior_sigma=10.0)
    d = btyd.draws(m, None, 400)
    assert np.median([x["r"] for x in d]) == pytest.approx(m.r, rel=0.1)
    assert len(btyd.thin(d, 2)) == 200


def test_digamma():
    assert btyd._digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert btyd._digamma(np.array([1.0]), 1)[0] == pytest.approx(math.pi ** 2 / 6, abs=1e-9)


def test_purchase_series_runs_to_convergence():
    m = btyd.BgNbd.__new__(btyd.BgNbd)
    for k, v in dict(r=0.3, alpha=5.0, a=2.5, b=3.4).items():
        object.__setattr__(m, k, v)
    got = btyd._purchases(m, 3650.0, np.array([0.0, 0.0, 2.0]), np.zeros(3), np.array([0.0, 100.0, 30.0]))

    def long_sum(x, tx, T, t=3650.0):
        z = t / (m.alpha + T + t)
        A, B, C = m.a + m.b - 1 - m.r, m.a - 1, m.a + m.b + x - 1
        k = np.arange(200_000)
        terms = np.concatenate([[1.0], np.cumprod((A + k) * (B + k) / ((C + k) * (k + 1)) * z)])
        gone = ((m.alpha + T) / (m.alpha + T + t)) ** B * terms.sum()
        alive = 1.0 if x == 0 else 1 / (1 + m.a / (m.b + x - 1) * ((m.alpha + T) / (m.alpha + tx)) ** (m.r + x))
        return C / B * (1 - gone) * alive

    assert got == pytest.approx([long_sum(0, 0, 0), long_sum(0, 0, 100), long_sum(2, 0, 30)], rel=1e-10)
    assert got[0] == pytest.approx(2.5469, abs=1e-4)


def test_posterior_draws_match_a_grid_posterior(spark, customers):
    """Means and deviations of the log parameters against a grid over the same likelihood and priors."""
    few = customers.where("customer_id < 250").cache()
    m = btyd.fit_bgnbd(few, prior_sigma=10.0)
    got = btyd.posterior_draws(few, m, None, n=4000, proposals=6000)
    logs = np.log([[d[k] for k in ("r", "alpha", "a", "b")] for d in got.rows])

    centre, axes, sd = btyd._proposal((m.r, m.alpha, m.a, m.b), m.hessian)
    steps = np.linspace(-4, 4, 15)
    mesh = np.stack(np.meshgrid(*[steps] * 4, indexing="ij"), -1).reshape(-1, 4)
    phi = centre + (mesh * np.minimum(sd, 2)) @ axes.T
    theta = np.exp(phi)
    pdf = few.toPandas()
    x, tx, T = (pdf[c].to_numpy() for c in ("frequency", "recency", "T"))
    post = sum(btyd._bg_loglik(theta, x[i:i + 25], tx[i:i + 25], T[i:i + 25]).sum(0) for i in range(0, len(x), 25))
    post += -(theta**2).sum(1) / 200 + phi.sum(1)
    w = np.exp(post - post.max())
    w /= w.sum()
    mean = w @ phi
    spread = np.sqrt(w @ (phi - mean) ** 2)
    assert got.ess_purchases > 600
    assert logs.mean(0) == pytest.approx(mean, abs=0.15 * spread.max())
    assert logs.std(0) == pytest.approx(spread, rel=0.2)


def test_likelihood_of_draws_is_that_of_the_column(spark, customers):
    m = btyd.BgNbd(0.8, 40.0, 0.7, 2.0)
    cells = customers.groupBy("frequency", "recency", "T").agg(F.count("*").alias("n"))
    got = btyd.draw_logliks(cells, np.array([[0.8, 40.0, 0.7, 2.0], [1.1, 30.0, 0.5, 3.0]]), btyd._bg_loglik, ("frequency", "recency", "T"))
    want = [btyd.loglik(customers, btyd.BgNbd(*v)).first().loglik for v in ((0.8, 40.0, 0.7, 2.0), (1.1, 30.0, 0.5, 3.0))]
    assert got == pytest.approx(want, rel=1e-9) and m.r == 0.8
    g = btyd.fit_gamma_gamma(customers, scale_spend=False)
    spend = customers.where("frequency > 0 AND monetary_value > 0").select("frequency", "monetary_value", F.lit(1).alias("n"))
    at = btyd.draw_logliks(spend, np.array([[g.p, g.q, g.v]]), btyd._gg_loglik, ("frequency", "monetary_value"))
    assert at[0] == pytest.approx(g.loglik, rel=1e-8)


def test_a_flat_direction_has_a_low_effective_size(spark):
    """Customers who bought once say nothing about dropping out; a wide prior leaves that direction open."""
    once = spark.createDataFrame([(i, 0.0, 0.0, float(50 + i % 300), 0.0) for i in range(400)],
                                 "customer_id int, frequency double, recency double, T double, monetary_value double")
    m = btyd.BgNbd(0.1, 50.0, 1.0, 1.0, hessian=((-40.0, 20.0, 0, 0), (20.0, -15.0, 0, 0), (0, 0, 0.0, 0), (0, 0, 0, 0.0)))
    got = btyd.posterior_draws(once, m, None, proposals=2000, prior_sigma=1e6)
    assert len(got.rows) == 500 and got.ess_purchases < 200


def test_grid_is_dealt_to_tasks(spark, customers):
    out = btyd.score_grid(customers, btyd.BgNbd(0.8, 40.0, 0.7, 2.0))
    span = customers.agg(F.max("frequency"), F.max("recency").cast("int")).first()
    assert out.count() == (span[0] + 1) * (span[1] + 1) and out.rdd.getNumPartitions() > 1
    assert btyd.score_grid(customers.limit(0), btyd.BgNbd(0.8, 40.0, 0.7, 2.0)).count() == 0


def test_lgamma():
    x = np.array([1e-3, 0.5, 1.0, 2.0, 7.3, 11.99, 12.0, 300.0, 1e6])
    assert btyd._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_series_ends_for_all_times_at_once():
    x, tx, T = np.array([0.0, 2.0, 40.0, np.nan]), np.array([0.0, 30.0, 300.0, 5.0]), np.array([10.0, 100.0, 700.0, 50.0])
    times = np.array([30.0, 180.0, 3650.0])[:, None]
    got = btyd._purchases(REF, times, x, tx, T)
    each = np.array([btyd._purchases(REF, float(t), x, tx, T) for t in times[:, 0]])
    # an unknown history has no value, and ends
    assert np.isnan(got[:, 3]).all() and np.allclose(got[:, :3], each[:, :3], rtol=1e-12, atol=0)
    assert btyd._purchases(REF, times, *np.zeros((3, 0))).shape == (3, 0)


def test_posterior_is_that_of_scores_under_each_draw(spark, customers):
    rows = customers.limit(40).unionByName(customers.limit(40))
    d = [dict(draw=i, r=0.6 + 0.1 * i, alpha=200.0 + 9 * i, a=0.5, b=3.0, p=5.0 + i, q=3.5, v=800.0) for i in range(3)]
    got = btyd.posterior(rows, d, t=75.0, months=2).orderBy("customer_id").toPandas()
    plain = rows.orderBy("customer_id")
    for k in d:
        m, g = btyd.BgNbd(k["r"], k["alpha"], k["a"], k["b"]), btyd.GammaGamma(k["p"], k["q"], k["v"])
        plain = btyd.clv(btyd.expected_purchases(plain, m, 75.0, f"n{k['draw']}"), m, g, 2, out=f"v{k['draw']}")
    plain = plain.toPandas()
    for out, col in (("purchases", "n"), ("clv", "v")):
        want = plain[[f"{col}{i}" for i in range(3)]].to_numpy(float)
        assert np.allclose(got[f"{out}_mean"], want.mean(1), equal_nan=True)
        assert np.allclose(got[f"{out}_std"], want.std(1), equal_nan=True)
    assert got.loc[got.frequency == 0, "clv_mean"].isna().all() and got.loc[got.frequency > 0, "clv_mean"].notna().all()
