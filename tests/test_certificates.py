"""Certificates hold at the fit and fail beside it."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import btyd, certificates, cox, models, segment
from tenure.plans import base
from tenure import session


def flags(df):
    return [tuple(r)[2:] for r in df.collect()]


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1500):
        lam, p = rng.gamma(0.8) / 30.0, rng.beta(0.9, 2.5)
        T, t, x, last = float(rng.integers(100, 400)), 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / lam)
            if t > T:
                break
            x, last = x + 1, t
            if rng.random() < p:
                break
        m = rng.gamma(6.0 * max(x, 1)) / max(x, 1) * 15.0 / rng.gamma(4.0) if x else 0.0
        rows.append((i, float(x), float(last), T, float(m)))
    return spark.createDataFrame(rows, "customer_id int, frequency double, recency double, T double, monetary_value double").cache()


@pytest.mark.parametrize("how", [{"penalty": 0.001}, {"prior_sigma": 10.0}])
def test_purchase_model(customers, how):
    m = btyd.fit_bgnbd(customers, **how)
    assert flags(certificates.bgnbd(customers, m, **how)) == [(1, 1)] * 4
    for name in ("r", "alpha", "a", "b"):
        off = dataclasses.replace(m, **{name: getattr(m, name) * 1.3})
        got = {r.parameter: (r.stationary, r.largest) for r in certificates.bgnbd(customers, off, **how).collect()}
        assert got[name] != (1, 1)


def test_spend_model(customers):
    g = btyd.fit_gamma_gamma(customers, penalty=0.001)
    assert flags(certificates.gamma_gamma(customers, g, 0.001)) == [(1, 1)] * 3
    assert flags(certificates.gamma_gamma(customers, dataclasses.replace(g, q=g.q * 1.3), 0.001)) != [(1, 1)] * 3


def test_cox(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 2))
    t = np.ceil(rng.exponential(30 / np.exp(0.6 * x[:, 0] - 0.3 * x[:, 1]))).clip(1, 60).astype(int)
    rows = [(i, int(d), int(d < 60), float(a), float(b)) for i, (d, a, b) in enumerate(zip(t, x[:, 0], x[:, 1]))]
    df = spark.createDataFrame(rows, "customer_id int, duration int, event_observed int, x1 double, x2 double").cache()
    m = cox.fit_cox(df, ["x1", "x2"], penalty=0.01)
    assert flags(certificates.cox_score(df, m, 0.01)) == [(1,), (1,)]
    off = dataclasses.replace(m, beta=m.beta + np.array([0.05, 0.0]))
    assert flags(certificates.cox_score(df, off, 0.01))[0] == (0,)


def test_coxnet_path_meets_its_optimality_conditions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4))
    t = np.ceil(rng.exponential(30 / np.exp(0.8 * x[:, 0]))).clip(1, 50).astype(int)
    rows = [(i, float(d), float(d < 50), i % 3 + 1, *map(float, v)) for i, (d, v) in enumerate(zip(t, x))]
    df = spark.createDataFrame(rows, "id int, t double, e double, fold int, z0 double, z1 double, z2 double, z3 double").cache()
    sizes = {-1: 500} | {k: 500 - sum(r[3] == k for r in rows) for k in (1, 2, 3)}
    alphas, betas, passes, done = cox.coxnet_path(df, sizes, 4, 0.9, 8, 0.01, 1e-6)
    assert done and passes < 15
    for (k, a), beta in betas.items():
        ll, grad, _ = cox._states(df, {0: (k, beta)}, 4)[0]
        assert cox._violation(grad / sizes[k], beta, alphas[a], 0.9) <= 1.01e-6 * alphas[0]
    assert not betas[-1, 0].any() and betas[-1, 7][0] > 0.4
    # a model that leaves a fold out is the fit of the other rows
    alone = df.where("fold <> 2").withColumn("fold", F.lit(-1))
    want = cox._states(alone, {0: (-1, betas[2, 5])}, 4)[0]
    got = cox._states(df.repartition(5), {0: (2, betas[2, 5]), 1: (-1, betas[-1, 3])}, 4)[0]
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1], abs=1e-8) and got[2] == pytest.approx(want[2], abs=1e-8)


def test_components_and_clusters(customers):
    cols = ["frequency", "recency", "monetary_value", "T"]
    _, load, shares = segment.pca(customers, cols)
    assert flags(certificates.components(customers, cols, load, shares)) == [(1, 1)] * 3
    assert flags(certificates.components(customers, cols, load[:, ::-1], shares)) != [(1, 1)] * 3
    found = segment.segment_repeat(customers, cols, restarts=2).cache()
    assert certificates.clusters(found, ["pc1", "pc2", "pc3"]).first().nearest == 1
    moved = found.withColumn("cluster", F.when(F.col("customer_id") % 7 == 0, (F.col("cluster") + 1) % 3).otherwise(F.col("cluster")))
    assert certificates.clusters(moved, ["pc1", "pc2", "pc3"]).first().nearest == 0


def test_logistic(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, int(v), float(a), float(b)) for i, (v, a, b) in enumerate(zip(y, x[:, 0], x[:, 1]))], "customer_id int, label int, a double, b double")
    m = models.logistic(df, ["a", "b"])
    assert flags(certificates.logistic_score(df, ["a", "b"], m)) == [(1,)] * 3
    assert flags(certificates.logistic_score(df, ["b", "a"], m)) != [(1,)] * 3


def test_the_log_is_written_once_for_a_session(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    base._LINES.clear()
    writes = []
    real = session.written_path
    monkeypatch.setattr(base, "written_path", lambda df: writes.append(1) or real(df))
    first = base.lines(spark, sf)
    second = base.lines(spark, sf)
    assert len(writes) == 1 and first.count() == second.count() > 0
    # two readers are two frames, so they can be joined
    assert first.select("customer_id").distinct().join(second.select("customer_id").distinct(), "customer_id").count() > 0
    base.lines(spark, "/root/testdata/sf0.01")
    assert len(writes) == 2
