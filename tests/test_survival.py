import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import survmodels, cox, metrics, scorecard, survival


def frame(spark, rows):
    return spark.createDataFrame(rows, "duration int, event_observed int, risk double")


def test_km_textbook(spark):
    df = frame(spark, [(1, 1, 0.0), (2, 1, 0.0), (2, 0, 0.0), (3, 1, 0.0), (4, 0, 0.0)])
    got = [r.s for r in survival.km(df).orderBy("t").collect()]
    assert got == pytest.approx([0.8, 0.6, 0.3, 0.3])


def test_km_median_fallbacks(spark):
    df = frame(spark, [(1, 0, 0.0), (2, 0, 0.0)])
    curve = survival.km(df)
    assert survival.median(curve).first()[0] == math.inf
    assert survival.median(curve, fallback=730).first()[0] == 730


def test_logrank_of_identical_groups(spark):
    df = spark.createDataFrame([(t, e, g) for g in "ab" for t, e in ((1, 1), (2, 0), (3, 1))], "duration int, event_observed int, g string")
    row = survival.logrank(df, "g").first()
    assert row.statistic == pytest.approx(0) and row.p_value == pytest.approx(1)


def test_chi2_tail():
    assert survival.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert survival.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05)
    assert survival.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05)
    assert survival.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05)


@pytest.mark.parametrize("risks,want", [((4, 3, 2, 1), 1.0), ((1, 2, 3, 4), 0.0), ((1, 1, 1, 1), 0.5)])
def test_concordance_extremes(spark, risks, want):
    df = frame(spark, [(i + 1, 1, float(r)) for i, r in enumerate(risks)])
    assert metrics.cindex(df).first().c_index == pytest.approx(want)


@pytest.mark.parametrize("block", [200_000, 40])
def test_concordance_matches_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(metrics, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    rows = [(int(t), int(e), float(r)) for t, e, r in zip(rng.integers(1, 30, 300), rng.integers(0, 2, 300), rng.integers(0, 40, 300))]
    # a third of the rows share one risk
    rows = [(t, e, 5.0 if i % 3 == 0 else r) for i, (t, e, r) in enumerate(rows)]
    conc = tied = total = 0
    for ti, ei, ri in rows:
        if not ei:
            continue
        for tj, ej, rj in rows:
            if tj > ti or (tj == ti and not ej):
                total += 1
                conc += ri > rj
                tied += ri == rj
    got = metrics.cindex(frame(spark, rows)).first()
    assert (got.concordant, got.tied, got.comparable) == (conc, tied, total)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(7)
    n = 1500
    x = rng.normal(size=(n, 2))
    t = rng.exponential(60 * np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1])))
    c = rng.uniform(20, 200, n)
    rows = [(i, int(math.ceil(min(a, b))), int(a <= b), float(p), float(q)) for i, (a, b, (p, q)) in enumerate(zip(t, c, x))]
    return spark.createDataFrame(rows, "customer_id int, duration int, event_observed int, x1 double, x2 double").cache()


def efron(x, t, e, beta):
    """Log-likelihood, gradient and information, row by row."""
    w = np.exp(x @ beta)
    ll, g, info = 0.0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
    for day in np.unique(t[e == 1]):
        risk, dead = t >= day, (t == day) & (e == 1)
        d = dead.sum()
        ll += (x[dead] @ beta).sum()
        g += x[dead].sum(0)
        for c in range(d):
            v = w * risk - c / d * w * dead
            s0, s1 = v.sum(), v @ x
            ll -= math.log(s0)
            g -= s1 / s0
            info += (x.T * v) @ x / s0 - np.outer(s1, s1) / s0**2
    return ll, g, info


def test_cox_equals_a_written_out_fit(cohort, spark):
    m = cox.fit_cox(cohort, ["x1", "x2"])
    rows = cohort.toPandas()
    x, t, e = rows[["x1", "x2"]].to_numpy(), rows["duration"].to_numpy(), rows["event_observed"].to_numpy()
    beta = np.zeros(2)
    for _ in range(20):
        ll, g, info = efron(x, t, e, beta)
        beta = beta + np.linalg.solve(info, g)
    assert m.converged and m.beta / np.array(m.stds) == pytest.approx(beta, abs=1e-6)
    table = {r.feature: r for r in cox.cox_summary(spark, m).collect()}
    assert [table[c].se for c in ("x1", "x2")] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))), rel=1e-5)
    centred = efron(x - x.mean(0), t, e, beta)[0]
    assert m.loglik == pytest.approx(centred, rel=1e-9)


def test_cox_takes_any_spread_of_risks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(d), 1, float(1000 * z)) for i, (d, z) in enumerate(zip(rng.integers(1, 60, 200), rng.normal(size=200)))]
    df = spark.createDataFrame(rows, "customer_id int, t double, e double, z0 double".replace("t double", "t int").replace("e double", "e int"))
    df = df.selectExpr("cast(t AS double) AS t", "cast(e AS double) AS e", "-1 AS fold", "z0")
    x, t, e = np.array([[r[3]] for r in rows]), np.array([r[1] for r in rows]), np.ones(200)
    beta = np.array([0.11])  # scores up to about 300: far beyond a clamp at 50
    got = cox._likelihood(*cox._day_sums(df, {-1: beta}, 1)[-1], beta, 1)
    want = efron(x, t, e, beta)
    assert got[0] == pytest.approx(want[0], rel=1e-9)
    assert got[1] == pytest.approx(want[1], rel=1e-6)


@pytest.mark.parametrize("d,s0,e0", [(1, 5.0, 2.0), (16, 20.0, 20.0), (17, 30.0, 11.0), (2000, 9e4, 2e3), (100_000, 1e5, 1e5), (100_000, 1e9, 7.0)])
def test_tie_sums_equal_the_written_out_sums(d, s0, e0):
    c = np.arange(d) / d
    den = s0 - c * e0
    want = [np.log(den).sum(), (1 / den).sum(), (c / den).sum(), (1 / den**2).sum(), (c / den**2).sum(), (c * c / den**2).sum()]
    got = cox._tie_sums(s0, e0, d)
    # what enters the likelihood is each sum times its powers of s0 and e0; d is the scale
    scale = [1, s0, e0, s0**2, s0 * e0, e0**2]
    for g, w, k in zip(got, want, scale):
        assert abs(g - w) * k <= 1e-10 * max(abs(w) * k, d)


def test_efron_gradient_vanishes_with_ties(spark):
    rows = [(1, 1, 1, 1.0), (2, 1, 1, 0.0), (3, 1, 1, 0.0), (4, 2, 1, 1.0), (5, 2, 1, 0.0), (6, 3, 0, 1.0)]
    df = spark.createDataFrame(rows, "customer_id int, duration int, event_observed int, x double")
    m = cox.fit_cox(df, ["x"])
    assert abs(m.gradient[0]) < 1e-5


def test_tie_sums_agree_beyond_the_written_out_range():
    exact = []
    d, s0, e0 = 5000, 9000.0, 5000.0
    c = np.arange(d) / d
    den = s0 - c * e0
    exact = [np.log(den).sum(), (1 / den).sum(), (c / den).sum(), (1 / den**2).sum(), (c / den**2).sum(), (c * c / den**2).sum()]
    assert cox._tie_sums(s0, e0, d) == pytest.approx(exact, rel=1e-7)


def test_partition_invariant_cox(cohort):
    a = cox.fit_cox(cohort.repartition(1), ["x1", "x2"], penalty=0.01)
    b = cox.fit_cox(cohort.repartition(9), ["x1", "x2"], penalty=0.01)
    assert a.beta == pytest.approx(b.beta, abs=1e-8)


def test_coxnet_drops_noise(cohort):
    noisy = cohort.withColumn("z", F.rand(3))
    fit = cox.fit_coxnet(noisy, ["x1", "x2", "z"], folds=2, n_alphas=4)
    assert fit.path[0][2] <= 1 and fit.model.beta[0] > 0.3 and abs(fit.model.beta[2]) < 0.1


def test_ph_test_holds_for_proportional_data(cohort, spark):
    got = cox.ph_test(spark, cohort, cox.fit_cox(cohort, ["x1", "x2"])).collect()
    assert all(r.p_value > 0.001 for r in got)


def test_scorecard_medians_are_first_crossings(cohort):
    m = cox.fit_cox(cohort, ["x1", "x2"])
    got = scorecard.median_lifetime(cohort, m).toPandas()
    eta = sum((got[c] - mu) * b / s for c, mu, s, b in zip(m.cols, m.means, m.stds, m.beta))
    h0, t = np.array(m.h0), np.array(m.times)
    for e, days, method in list(zip(eta, got.predicted_median_lifetime_days, got.median_method))[:200]:
        below = np.flatnonzero(np.exp(-h0 * np.exp(e)) <= 0.5)
        assert (method == "cox_observed") == (len(below) > 0)
        if len(below):
            assert days == t[below[0]]


def test_risk_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.7,), (0.71,)], "s double")
    got = [r.l for r in df.select(scorecard.risk_label("s", F.lit(False)).alias("l")).collect()]
    assert got == ["High Risk", "Medium Risk", "Low Risk"]


def test_brier_of_a_perfect_forecast_is_zero(spark):
    df = frame(spark, [(10, 1, 0.0), (20, 1, 0.0), (40, 1, 0.0)]).withColumn("s_15", (F.col("duration") > 15).cast("double"))
    assert metrics.brier(df, df, [15]).first().brier == pytest.approx(0)


def test_forest_curve_does_not_anticipate_a_period(spark):
    rows = [(i, 100 if i < 400 else 200, int(i < 400), 0.0) for i in range(410)]
    df = spark.createDataFrame(rows, "customer_id int, duration int, event_observed int, x double")
    fit = survmodels.fit_forest(df, ["x"], trees=5, depth=3, width=90)
    row = survmodels.forest_curves(df.limit(1), fit, [0, 89, 90, 134, 179]).first()
    assert row.s_0 == row.s_89 == pytest.approx(1.0)
    assert 0.95 < row.s_90 < 1 and row.s_90 > row.s_134 > row.s_179 and row.s_179 < 0.06
    assert row.s_134 == pytest.approx(math.sqrt(row.s_179), rel=1e-6)


def test_aft_curves_are_those_of_the_fitted_family(spark):
    rng = np.random.default_rng(5)
    t = 150 * rng.weibull(1.4, 4000)
    c = rng.uniform(50, 500, 4000)
    rows = [(i, float(min(a, b)), int(a <= b), 0.0) for i, (a, b) in enumerate(zip(t, c))]
    df = spark.createDataFrame(rows, "customer_id int, duration double, event_observed int, x double")
    fit = survmodels.fit_aft(df, ["x"])
    got = survmodels.weibull_curves(survmodels.aft_scores(df.limit(1), fit, ["x"]), fit.scale, [60, 90, 180, 360]).first()
    for day in (60, 90, 180, 360):
        assert got[f"s_{day}"] == pytest.approx(math.exp(-((day / 150) ** 1.4)), abs=0.02)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_forest_curves_fold_without_a_shuffle(spark, batch):
    rng = np.random.default_rng(12)
    rows = [(i, int(t), int(rng.random() < 0.7), float(rng.random()), f"n{i}") for i, t in enumerate(rng.integers(0, 400, 230))]
    df = spark.createDataFrame(rows, "customer_id int, duration int, event_observed int, x double, kept string")
    fit = survmodels.fit_forest(df, ["x"], trees=4, depth=3, width=60)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = survmodels.forest_curves(df.coalesce(2), fit, [0, 100, 359])
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.customer_id: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 230 and out.columns == [*df.columns, "risk", "s_0", "s_100", "s_359"]
    # by the plain grouping
    grid = df.select("customer_id", "x").withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(fit.periods - 1))))
    from pyspark.ml.functions import vector_to_array
    scored = fit.model.transform(survmodels._assemble(grid, ["x", "period"])).select(
        "customer_id", "period", F.log1p(-F.least(vector_to_array("_prob")[1], F.lit(1 - 1e-9))).alias("l")).toPandas()
    for key, part in scored.groupby("customer_id"):
        logs = part.sort_values("period")["l"].to_numpy()
        r = got[key]
        assert r.kept == f"n{key}" and r.risk == pytest.approx(-(logs * (fit.periods - np.arange(fit.periods))).sum())
        for t, have in ((0, r.s_0), (100, r.s_100), (359, r.s_359)):
            assert have == pytest.approx(math.exp(sum(l * min(1, max(0, (t + 1 - 60 * k) / 60)) for k, l in enumerate(logs))))


def test_boosting_follows_its_gradient(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=300)
    t = np.ceil(rng.exponential(40 / np.exp(1.2 * x))).clip(1, 200).astype(int)
    df = spark.createDataFrame([(i, int(a), int(a < 200), float(b)) for i, (a, b) in enumerate(zip(t, x))], "customer_id int, duration int, event_observed int, x double").cache()
    few = survmodels.fit_boosted_cox(df, ["x"], rounds=2, dropout=0.0)
    more = survmodels.fit_boosted_cox(df, ["x"], rounds=12, dropout=0.2, cut=5)
    assert len(more.trees) == 12 and len(more.weights) == 12
    c = [metrics.cindex(survmodels.boosted_scores(df, m)).first().c_index for m in (few, more)]
    assert c[1] > 0.7 and c[1] >= c[0] - 0.02
    assert more.times == sorted(more.times) and (np.diff(more.h0) >= 0).all()
    # nothing of the fit stays persisted but the input
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= 1


def test_importance_places_its_rows_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, 1 + i % 50, i % 2, float(i % 7), float(i % 3)) for i in range(120)],
                               "customer_id long, duration int, event_observed int, a double, b double").cache()
    placed, real = [], survmodels.ordered.row_index
    monkeypatch.setattr(survmodels.ordered, "row_index", lambda d, key, *by: placed.append(key) or real(d, key, *by))
    out = survmodels.permutation_importance(df, ["a", "b"], lambda d: d.withColumn("risk", F.col("a") - F.col("b")), repeats=3).collect()
    df.unpersist()
    assert sorted(r.feature for r in out) == ["a", "b"]
    assert placed.count("customer_id") == 1 and placed.count("_h") == 3


def test_fits_read_written_rows(spark, monkeypatch):
    from tenure.plans import modeling
    read = []
    monkeypatch.setattr(modeling.btyd, "fit_bgnbd", lambda df, **more: read.append(df) or modeling.btyd.BgNbd(0.7, 240.0, 0.5, 3.4))
    monkeypatch.setattr(modeling.btyd, "fit_gamma_gamma", lambda df, **more: read.append(df) or modeling.btyd.GammaGamma(6.0, 4.0, 90000.0))
    modeling.clv_export(spark, "/root/testdata/sf0.001")
    read += modeling.split_rows(spark, "/root/testdata/sf0.001")
    for df in read:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    assert len(read) == 4


def test_scorecard_computes_its_features_once(spark, monkeypatch):
    from tenure.plans import modeling
    made, real = [], modeling.survival_features
    monkeypatch.setattr(modeling, "survival_features", lambda *a: made.append(a) or real(*a))
    wrote, keep = [], modeling.written
    monkeypatch.setattr(modeling, "written", lambda df: wrote.append(df.columns) or keep(df))
    modeling.scorecard_fitted(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    # spend and gaps read one table of invoices
    assert len(wrote) == 1 and "n_items" in wrote[0]


def test_a_forest_is_fitted_by_many_tasks(spark, monkeypatch):
    """Customers that come as one partition are dealt to the cluster's tasks once they have enough periods."""
    df = spark.range(40).selectExpr("id AS customer_id", "int(30 + 20 * (id % 9)) AS duration", "int(id % 2) AS event_observed", "double(id) AS x").coalesce(1)
    seen, real = [], survmodels.person_periods
    monkeypatch.setattr(survmodels, "person_periods", lambda rows, *a: seen.append(rows) or real(rows, *a))
    few = survmodels.fit_forest(df, ["x"], trees=2, depth=2)
    monkeypatch.setattr(survmodels, "TASK_PERIODS", (10, 1_000_000))
    many = survmodels.fit_forest(df, ["x"], trees=2, depth=2)
    assert [rows.rdd.getNumPartitions() for rows in seen] == [1, spark.sparkContext.defaultParallelism]
    assert seen[1].count() == 40 and few.periods == many.periods
    # parts stay below a bound
    assert survmodels.spread(df, 10_000_001).rdd.getNumPartitions() == 11
