"""Fitted survival models, the scorecard and supervised models.

Sizes of iterative models (rounds, trees, folds, penalties) are kept small here; the
operators' defaults are the full settings. Every fit reads all customers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tenure.constants import CHURN_FEATURES, CHURN_WINDOWS, CLV_FEATURES, HORIZONS, SURVIVAL_FEATURES
from tenure.operators import aft, btyd, clean, cox, features, labels, metrics, models, scorecard, survival, survmodels
from tenure.plans.analytics import _step_sql, tiered
from tenure.plans.base import CTES, GROUPS, HOME, PATTERNS, lines, query, rounded
from tenure.plans.relational import conversion_labels, sql_norm_cdf
from tenure.session import checkpointed, written

TIMES = (90, 180, 360, 540)


def survival_features(spark, sf):
    """Behavioural features with duration, event and segment of every customer.

    One row per customer, written once: fits and scorecards read it many times. So are the invoices, which spend and gaps read.
    """
    tx = lines(spark, sf)
    inv = written(features.invoices(tx))
    surv = survival.attach(survival.dataset(tx, features.observation_end(tx)), tiered(spark, sf))
    rows = features.behaviour(inv).drop("first_purchase", "last_purchase").join(surv, "customer_id")
    return clean.finite_cols(checkpointed(rows), SURVIVAL_FEATURES, how="drop")


def repeat_part(rows):
    """Repeat customers' rows with durations of at least a day."""
    cols = ["customer_id", "segment", "duration", "event_observed", *SURVIVAL_FEATURES]
    return survival.clip_duration(rows.where("segment <> 'One-Timer'")).select(*cols)


def repeat_rows(spark, sf):
    return repeat_part(survival_features(spark, sf))


def split_rows(spark, sf):
    """Training and test rows; the split is ranked once, as fits read their part many times."""
    rows = checkpointed(labels.split(repeat_rows(spark, sf), test=0.25, stratify="event_observed"))
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _cox(rows):
    return cox.fit_cox(rows, SURVIVAL_FEATURES, penalty=0.01)


@query("k12_cox_fit")
def cox_fit(spark, sf):
    m = _cox(repeat_rows(spark, sf))
    rows = [(c, float(b), float(g) / m.n, m.loglik, m.iterations) for c, b, g in zip(m.cols, m.beta, m.gradient)]
    return spark.createDataFrame(rows, "feature string, beta_std double, mean_gradient double, loglik double, iterations int")


@query("k13_cox_summary")
def cox_summary(spark, sf):
    return cox.cox_summary(spark, _cox(repeat_rows(spark, sf)))


# A hand-set linear predictor lets SQL state the hazard, baseline and curves.
_BETA = {"num_transactions": -0.3, "avg_gap": -0.002, "last_gap": 0.001}
LITERAL = cox.Cox(tuple(_BETA), (3.0, 200.0, 200.0), (1.0, 1.0, 1.0), np.array(list(_BETA.values())), np.eye(3), np.zeros(3),
                  (0.0, 30.0, 90.0, 180.0, 365.0, 730.0), (0.001, 0.01, 0.05, 0.2, 0.6, 1.1), 0.0, 0, 0)
_HAZ = "exp((num_transactions - 3) * -0.3::DOUBLE + (avg_gap - 200) * -0.002::DOUBLE + (last_gap - 200) * 0.001::DOUBLE)"
CTES["hz"] = f"SELECT behave.*, duration, event_observed, segment, {_HAZ} AS hazard FROM behave JOIN surv_seg USING (customer_id)"


@query("k14_cox_partial_hazard", "SELECT customer_id, round(hazard, 6) AS hazard FROM hz")
def cox_partial_hazard(spark, sf):
    return rounded(cox.partial_hazard(survival_features(spark, sf), LITERAL).select("customer_id", "hazard"))


@query("k15_cox_baseline", """SELECT t, round(sum(d / risk) OVER (ORDER BY t), 6) AS h0 FROM (
  SELECT t, d, sum(w) OVER (ORDER BY t DESC) AS risk FROM (SELECT duration AS t, sum(event_observed) AS d, sum(hazard) AS w FROM hz GROUP BY 1))""")
def cox_baseline(spark, sf):
    return rounded(cox.baseline(cox.partial_hazard(survival_features(spark, sf), LITERAL)))


_H0 = {30: 0.01, 90: 0.05, 180: 0.2, 360: 0.2}
_H0_NEAREST = {30: 0.01, 90: 0.05, 180: 0.2, 360: 0.6}


@query("k16_cox_survival", "SELECT customer_id, " + ", ".join(f"round(exp(-hazard * {h}::DOUBLE), 6) AS s_{t}" for t, h in _H0.items()) + " FROM hz")
def cox_survival(spark, sf):
    out = cox.cox_curves(survival_features(spark, sf), LITERAL, HORIZONS)
    return rounded(out.select("customer_id", *[f"s_{t}" for t in HORIZONS]))


@query("k18_ph_test")
def ph_test(spark, sf):
    rows = repeat_rows(spark, sf)
    return cox.ph_test(spark, rows, _cox(rows))


@query("k19_coxnet_path")
def coxnet_path(spark, sf):
    fit = cox.fit_coxnet(repeat_rows(spark, sf), SURVIVAL_FEATURES)
    rows = [(i, a, c, n, int(a == fit.alpha)) for i, (a, c, n) in enumerate(fit.path)]
    return spark.createDataFrame(rows, "step int, alpha double, c_index double, nonzero int, chosen int")


def _forest(train):
    return survmodels.fit_forest(train, SURVIVAL_FEATURES)


@query("k20_survival_forest")
def survival_forest(spark, sf):
    train, test = split_rows(spark, sf)
    return survmodels.forest_curves(test, _forest(train), TIMES).select("customer_id", "risk", *[f"s_{t}" for t in TIMES])


@query("k20b_forest_grid")
def forest_grid(spark, sf):
    _, table = survmodels.tune_forest(repeat_rows(spark, sf), SURVIVAL_FEATURES, [(3, 3, 10), (3, 5, 10)], folds=2, width=180)
    return spark.createDataFrame(table, "trees int, depth int, leaf int, c_index double")


def _boosted(train):
    return survmodels.fit_boosted_cox(train, SURVIVAL_FEATURES)


@query("k21_boosted_cox")
def boosted_cox(spark, sf):
    train, test = split_rows(spark, sf)
    return survmodels.boosted_curves(test, _boosted(train), TIMES).select("customer_id", "risk", *[f"s_{t}" for t in TIMES])


@query("k22_aft_fit")
def aft_fit(spark, sf):
    train, test = split_rows(spark, sf)
    fit = aft.fit_aft(train, SURVIVAL_FEATURES)
    scored = aft.aft_curves(aft.aft_scores(test, fit), fit, TIMES)
    return scored.select("customer_id", "mu", "risk", *[f"s_{t}" for t in TIMES])


@query("k22b_aft_weibull")
def aft_weibull(spark, sf):
    train, test = split_rows(spark, sf)
    fit = survmodels.fit_aft(train, SURVIVAL_FEATURES)
    scored = survmodels.weibull_curves(survmodels.aft_scores(test, fit, SURVIVAL_FEATURES), fit.scale, TIMES)
    return scored.select("customer_id", "mu", "risk", *[f"s_{t}" for t in TIMES])


CTES["logn"] = """SELECT customer_id, greatest(duration, 1) AS duration, event_observed, 5.0::DOUBLE + 0.2 * num_transactions AS mu FROM behave JOIN surv USING (customer_id)"""
CTES["sig"] = "SELECT stddev_pop(ln(duration) - mu) AS sigma FROM logn WHERE event_observed = 1"


@query("k23_lognormal_survival", "SELECT customer_id, " + ", ".join(
    f"round(greatest(1e-10::DOUBLE, least(1, 1 - ({sql_norm_cdf(f'((ln({t}::DOUBLE) - mu) / sigma)')}))), 6) AS s_{t}" for t in TIMES) + " FROM logn, sig")
def lognormal_survival(spark, sf):
    rows = survival.clip_duration(survival_features(spark, sf)).withColumn("mu", 5.0 + 0.2 * F.col("num_transactions"))
    out = survmodels.lognormal_curves(rows, survmodels.lognormal_sigma(rows).scalar(), TIMES)
    return rounded(out.select("customer_id", *[f"s_{t}" for t in TIMES]))


def evaluate(spark, train, test):
    """One row per model: both concordances, mean AUC and integrated Brier score."""
    train = checkpointed(train)
    test = checkpointed(test)
    fit = _cox(train)
    net = cox.fit_coxnet(train, SURVIVAL_FEATURES).model
    times = aft.fit_aft(train, SURVIVAL_FEATURES)
    scored = {
        "cox": cox.cox_curves(test, fit, TIMES).withColumn("risk", cox.linear_predictor(fit)),
        "coxnet": cox.cox_curves(test, net, TIMES).withColumn("risk", cox.linear_predictor(net)),
        "forest": survmodels.forest_curves(test, _forest(train), TIMES),
        "boosted": survmodels.boosted_curves(test, _boosted(train), TIMES),
        "aft": aft.aft_curves(aft.aft_scores(test, times), times, TIMES),
    }
    keep = ["customer_id", "duration", "event_observed", "risk", *[f"s_{t}" for t in TIMES]]
    scored = {m: checkpointed(df.select(*keep)) for m, df in scored.items()}
    stacked = None
    for m, df in scored.items():
        one = df.withColumn("model", F.lit(m))
        stacked = one if stacked is None else stacked.unionByName(one)
    plain = metrics.cindex(stacked, by=["model"]).select("model", "c_index")
    weighted = metrics.cindex_ipcw(train, stacked, by=["model"]).select("model", F.col("c_index").alias("c_index_ipcw"))
    out = None
    for m, df in scored.items():
        one = metrics.mean_td_auc(metrics.td_auc(train, df, TIMES), df).withColumn("model", F.lit(m)).join(
            metrics.ibs(metrics.brier(train, df, TIMES)).withColumn("model", F.lit(m)), "model")
        out = one if out is None else out.unionByName(one)
    return plain.join(weighted, "model").join(out, "model")


@query("k30_survival_comparison")
def survival_comparison(spark, sf):
    train, test = split_rows(spark, sf)
    return evaluate(spark, train, test)


@query("k31_permutation_importance")
def permutation_importance(spark, sf):
    train, test = split_rows(spark, sf)
    fit = _boosted(train)
    return survmodels.permutation_importance(checkpointed(test), SURVIVAL_FEATURES, lambda df: survmodels.boosted_scores(df, fit))


@query("k32_sample_curves")
def sample_curves(spark, sf):
    rows = repeat_rows(spark, sf)
    fit = _cox(rows)
    scored = cox.cox_curves(rows, fit, TIMES).withColumn("risk", cox.linear_predictor(fit))
    cols = ["customer_id", "segment", "risk", *[f"s_{t}" for t in TIMES]]
    by_risk = survmodels.sample_customers(scored, (10, 35, 65, 90)).select(F.concat(F.lit("p"), F.col("percentile")).alias("pick"), *cols)
    by_segment = survmodels.median_customers(scored).select(F.lit("segment_median").alias("pick"), *cols)
    return by_risk.unionByName(by_segment)


# Scorecard --------------------------------------------------------------------------

_S = {t: f"exp(-hazard * {h}::DOUBLE)" for t, h in _H0_NEAREST.items()}
_SLOPE, _INTERCEPT = scorecard.tail(LITERAL)


@query("l01_score_repeat", "SELECT customer_id, " + ", ".join(f"round({e}, 6) AS s_{t}" for t, e in _S.items()) + " FROM hz WHERE segment <> 'One-Timer'")
def score_repeat(spark, sf):
    out = scorecard.repeat(survival_features(spark, sf).where("segment <> 'One-Timer'"), LITERAL)
    return rounded(out.select("customer_id", *[f"s_{t}" for t in HORIZONS]))


CTES["med"] = f"""SELECT *, CASE WHEN target <= 0.001 THEN 0 WHEN target <= 0.01 THEN 30 WHEN target <= 0.05 THEN 90 WHEN target <= 0.2 THEN 180 WHEN target <= 0.6 THEN 365 WHEN target <= 1.1 THEN 730
  ELSE least((target - {_INTERCEPT!r}::DOUBLE) / {_SLOPE!r}::DOUBLE, 7300) END AS med_days, CASE WHEN target <= 1.1 THEN 'cox_observed' ELSE 'cox_extrapolated' END AS median_method
  FROM (SELECT *, 0.6931471805599453::DOUBLE / hazard AS target FROM hz WHERE segment <> 'One-Timer')"""


@query("l02_median_lifetime", "SELECT customer_id, CAST(round(med_days, 1) AS DOUBLE) AS predicted_median_lifetime_days, median_method FROM med")
def median_lifetime(spark, sf):
    out = scorecard.median_lifetime(survival_features(spark, sf).where("segment <> 'One-Timer'"), LITERAL)
    return out.select("customer_id", "predicted_median_lifetime_days", "median_method")


_ONE = f"SELECT {_step_sql(HORIZONS)}, coalesce(CAST(min(CASE WHEN s <= 0.5 THEN t END) AS DOUBLE), 730) AS predicted_median_lifetime_days FROM km_all"


@query("l03_score_one_timers", f"SELECT customer_id, o.*, 'kaplan_meier' AS median_method FROM surv_seg, ({_ONE}) o WHERE segment = 'One-Timer'")
def score_one_timers(spark, sf):
    rows = survival_features(spark, sf)
    out = scorecard.one_timers(rows.where("segment = 'One-Timer'"), survival.km(rows))
    return rounded(out.select("customer_id", *[f"s_{t}" for t in HORIZONS], "predicted_median_lifetime_days", "median_method"))


_RISK = "CASE WHEN event_observed = 1 THEN 'Churned - Loss/Winback' WHEN s90 <= 0.3 THEN 'High Risk' WHEN s90 <= 0.7 THEN 'Medium Risk' ELSE 'Low Risk' END"


@query("l04_risk_label", f"SELECT customer_id, {_RISK} AS risk_label FROM (SELECT *, {_S[90]} AS s90 FROM hz)")
def risk_label(spark, sf):
    rows = scorecard.repeat(survival_features(spark, sf), LITERAL)
    return rows.select("customer_id", scorecard.risk_label("s_90", F.col("event_observed") == 1).alias("risk_label"))


def card(rows, model=LITERAL):
    repeat = scorecard.median_lifetime(scorecard.repeat(rows.where("segment <> 'One-Timer'"), model), model)
    single = scorecard.one_timers(rows.where("segment = 'One-Timer'"), survival.km(rows))
    return scorecard.build(repeat, single)


CTES["one_km"] = "SELECT " + ", ".join(f"coalesce(arg_max(s, t) FILTER (WHERE t <= {t}), 1) AS k{t}" for t in HORIZONS) + ", coalesce(CAST(min(CASE WHEN s <= 0.5 THEN t END) AS DOUBLE), 730) AS km_med FROM km_all"
CTES["card"] = f"""SELECT customer_id, segment, CASE event_observed WHEN 1 THEN 'Churned' ELSE 'Active/Censored' END AS actual_status, duration AS actual_lifetime_days,
  {', '.join(f'round(s{t}, 3) AS "S({t}d)"' for t in HORIZONS)}, predicted_median_lifetime_days, median_method, {_RISK} AS risk_label FROM (
  SELECT customer_id, segment, duration, event_observed, {', '.join(f'{e} AS s{t}' for t, e in _S.items())}, CAST(round(med_days, 1) AS DOUBLE) AS predicted_median_lifetime_days, median_method FROM med
  UNION ALL SELECT customer_id, segment, duration, event_observed, {', '.join(f'k{t}' for t in HORIZONS)}, km_med, 'kaplan_meier' FROM surv_seg, one_km WHERE segment = 'One-Timer')"""


@query("l05_scorecard", "SELECT * FROM card")
def scorecard_table(spark, sf):
    return card(survival_features(spark, sf))


@query("l05b_scorecard_fitted")
def scorecard_fitted(spark, sf):
    rows = survival_features(spark, sf)
    return card(rows, _cox(repeat_part(rows)))


@query("l06_scorecard_audit", """SELECT 'method' AS kind, median_method AS value, count(*) AS n FROM card GROUP BY 2 UNION ALL SELECT 'risk', risk_label, count(*) FROM card GROUP BY 2
  UNION ALL SELECT 'nulls', 'all', CAST(0 AS BIGINT)""")
def scorecard_audit(spark, sf):
    return scorecard.audit(card(survival_features(spark, sf)))


# Supervised models ---------------------------------------------------------------------


def churn_rows(spark, sf):
    tx = lines(spark, sf)
    rows = clean.finite_cols(features.churn_dataset(tx, features.observation_end(tx)), CHURN_FEATURES)
    return checkpointed(labels.churn(rows))


@query("m01_cv_classifier")
def cv_classifier(spark, sf):
    return models.cv_classify(churn_rows(spark, sf), CHURN_FEATURES, windows=CHURN_WINDOWS, k=2, rounds=3)


def conversion_rows(spark, sf):
    """First-invoice features with labels, split by first purchase date."""
    tx = lines(spark, sf)
    feats = features.first_invoice_features(tx, HOME, GROUPS, PATTERNS)
    labeled = conversion_labels(spark, sf).where("label >= 0").select("customer_id", "label", "first_purchase_date")
    rows = labels.temporal_split(features.with_labels(feats, labeled), labels.cutoff_date(tx, 18), features.observation_end(tx))
    rows = checkpointed(rows)
    cols = [c for c in rows.columns if c not in ("customer_id", "label", "first_purchase_date", "split")]
    return rows.where("split = 'train'"), rows.where("split = 'test'"), cols


@query("m02_logistic")
def logistic(spark, sf):
    train, test, cols = conversion_rows(spark, sf)
    fit = models.logistic(train, cols)
    return models.importance(spark, fit, cols, len(cols))


@query("m03_forest_classifier")
def forest_classifier(spark, sf):
    train, test, cols = conversion_rows(spark, sf)
    scored = models.tree_scores(test, models.forest(train, cols, trees=500, depth=5), cols, "score")
    return scored.select("customer_id", "label", "score")


@query("m04_boosted_classifier")
def boosted_classifier(spark, sf):
    train, test, cols = conversion_rows(spark, sf)
    scored = models.tree_scores(test, models.boosted(train, cols, rounds=5, depth=3), cols, "score")
    return metrics.classification(scored).withColumn("auc", metrics.auc(scored).scalar())


@query("f03_consensus_features")
def consensus_features(spark, sf):
    train, _, cols = conversion_rows(spark, sf)
    fits = {"logistic": models.logistic(train, cols), "forest": models.forest(train, cols, trees=5, depth=5),
            "boosted": models.boosted(train, cols, rounds=3, depth=3)}
    return models.consensus({n: models.importance(spark, m, cols, 10) for n, m in fits.items()})


def clv_rows(spark, sf):
    tx = lines(spark, sf)
    train, holdout = labels.cutoff_split(tx)
    feats = clean.finite_cols(features.clv_features(train, labels.cutoff_date(tx)), CLV_FEATURES)
    rows = features.with_labels(feats, labels.ground_truth(train, holdout))
    return checkpointed(rows.select("customer_id", "actual_clv_6m", "returned", *CLV_FEATURES))


def clv_predictions(spark, sf, k=5):
    rows = clv_rows(spark, sf)
    out = rows.select("customer_id", "actual_clv_6m", "returned", "frequency")
    for kind in ("linear", "forest", "boosted"):
        pred = models.oof_regress(rows, CLV_FEATURES, "actual_clv_6m", kind, k=k)
        out = metrics.attach_predictions(out, pred.withColumnRenamed("pred", f"pred_{kind}"), [f"pred_{kind}"])
    return out


@query("m05_clv_regressors")
def clv_regressors(spark, sf):
    return clv_predictions(spark, sf)


@query("m19_clv_export")
def clv_export(spark, sf):
    rows = clv_rows(spark, sf)
    linear = models.oof_regress(rows, CLV_FEATURES, "actual_clv_6m", "linear").withColumnRenamed("pred", "pred_linear")
    scored = metrics.attach_predictions(rows, linear, ["pred_linear"])
    tx, _ = labels.cutoff_split(lines(spark, sf))
    rfm = checkpointed(btyd.rfm(tx))
    value = btyd.clv_fill(btyd.clv(rfm, btyd.fit_bgnbd(rfm, penalty=0.001), btyd.fit_gamma_gamma(rfm, penalty=0.001)))
    scored = metrics.attach_predictions(scored, value, ["clv"])
    return models.clv_result(scored, {"pred_linear": "linear_regression_clv", "clv": "btyd_clv"})


@query("m20_importance_rank")
def importance_rank(spark, sf):
    fit = models.refit(clv_rows(spark, sf), CLV_FEATURES, "actual_clv_6m", "forest")
    return models.importance(spark, fit, CLV_FEATURES, 15)
