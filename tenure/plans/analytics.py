"""Gap distribution, segmentation, purchase models, survival and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.constants import BUCKET_BINS, CLUSTER_FEATURES, CV_BINS, FREQUENCY_BINS, HORIZONS, KM_TIME_POINTS, RECENCY_BINS
from tenure.functions import scalars as S
from tenure.operators import btyd, cox, ecdf, features, labels, metrics, ordered, report, scorecard, segment, survival
from tenure.plans.base import CTES, gap_table, lines, query, rounded, summary
from tenure.plans.relational import sql_bins, sql_norm_cdf
from tenure.session import checkpointed

# Gap distribution -----------------------------------------------------------------

CTES["grid"] = """SELECT CAST(d.range AS INTEGER) AS day, count(g.gap_days) / (SELECT count(*) FROM gaps) AS cdf
  FROM range(121) d LEFT JOIN gaps g ON g.gap_days <= d.range GROUP BY 1"""


# Customer-level tables that an operator reads several times are written once
# (checkpointed): they are orders of magnitude smaller than the lines behind them.


def gap_grid(spark, sf):
    """The daily curve: 121 rows, written once since the elbow steps read it repeatedly."""
    return checkpointed(ecdf.ecdf(gap_table(spark, sf)))


@query("h00_prefix_sum", """SELECT gap_days, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY gap_days) AS BIGINT) AS cum_n FROM gaps GROUP BY 1""")
def prefix_sum(spark, sf):
    return ordered.prefix_sum(gap_table(spark, sf), "gap_days", {"n": F.lit(1)})


@query("h01_ecdf_daily", "SELECT day, round(cdf, 9) AS cdf FROM grid")
def ecdf_daily(spark, sf):
    return rounded(gap_grid(spark, sf), 9)


_DAYS = (15, 30, 40, 45, 50, 60, 90)


@query("h02_key_day_rates", "SELECT day, round(p, 6) AS cumulative_pct, round(p - coalesce(lag(p) OVER (ORDER BY day), 0), 6) AS gain_pp FROM (" + " UNION ALL ".join(
    f"SELECT {d} AS day, count(*) FILTER (WHERE gap_days <= {d}) * 100.0::DOUBLE / count(*) AS p FROM gaps" for d in _DAYS) + ")")
def key_day_rates(spark, sf):
    return rounded(ecdf.key_days(gap_table(spark, sf)))


@query("h03_marginal_gain", """SELECT day, round((ahead - cdf) * 100, 6) AS gain_pp FROM (SELECT day, cdf, lead(cdf, 5) OVER (ORDER BY day) AS ahead FROM grid)
  WHERE day % 5 = 0 AND ahead IS NOT NULL""")
def marginal_gain(spark, sf):
    return rounded(ecdf.marginal(gap_grid(spark, sf)))


CTES["chord"] = """SELECT day AS elbow_day, cdf * 100 AS elbow_pct, dist AS distance FROM (
  SELECT g.day, cdf, round(abs((y1 - y0) * (day / 120.0::DOUBLE) - cdf + y0) / sqrt((y1 - y0) * (y1 - y0) + 1), 12) AS dist
  FROM grid g, (SELECT arg_min(cdf, day) AS y0, arg_max(cdf, day) AS y1 FROM grid)) ORDER BY dist DESC, day LIMIT 1"""


@query("h04_elbow_chord", "SELECT elbow_day, round(elbow_pct, 6) AS elbow_pct, round(distance, 6) AS distance FROM chord")
def elbow_chord(spark, sf):
    return rounded(ecdf.elbow_chord(gap_grid(spark, sf)))


CTES["taps"] = """SELECT CAST(range AS INTEGER) AS o, exp(-0.5 * (range / 3.0::DOUBLE) * (range / 3.0::DOUBLE)) / (SELECT sum(exp(-0.5 * (range / 3.0::DOUBLE) * (range / 3.0::DOUBLE))) FROM range(-12, 13)) AS w FROM range(-12, 13)"""
CTES["smooth"] = """SELECT d.day, any_value(d.cdf) AS cdf, sum(w * s.cdf) AS smooth FROM grid d, taps, grid s
  WHERE s.day = CASE WHEN d.day + o < 0 THEN -(d.day + o) - 1 WHEN d.day + o > 120 THEN 241 - (d.day + o) ELSE d.day + o END GROUP BY 1"""


@query("h05_gaussian_smooth", "SELECT day, round(cdf, 9) AS cdf, round(smooth, 9) AS smooth FROM smooth")
def gaussian_smooth(spark, sf):
    return rounded(ecdf.gaussian(gap_grid(spark, sf)), 9)


def _slope_sql(col):
    before, after = f"lag({col}) OVER (ORDER BY day)", f"lead({col}) OVER (ORDER BY day)"
    return f"CASE WHEN {before} IS NULL THEN {after} - {col} WHEN {after} IS NULL THEN {col} - {before} ELSE ({after} - {before}) / 2.0 END"


CTES["curved"] = f"""SELECT *, abs(ddy) / pow(1 + dy * dy, 1.5::DOUBLE) AS curvature FROM (SELECT *, {_slope_sql('dy')} AS ddy FROM (SELECT *, {_slope_sql('smooth')} AS dy FROM smooth))"""
CTES["bend"] = "SELECT day AS curvature_day, cdf * 100 AS curvature_pct FROM curved WHERE day >= 10 ORDER BY round(curvature, 12) DESC, day LIMIT 1"


@query("h06_curvature_elbow", "SELECT curvature_day, round(curvature_pct, 6) AS curvature_pct FROM bend")
def curvature_elbow(spark, sf):
    return rounded(ecdf.elbow_curvature(ecdf.curvature(ecdf.gaussian(gap_grid(spark, sf)))))


@query("h07_elbow_summary", """SELECT elbow_day, round(elbow_pct, 6) AS elbow_pct, curvature_day, round(curvature_pct, 6) AS curvature_pct,
  least(elbow_day, curvature_day) AS range_low, greatest(elbow_day, curvature_day) AS range_high FROM chord, bend""")
def elbow_summary(spark, sf):
    return rounded(ecdf.summary(gap_grid(spark, sf)))


# Purchase models ----------------------------------------------------------------------

CTES["rfm"] = """
SELECT customer_id, CAST(n - 1 AS DOUBLE) AS frequency, CAST(date_diff('day', first_day, last_day) AS DOUBLE) AS recency,
  CAST(date_diff('day', first_day, CAST(obs_end AS DATE)) AS DOUBLE) AS "T",
  CASE WHEN n > 1 THEN CAST(CAST(spend AS DECIMAL(18,4)) - CAST(first_total AS DECIMAL(18,4)) AS DOUBLE) / (n - 1) ELSE 0 END AS monetary_value
FROM (SELECT customer_id, count(*) AS n, min(day) AS first_day, max(day) AS last_day, sum(CAST(total AS DECIMAL(18,4))) AS spend, arg_min(total, day) AS first_total
  FROM (SELECT customer_id, CAST(invoice_date AS DATE) AS day, CAST(sum(CAST(line_total AS DECIMAL(18,4))) AS DOUBLE) AS total FROM tx GROUP BY 1, 2) GROUP BY 1), obs"""

# Parameters the scoring queries and their SQL share.
BG = btyd.BgNbd(0.7, 240.0, 0.5, 3.4)
GG = btyd.GammaGamma(6.0, 4.0, 90000.0)
BG2 = btyd.BgNbd(0.72, 250.0, 0.45, 3.1)


def rfm(spark, sf):
    return btyd.rfm(lines(spark, sf))


@query("j01_rfm_summary", "SELECT * FROM rfm")
def rfm_summary(spark, sf):
    return rfm(spark, sf)


def _params(spark, m):
    return btyd.params_frame(spark, model=m)


@query("j02_bgnbd_fit")
def bgnbd_fit(spark, sf):
    return _params(spark, btyd.fit_bgnbd(rfm(spark, sf), penalty=0.001))


def sql_rising(base):
    return f"coalesce(list_sum(list_transform(range(CAST(frequency AS BIGINT)), lambda i: ln(i + {base}::DOUBLE))), 0)"


_SQL_U = f"-(frequency + {BG.r}) * ln(\"T\" + {BG.alpha})"
_SQL_V = f"CASE WHEN frequency > 0 THEN ln({BG.a}::DOUBLE) - ln(frequency + {BG.b} - 1) - (frequency + {BG.r}) * ln(recency + {BG.alpha}) END"


@query("j03_bgnbd_loglik", f"""SELECT round(sum({sql_rising(BG.r)} + {BG.r} * ln({BG.alpha}::DOUBLE) + {sql_rising(BG.b)} - {sql_rising(BG.a + BG.b)}
  + greatest(u, v) + CASE WHEN frequency > 0 THEN ln(1 + exp(-abs(u - v))) ELSE 0 END), 4) AS loglik, count(*) AS n
  FROM (SELECT *, {_SQL_U} AS u, {_SQL_V} AS v FROM rfm)""")
def bgnbd_loglik(spark, sf):
    return rounded(btyd.loglik(rfm(spark, sf), BG), 4)


def sql_odds(m):
    return f"({m.a} / ({m.b} + frequency - 1) * exp((frequency + {m.r}) * (ln({m.alpha} + \"T\") - ln({m.alpha} + recency))))"


def sql_p_alive(m=BG):
    return f"CASE WHEN frequency > 0 THEN 1 / (1 + {sql_odds(m)}) ELSE 1 END"


def sql_purchases(m=BG, t=180):
    """The same 100-term series as a list fold."""
    z = f"({t}::DOUBLE / ({m.alpha} + \"T\" + {t}))"
    A, B, C = m.a + m.b - 1 - m.r, m.a - 1, f"({m.a + m.b - 1}::DOUBLE + frequency)"
    step = f"({A}::DOUBLE + e.k) * ({B}::DOUBLE + e.k) / (({C} + e.k) * (e.k + 1)) * {z}"
    series = (f"list_reduce(list_prepend({{'t': 1.0::DOUBLE, 's': 0.0::DOUBLE, 'k': 0.0::DOUBLE}}, "
              f"list_transform(range(100), lambda i: {{'t': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'k': CAST(i AS DOUBLE)}})), "
              f"lambda acc, e: {{'t': acc.t * {step}, 's': acc.s + acc.t, 'k': e.k}}).s")
    return (f"({C} / {B} * (1 - exp({B} * (ln({m.alpha} + \"T\") - ln({m.alpha} + \"T\" + {t}))) * {series}) "
            f"/ (1 + CASE WHEN frequency > 0 THEN {sql_odds(m)} ELSE 0 END))")


def sql_spend(g=GG):
    return (f"({g.p} * frequency / ({g.p} * frequency + {g.q} - 1) * monetary_value + (1 - {g.p} * frequency / ({g.p} * frequency + {g.q} - 1)) * {g.p * g.v / (g.q - 1)})")


@query("j04_p_alive", f"SELECT customer_id, round({sql_p_alive()}, 6) AS p_alive FROM rfm")
def p_alive(spark, sf):
    return rounded(btyd.p_alive(rfm(spark, sf), BG).select("customer_id", "p_alive"))


@query("j05_expected_purchases", f"SELECT customer_id, round({sql_purchases()}, 6) AS expected_purchases FROM rfm")
def expected_purchases(spark, sf):
    return rounded(btyd.expected_purchases(rfm(spark, sf), BG).select("customer_id", "expected_purchases"))


@query("j06_gamma_gamma_fit")
def gamma_gamma_fit(spark, sf):
    return _params(spark, btyd.fit_gamma_gamma(rfm(spark, sf), penalty=0.001))


@query("j07_expected_spend", f"SELECT customer_id, round(coalesce(spend, (SELECT quantile_cont(spend, 0.5) FROM sp)), 4) AS expected_spend FROM sp")
def expected_spend(spark, sf):
    return rounded(btyd.expected_spend(rfm(spark, sf), GG, fill_median=True).select("customer_id", "expected_spend"), 4)


CTES["sp"] = f"SELECT customer_id, CASE WHEN frequency > 0 THEN {sql_spend()} END AS spend FROM rfm"
_CLV = " + ".join(f"{sql_spend()} * (e{k} - e{k - 1}) / pow(1.01::DOUBLE, {k})" if k > 1 else f"{sql_spend()} * e1 / 1.01::DOUBLE" for k in range(1, 7))
CTES["months"] = "SELECT *, " + ", ".join(f"{sql_purchases(t=30 * k)} AS e{k}" for k in range(1, 7)) + " FROM rfm"


@query("j08_clv_discounted", f"SELECT customer_id, round(CASE WHEN frequency > 0 THEN {_CLV} END, 3) AS clv FROM months")
def clv_discounted(spark, sf):
    return rounded(btyd.clv(rfm(spark, sf), BG, GG).select("customer_id", "clv"), 3)


@query("j09_clv_simple", f"SELECT customer_id, round(e6 * CASE WHEN frequency > 0 THEN {sql_spend()} END, 3) AS clv_simple FROM months")
def clv_simple(spark, sf):
    scored = btyd.expected_spend(btyd.expected_purchases(rfm(spark, sf), BG), GG)
    return rounded(btyd.clv_simple(scored).select("customer_id", "clv_simple"), 3)


@query("j10_clv_one_timer_zero", f"SELECT customer_id, round(coalesce(CASE WHEN frequency > 0 THEN {_CLV} END, 0), 3) AS clv FROM months")
def clv_one_timer_zero(spark, sf):
    return rounded(btyd.clv_fill(btyd.clv(rfm(spark, sf), BG, GG)).select("customer_id", "clv"), 3)


CTES["cal_cut"] = "SELECT lo + to_days(CAST(floor(floor((epoch_us(hi) - epoch_us(lo)) / 86400000000.0) * 0.7::DOUBLE) AS INTEGER)) AS cal_end, hi FROM (SELECT min(invoice_date) AS lo, max(invoice_date) AS hi FROM tx)"
CTES["cal"] = """
SELECT customer_id, CAST(count(*) - 1 AS DOUBLE) AS frequency_cal, CAST(date_diff('day', min(day), max(day)) AS DOUBLE) AS recency_cal,
  CAST(date_diff('day', min(day), CAST(any_value(cal_end) AS DATE)) AS DOUBLE) AS "T_cal"
FROM (SELECT DISTINCT customer_id, CAST(invoice_date AS DATE) AS day FROM tx), cal_cut WHERE day <= CAST(cal_end AS DATE) GROUP BY 1"""
CTES["cal_holdout"] = """
SELECT cal.*, coalesce(h, 0) AS frequency_holdout, (SELECT CAST(date_diff('day', CAST(cal_end AS DATE), CAST(hi AS DATE)) AS DOUBLE) FROM cal_cut) AS duration_holdout
FROM cal LEFT JOIN (SELECT customer_id, count(DISTINCT CAST(invoice_date AS DATE)) AS h FROM tx, cal_cut WHERE CAST(invoice_date AS DATE) > CAST(cal_end AS DATE) GROUP BY 1) USING (customer_id)"""


@query("g08_calibration_split", "SELECT * FROM cal_holdout")
def calibration_split(spark, sf):
    return btyd.calibration_holdout(lines(spark, sf))


CTES["validated"] = f"""SELECT *, {sql_purchases(t='duration_holdout').replace('"T"', '"T_cal"').replace('frequency', 'frequency_cal').replace('recency', 'recency_cal')} AS predicted FROM cal_holdout"""


@query("j11_holdout_validation", """SELECT round(avg(abs(frequency_holdout - predicted)), 6) AS mae, round(sqrt(avg(pow(frequency_holdout - predicted, 2))), 6) AS rmse,
  round(corr(frequency_holdout, predicted), 6) AS pearson, round(corr(ra, rb), 4) AS spearman FROM (
  SELECT *, rank() OVER (ORDER BY frequency_holdout) + (count(*) OVER (PARTITION BY frequency_holdout) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0::DOUBLE AS rb FROM validated)""")
def holdout_validation(spark, sf):
    return rounded(btyd.validate(btyd.calibration_holdout(lines(spark, sf)), BG), spearman=4)


@query("j12_bgnbd_map")
def bgnbd_map(spark, sf):
    return _params(spark, btyd.fit_bgnbd(rfm(spark, sf), prior_sigma=10.0))


@query("j13_posterior_summary")
def posterior_summary(spark, sf):
    base = checkpointed(rfm(spark, sf))
    m = btyd.fit_bgnbd(base, prior_sigma=10.0)
    g = btyd.fit_gamma_gamma(base, prior_sigma=10.0)
    drawn = btyd.posterior_draws(base, m, g)
    out = btyd.posterior(base, drawn.rows)
    return out.select("customer_id", *[f"{k}_{s}" for k in ("purchases", "p_alive", "spend", "clv") for s in ("mean", "std")],
                      F.lit(drawn.ess_purchases).alias("ess_purchases"), F.lit(drawn.ess_spend).alias("ess_spend"))


# A fixed table of draws, shared with the SQL of the queries below.
DRAWS = [dict(draw=i, r=0.6 + 0.01 * i, alpha=200.0 + 5 * i, a=0.4 + 0.02 * i, b=3.0 + 0.1 * i, p=5.0 + 0.1 * i, q=3.5 + 0.05 * i, v=80000.0 + 1000 * i)
         for i in range(12)]
CTES["draws"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"{d[k]!r}::DOUBLE" for k in ("draw", "r", "alpha", "a", "b", "p", "q", "v")) + ")" for d in DRAWS) + ") d(draw, r, alpha, a, b, p, q, v)"
_D_ALIVE = "CASE WHEN frequency > 0 THEN 1 / (1 + a / (b + frequency - 1) * exp((frequency + r) * (ln(alpha + \"T\") - ln(alpha + recency)))) ELSE 1 END"
_D_SPEND = "CASE WHEN frequency > 0 THEN p * frequency / (p * frequency + q - 1) * monetary_value + (1 - p * frequency / (p * frequency + q - 1)) * p * v / (q - 1) END"


def _posterior_sql(where=""):
    return (f"SELECT customer_id, round(avg({_D_ALIVE}), 6) AS p_alive_mean, round(stddev_pop({_D_ALIVE}), 6) AS p_alive_std, "
            f"round(avg({_D_SPEND}), 3) AS spend_mean, round(stddev_pop({_D_SPEND}), 3) AS spend_std FROM rfm, draws {where} GROUP BY 1")


def _posterior(spark, sf, rows):
    out = btyd.posterior(rfm(spark, sf), rows, what=("p_alive", "spend"))
    return rounded(out.select("customer_id", "p_alive_mean", "p_alive_std", "spend_mean", "spend_std"), spend_mean=3, spend_std=3)


@query("c12_draws_cross_join", _posterior_sql())
def draws_scores(spark, sf):
    return _posterior(spark, sf, DRAWS)


@query("j14_thin_draws", _posterior_sql("WHERE CAST(draw AS INTEGER) % 2 = 0"))
def thin_draws(spark, sf):
    return _posterior(spark, sf, btyd.thin(DRAWS, 2))


_GRID_SQL = f"""
SELECT frequency, recency, round({sql_p_alive()}, 6) AS p_alive, round({sql_purchases(t=30)}, 6) AS expected_purchases FROM (
  SELECT CAST(x.range AS DOUBLE) AS frequency, CAST(y.range AS DOUBLE) AS recency, mt AS "T"
  FROM (SELECT max(frequency)::BIGINT AS mx, max(recency)::BIGINT AS mr, max("T") AS mt FROM rfm), range(0, 1000) x, range(0, 10000) y WHERE x.range <= mx AND y.range <= mr)"""


@query("j15_score_grid", _GRID_SQL)
def score_grid(spark, sf):
    return rounded(btyd.score_grid(rfm(spark, sf), BG).select("frequency", "recency", "p_alive", "expected_purchases"))


@query("j16_fit_comparison")
def fit_comparison(spark, sf):
    base = checkpointed(rfm(spark, sf))
    return btyd.compare_params(spark, btyd.fit_bgnbd(base, penalty=0.001), btyd.fit_bgnbd(base, prior_sigma=10.0), ("ml", "map"))


def two_fits(spark, sf):
    """Two result sets over the same customers, from two parameter sets."""
    base = rfm(spark, sf)
    a = btyd.expected_purchases(btyd.p_alive(base, BG, "alive_a"), BG, out="purchases_a").select("customer_id", "frequency", "alive_a", "purchases_a")
    b = btyd.expected_purchases(btyd.p_alive(base, BG2, "alive_b"), BG2, out="purchases_b").select("customer_id", "alive_b", "purchases_b")
    return metrics.align(a, b)


CTES["fits"] = f"SELECT customer_id, frequency, {sql_p_alive(BG)} AS alive_a, {sql_p_alive(BG2)} AS alive_b, {sql_purchases(BG)} AS purchases_a, {sql_purchases(BG2)} AS purchases_b FROM rfm"


@query("c08_compare_join", "SELECT customer_id, frequency, round(alive_a, 6) AS alive_a, round(purchases_a, 6) AS purchases_a, round(alive_b, 6) AS alive_b, round(purchases_b, 6) AS purchases_b FROM fits WHERE frequency > 0")
def compare_join(spark, sf):
    return rounded(two_fits(spark, sf).where("frequency > 0"))


def agreement_input(spark, sf):
    """Recency-based and spend-based scores: exact in both engines, so ranks agree."""
    return checkpointed(summary(spark, sf).select(
        "customer_id", "frequency", F.col("T").cast("double").alias("a"), F.col("recency").cast("double").alias("b")))


_RANKED = """(SELECT *, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS rb FROM {src})"""
CTES["pair"] = 'SELECT customer_id, frequency, CAST(age_days AS DOUBLE) AS a, CAST(recency AS DOUBLE) AS b FROM summary'
CTES["ks_steps"] = """SELECT v, sum(sum(ia)) OVER (ORDER BY v) / (SELECT count(*) FROM pair) AS fa, sum(sum(ib)) OVER (ORDER BY v) / (SELECT count(*) FROM pair) AS fb
  FROM (SELECT a AS v, 1 AS ia, 0 AS ib FROM pair UNION ALL SELECT b, 0, 1 FROM pair) GROUP BY v"""
_KS_P = "CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, " + " + ".join(f"{2.0 * (-1) ** (k - 1)} * exp({-2.0 * k * k} * x * x)" for k in range(1, 41)) + ")) END"
CTES["ks_out"] = f"SELECT statistic, {_KS_P} AS p_value FROM (SELECT statistic, statistic * sqrt((SELECT count(*) FROM pair) / 2.0::DOUBLE) AS x FROM (SELECT max(abs(fa - fb)) AS statistic FROM ks_steps))"


def _top(col, k):
    return f"SELECT customer_id FROM pair ORDER BY {col} DESC, customer_id LIMIT {k}"


@query("j17_agreement_report", f"""SELECT round(corr(a, b), 6) AS pearson, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b,
  sum(a) AS total_a, sum(b) AS total_b, quantile_cont(a, 0.5) AS median_a, quantile_cont(b, 0.5) AS median_b, round(corr(ra, rb), 6) AS spearman,
  round(any_value(statistic), 6) AS ks_statistic, round(any_value(p_value), 6) AS ks_p_value,
  (SELECT count(*) FROM ({_top('a', 50)}) JOIN ({_top('b', 50)}) USING (customer_id)) AS top50_overlap, (SELECT count(*) FROM ({_top('a', 100)}) JOIN ({_top('b', 100)}) USING (customer_id)) AS top100_overlap
  FROM {_RANKED.format(a='a', b='b', src='pair')}, ks_out""")
def agreement_report(spark, sf):
    return rounded(metrics.agreement(agreement_input(spark, sf), "a", "b"))


# the same report on what two parameter sets predict; 6 decimals, so that both engines see the same ties
for _what in ("purchases", "alive"):
    CTES[f"pair_{_what}"] = f"SELECT customer_id, round({_what}_a, 6) AS a, round({_what}_b, 6) AS b FROM fits WHERE frequency > 0"
    CTES[f"steps_{_what}"] = f"""SELECT v, sum(sum(ia)) OVER (ORDER BY v) / (SELECT count(*) FROM pair_{_what}) AS fa, sum(sum(ib)) OVER (ORDER BY v) / (SELECT count(*) FROM pair_{_what}) AS fb
      FROM (SELECT a AS v, 1 AS ia, 0 AS ib FROM pair_{_what} UNION ALL SELECT b, 0, 1 FROM pair_{_what}) GROUP BY v"""
    CTES[f"ks_{_what}"] = f"SELECT statistic, {_KS_P} AS p_value FROM (SELECT statistic, statistic * sqrt((SELECT count(*) FROM pair_{_what}) / 2.0::DOUBLE) AS x FROM (SELECT max(abs(fa - fb)) AS statistic FROM steps_{_what}))"


def _fits_agree_sql(what):
    def top(col, k):
        return f"SELECT customer_id FROM pair_{what} ORDER BY {col} DESC, customer_id LIMIT {k}"

    return f"""SELECT '{what}' AS quantity, round(corr(a, b), 5) AS pearson, round(avg(abs(a - b)), 5) AS mae, round(sqrt(avg((a - b) * (a - b))), 5) AS rmse, round(avg(a), 5) AS mean_a,
      round(avg(b), 5) AS mean_b, round(sum(a), 3) AS total_a, round(sum(b), 3) AS total_b, round(quantile_cont(a, 0.5), 5) AS median_a, round(quantile_cont(b, 0.5), 5) AS median_b,
      round(corr(ra, rb), 5) AS spearman, round(any_value(statistic), 5) AS ks_statistic, round(any_value(p_value), 5) AS ks_p_value,
      (SELECT count(*) FROM ({top('a', 50)}) JOIN ({top('b', 50)}) USING (customer_id)) AS top50_overlap,
      (SELECT count(*) FROM ({top('a', 100)}) JOIN ({top('b', 100)}) USING (customer_id)) AS top100_overlap
      FROM {_RANKED.format(a='a', b='b', src=f'pair_{what}')}, ks_{what}"""


@query("j17b_fit_agreement", " UNION ALL ".join(_fits_agree_sql(w) for w in ("purchases", "alive")))
def fit_agreement(spark, sf):
    both = checkpointed(two_fits(spark, sf).where("frequency > 0"))
    out = None
    for what in ("purchases", "alive"):
        pair = both.select("customer_id", F.round(f"{what}_a", 6).alias("a"), F.round(f"{what}_b", 6).alias("b"))
        one = metrics.agreement(pair, "a", "b").withColumn("quantity", F.lit(what))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5, total_a=3, total_b=3)


@query("j18_difference_profile", """SELECT CAST(least(49, floor((greatest(-1000, least(1000, b - a)) + 1000) * 50 / 2000)) + 1 AS INTEGER) AS bin, count(*) AS n FROM pair GROUP BY 1""")
def difference_profile(spark, sf):
    return metrics.diff_profile(agreement_input(spark, sf), "a", "b", -1000.0, 1000.0)


@query("j18b_uncertainty_cv", f"SELECT customer_id, round(s / (m + 1e-6::DOUBLE), 6) AS cv FROM (SELECT customer_id, avg({_D_ALIVE}) AS m, stddev_pop({_D_ALIVE}) AS s FROM rfm, draws GROUP BY 1)")
def uncertainty_cv(spark, sf):
    out = btyd.posterior(rfm(spark, sf), DRAWS, what=("p_alive",))
    return rounded(metrics.uncertainty_cv(out, "p_alive_mean", "p_alive_std").select("customer_id", "cv"))


@query("j19_freq_bucket_agreement", f"""SELECT {sql_bins('frequency', *BUCKET_BINS)} AS freq_bucket, count(*) AS n, round(avg(alive_a), 6) AS alive_a, round(avg(alive_b), 6) AS alive_b,
  round(avg(purchases_a), 6) AS purchases_a, round(avg(purchases_b), 6) AS purchases_b FROM fits GROUP BY 1""")
def freq_bucket_agreement(spark, sf):
    return rounded(metrics.by_bucket(two_fits(spark, sf), ["alive_a", "alive_b", "purchases_a", "purchases_b"]))


@query("d25_correlation_check", "SELECT round(corr(frequency, monetary_value), 6) AS corr FROM rfm WHERE frequency > 0")
def correlation_check(spark, sf):
    return rounded(btyd.independence_corr(rfm(spark, sf)))


# Segmentation ----------------------------------------------------------------------------


@query("i01_standardize", "SELECT customer_id, " + ", ".join(
    f'round(({c} - (SELECT avg({c}) FROM rfm)) / (SELECT stddev_pop({c}) FROM rfm), 6) AS "{c.strip(chr(34))}_z"' for c in ("frequency", "recency", "monetary_value", '"T"')) + " FROM rfm")
def standardize(spark, sf):
    out = segment.standardize(rfm(spark, sf), CLUSTER_FEATURES)
    return rounded(out.select("customer_id", *[f"{c}_z" for c in CLUSTER_FEATURES]))


@query("i02_pca3")
def pca3(spark, sf):
    return segment.pca_table(rfm(spark, sf).where("frequency > 0"), CLUSTER_FEATURES)


def _segments(spark, sf):
    return segment.segment_repeat(rfm(spark, sf), CLUSTER_FEATURES)


@query("i03_kmeans3")
def kmeans3(spark, sf):
    return _segments(spark, sf).select("customer_id", "cluster", "pc1", "pc2", "pc3")


@query("i04_tier_labels")
def tier_labels(spark, sf):
    return _segments(spark, sf).groupBy("cluster", "segment").agg(F.count("*").alias("n"), F.avg("monetary_value").alias("mean_money"))


@query("i05_segment_all")
def segment_all(spark, sf):
    return segment.attach(rfm(spark, sf), _segments(spark, sf)).select("customer_id", "segment")


CTES["rank_tiers"] = """SELECT *, CASE WHEN monetary_value > hi THEN 'Gold' WHEN monetary_value > lo THEN 'Silver' ELSE 'Bronze' END AS segment FROM rfm,
  (SELECT quantile_cont(monetary_value, 1.0::DOUBLE / 3) AS lo, quantile_cont(monetary_value, 2.0::DOUBLE / 3) AS hi FROM rfm WHERE frequency > 0) WHERE frequency > 0"""
CTES["tiered"] = "SELECT rfm.customer_id, coalesce(segment, 'One-Timer') AS segment FROM rfm LEFT JOIN rank_tiers USING (customer_id)"


@query("i06_quantile_tiers", "SELECT customer_id, segment FROM rank_tiers")
def quantile_tiers(spark, sf):
    return segment.tiers_by_rank(rfm(spark, sf)).select("customer_id", "segment")


def tiered(spark, sf):
    base = checkpointed(rfm(spark, sf))
    return segment.attach(base, segment.tiers_by_rank(base)).select("customer_id", "segment")


# Survival curves -----------------------------------------------------------------------------

CTES["surv"] = "SELECT customer_id, CAST(floor((epoch_us(last_purchase) - epoch_us(first_purchase)) / 86400000000.0) AS INTEGER) AS duration, CAST(recency > 45 AS INTEGER) AS event_observed FROM summary"
CTES["risk"] = """SELECT t, events, censored, CAST(sum(events + censored) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM (
  SELECT duration AS t, CAST(sum(event_observed) AS BIGINT) AS events, CAST(sum(1 - event_observed) AS BIGINT) AS censored FROM surv GROUP BY 1)"""
CTES["km_all"] = """SELECT *, CASE WHEN max(CAST(events = at_risk AS INTEGER)) OVER (ORDER BY t) = 1 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER (ORDER BY t)) END AS s FROM risk"""
CTES["surv_seg"] = "SELECT surv.*, segment FROM surv JOIN tiered USING (customer_id)"
CTES["risk_seg"] = """SELECT segment, t, events, censored, CAST(sum(events + censored) OVER (PARTITION BY segment ORDER BY t DESC) AS BIGINT) AS at_risk FROM (
  SELECT segment, duration AS t, CAST(sum(event_observed) AS BIGINT) AS events, CAST(sum(1 - event_observed) AS BIGINT) AS censored FROM surv_seg GROUP BY 1, 2)"""
CTES["km_seg"] = """SELECT *, CASE WHEN max(CAST(events = at_risk AS INTEGER)) OVER (PARTITION BY segment ORDER BY t) = 1 THEN 0
  ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER (PARTITION BY segment ORDER BY t)) END AS s FROM risk_seg"""


def surv(spark, sf):
    tx = lines(spark, sf)
    return survival.dataset(tx, features.observation_end(tx))


def surv_seg(spark, sf):
    return checkpointed(survival.attach(surv(spark, sf), tiered(spark, sf)))


@query("k01_survival_dataset", "SELECT * FROM surv")
def survival_dataset(spark, sf):
    return surv(spark, sf)


@query("k02_clip_duration", "SELECT customer_id, greatest(duration, 1) AS duration, event_observed FROM surv JOIN (SELECT customer_id FROM summary WHERE frequency > 0) USING (customer_id)")
def clip_duration(spark, sf):
    repeat = summary(spark, sf).where("frequency > 0").select("customer_id")
    return survival.clip_duration(surv(spark, sf).join(repeat, "customer_id", "left_semi"))


@query("c06_segment_join", "SELECT customer_id, duration, event_observed, segment FROM surv_seg")
def segment_join(spark, sf):
    return surv_seg(spark, sf)


@query("k03_risk_table", "SELECT * FROM risk")
def risk_table(spark, sf):
    return survival.risk_table(surv(spark, sf))


@query("k04_kaplan_meier", "SELECT t, events, censored, at_risk, round(s, 9) AS s FROM km_all")
def kaplan_meier(spark, sf):
    return rounded(survival.km(surv(spark, sf)), 9)


_G = "sum(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) END) OVER (ORDER BY t)"
_THETA = "1.959963984540054::DOUBLE * sqrt(g) / abs(ln(CASE WHEN s > 0 AND s < 1 THEN s END))"


@query("k05_km_ci", f"SELECT t, round(s, 6) AS s, round(pow(s, exp({_THETA})), 6) AS s_lower, round(pow(s, exp(-({_THETA}))), 6) AS s_upper FROM (SELECT *, {_G} AS g FROM km_all)")
def km_ci(spark, sf):
    return rounded(survival.km_ci(survival.km(surv(spark, sf))).select("t", "s", "s_lower", "s_upper"))


@query("k06_km_cumulative", "SELECT t, round(1 - s, 9) AS f FROM km_all")
def km_cumulative(spark, sf):
    return rounded(survival.cdf(survival.km(surv(spark, sf))).select("t", "f"), 9)


@query("k07_km_median", "SELECT segment, coalesce(CAST(min(CASE WHEN s <= 0.5 THEN t END) AS DOUBLE), 730) AS median FROM km_seg GROUP BY 1")
def km_median(spark, sf):
    return survival.median(survival.km(surv_seg(spark, sf), ["segment"]), ["segment"], 730.0)


@query("k08_km_by_segment", "SELECT segment, t, events, censored, at_risk, round(s, 9) AS s FROM km_seg")
def km_by_segment(spark, sf):
    return rounded(survival.km(surv_seg(spark, sf), ["segment"]), 9)


def _step_sql(times, prefix="s_"):
    return ", ".join(f"round(coalesce(arg_max(s, t) FILTER (WHERE t <= {t}), 1), 6) AS {prefix}{t}" for t in times)


@query("k09_km_time_points", f"SELECT segment, {_step_sql(KM_TIME_POINTS)} FROM km_seg GROUP BY 1")
def km_time_points(spark, sf):
    return rounded(survival.time_points(surv_seg(spark, sf), "segment", KM_TIME_POINTS))


@query("c10_nearest_lookup", "SELECT segment, " + ", ".join(f"round(arg_min(s, (abs(t - {h}), t)), 6) AS s_{h}" for h in HORIZONS) + " FROM km_seg GROUP BY 1")
def nearest_lookup(spark, sf):
    return rounded(survival.at_horizons(survival.km(surv_seg(spark, sf), ["segment"]), by=["segment"]))


@query("c11_step_lookup", f"SELECT {_step_sql(HORIZONS)} FROM km_all")
def step_lookup(spark, sf):
    return rounded(survival.step_at(survival.km(surv(spark, sf)), HORIZONS))


_TIERS3 = ("Bronze", "Gold", "Silver")
CTES["lr_days"] = "SELECT duration AS t, " + ", ".join(f"CAST(sum(event_observed) FILTER (WHERE segment = '{g}') AS DOUBLE) AS e{i}, CAST(count(*) FILTER (WHERE segment = '{g}') AS DOUBLE) AS c{i}" for i, g in enumerate(_TIERS3)) + " FROM surv_seg WHERE segment <> 'One-Timer' GROUP BY 1"
CTES["lr"] = "SELECT *, d0 + d1 + d2 AS d, n0 + n1 + n2 AS n FROM (SELECT t, " + ", ".join(f"coalesce(e{i}, 0) AS d{i}, sum(coalesce(c{i}, 0)) OVER (ORDER BY t DESC) AS n{i}" for i in range(3)) + " FROM lr_days)"


@query("k10_logrank_multi", """SELECT round(stat, 6) AS statistic, 2 AS df, round(exp(-stat / 2), 6) AS p_value FROM (
  SELECT (z0 * z0 * v11 - 2 * z0 * z1 * v01 + z1 * z1 * v00) / (v00 * v11 - v01 * v01) AS stat FROM (
    SELECT sum(d0 - n0 * d / n) AS z0, sum(d1 - n1 * d / n) AS z1, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * n0 / n * (1 - n0 / n) ELSE 0 END) AS v00,
      sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * n1 / n * (1 - n1 / n) ELSE 0 END) AS v11, sum(CASE WHEN n > 1 THEN -d * (n - d) / (n - 1) * n0 / n * n1 / n ELSE 0 END) AS v01 FROM lr))""")
def logrank_multi(spark, sf):
    return rounded(survival.logrank(surv_seg(spark, sf).where("segment <> 'One-Timer'"), "segment", _TIERS3))


def _pair_sql(i, j):
    d, n, s = f"(d{i} + d{j})", f"(n{i} + n{j})", f"(n{i} / (n{i} + n{j}))"
    return f"""SELECT '{_TIERS3[i]}' AS group_a, '{_TIERS3[j]}' AS group_b, z * z / v AS stat FROM (SELECT sum(CASE WHEN {n} > 0 THEN d{i} - {d} * {s} END) AS z,
      sum(CASE WHEN {n} > 1 THEN {d} * ({n} - {d}) / ({n} - 1) * {s} * (1 - {s}) ELSE 0 END) AS v FROM lr)"""


@query("k11_logrank_pairwise", f"""SELECT group_a, group_b, round(stat, 6) AS statistic, round(p, 4) AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance
  FROM (SELECT *, 2 * (1 - ({sql_norm_cdf('sqrt(stat)')})) AS p FROM ({_pair_sql(0, 1)} UNION ALL {_pair_sql(0, 2)} UNION ALL {_pair_sql(1, 2)}))""")
def logrank_pairwise(spark, sf):
    return rounded(survival.logrank_pairs(surv_seg(spark, sf).where("segment <> 'One-Timer'"), "segment", _TIERS3), p_value=4)


# Censoring-aware evaluation: train and test are halves by a key hash both engines share.

CTES["risked"] = "SELECT surv.*, frequency, greatest(duration, 1) AS dur, -CAST(frequency AS DOUBLE) AS risk, CASE WHEN surv.customer_id % 2 = 0 THEN 'train' ELSE 'test' END AS part FROM surv JOIN summary USING (customer_id)"
CTES["train"] = "SELECT * FROM risked WHERE part = 'train'"
CTES["test"] = "SELECT * FROM risked WHERE part = 'test'"


def risked(spark, sf):
    tx = lines(spark, sf)
    end = features.observation_end(tx)
    freq = tx.groupBy("customer_id").agg((F.count_distinct("invoice") - 1).alias("frequency"))
    out = survival.dataset(tx, end).join(freq, "customer_id").withColumn("risk", -F.col("frequency").cast("double"))
    return checkpointed(out.withColumn("part", F.when(F.col("customer_id") % 2 == 0, "train").otherwise("test")))


def parts(spark, sf):
    both = risked(spark, sf)
    return both.where("part = 'train'"), both.where("part = 'test'")


def _c_sql(src, w="1.0::DOUBLE"):
    return f"""SELECT sum(CASE WHEN ri > rj THEN w ELSE 0 END) AS concordant, sum(CASE WHEN ri = rj THEN w ELSE 0 END) AS tied, sum(w) AS comparable FROM (
      SELECT i.risk AS ri, j.risk AS rj, i.w AS w FROM (SELECT *, {w} AS w FROM {src} WHERE event_observed = 1) i JOIN {src} j
      ON j.duration > i.duration OR (j.duration = i.duration AND j.event_observed = 0))"""


@query("k17_concordance", f"SELECT concordant, tied, comparable, round((concordant + tied / 2) / comparable, 6) AS c_index FROM ({_c_sql('risked')})")
def concordance(spark, sf):
    return rounded(metrics.cindex(risked(spark, sf)))


@query("k24_eval_times", """SELECT CAST(range AS INTEGER) AS t FROM range(30, 700, 30), (SELECT quantile_cont(duration, 0.05) AS lo, quantile_cont(duration, 0.95) AS hi FROM risked WHERE event_observed = 1) WHERE range >= lo AND range <= hi""")
def eval_times(spark, sf):
    return metrics.eval_times(risked(spark, sf))


CTES["cens_days"] = "SELECT duration AS t, CAST(sum(1 - event_observed) AS BIGINT) AS events, CAST(sum(event_observed) AS BIGINT) AS censored FROM train GROUP BY 1"
CTES["cens"] = """SELECT *, CASE WHEN max(CAST(events = at_risk AS INTEGER)) OVER (ORDER BY t) = 1 THEN 0 ELSE coalesce(exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER (ORDER BY t)), 1) END AS s
  FROM (SELECT *, CAST(sum(events + censored) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM cens_days)"""
CTES["test_g"] = "SELECT test.*, coalesce((SELECT arg_max(s, t) FROM cens WHERE t <= test.duration), 1) AS g FROM test"


@query("k25_censoring_km", "SELECT t, events, censored, at_risk, round(s, 6) AS s FROM cens")
def censoring_km(spark, sf):
    return rounded(metrics.censor_curve(parts(spark, sf)[0]))


@query("k26_cindex_ipcw", f"SELECT round((concordant + tied / 2) / comparable, 6) AS c_index FROM ({_c_sql('test_g', 'CASE WHEN g > 0 THEN 1 / (g * g) ELSE 0 END')})")
def cindex_ipcw(spark, sf):
    return rounded(metrics.cindex_ipcw(*parts(spark, sf)).select("c_index"))


_TIMES = (90, 180, 360, 540)
CTES["td"] = " UNION ALL ".join(f"""SELECT {t} AS t, sum(i.w * CASE WHEN i.risk > j.risk THEN 1.0::DOUBLE WHEN i.risk = j.risk THEN 0.5 ELSE 0 END) / sum(i.w) AS auc
  FROM (SELECT risk, CASE WHEN g > 0 THEN 1 / g ELSE 0 END AS w FROM test_g WHERE event_observed = 1 AND duration <= {t}) i, (SELECT risk FROM test WHERE duration > {t}) j""" for t in _TIMES)


@query("k27_td_auc", "SELECT t, round(auc, 6) AS auc FROM td")
def td_auc(spark, sf):
    return rounded(metrics.td_auc(*parts(spark, sf), _TIMES))


CTES["km_test"] = """SELECT *, CASE WHEN max(CAST(events = at_risk AS INTEGER)) OVER (ORDER BY t) = 1 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER (ORDER BY t)) END AS s
  FROM (SELECT *, CAST(sum(events + censored) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM (SELECT duration AS t, CAST(sum(event_observed) AS BIGINT) AS events, CAST(sum(1 - event_observed) AS BIGINT) AS censored FROM test GROUP BY 1))"""


@query("k27b_mean_td_auc", "SELECT round(sum(auc * d) / sum(d), 6) AS mean_auc FROM (SELECT auc, coalesce(lag(s) OVER (ORDER BY t), 1) - s AS d FROM (SELECT td.t, auc, (SELECT coalesce(arg_max(s, t), 1) FROM km_test WHERE t <= td.t) AS s FROM td))")
def mean_td_auc(spark, sf):
    train, test = parts(spark, sf)
    return rounded(metrics.mean_td_auc(metrics.td_auc(train, test, _TIMES), test))


def _brier_sql(t):
    s = f"exp(-{t} / (300.0::DOUBLE + 100 * frequency))"
    return f"""SELECT {t} AS t, avg(CASE WHEN duration <= {t} AND event_observed = 1 THEN CASE WHEN g > 0 THEN {s} * {s} / g ELSE 0 END
      WHEN duration > {t} THEN (1 - {s}) * (1 - {s}) / (SELECT coalesce(arg_max(s, t), 1) FROM cens WHERE t <= {t}) ELSE 0 END) AS brier FROM test_g"""


CTES["brier_t"] = " UNION ALL ".join(_brier_sql(t) for t in _TIMES)


def brier_scores(spark, sf):
    train, test = parts(spark, sf)
    curves = test.withColumns({f"s_{t}": F.exp(-F.lit(float(t)) / (300.0 + 100 * F.col("frequency"))) for t in _TIMES})
    return metrics.brier(train, curves, _TIMES)


@query("k28_brier_ipcw", "SELECT t, round(brier, 6) AS brier FROM brier_t")
def brier_ipcw(spark, sf):
    return rounded(brier_scores(spark, sf))


@query("k29_ibs", "SELECT round(sum((t2 - t) * (b2 + brier) / 2.0) / (max(t) - min(t)), 6) AS ibs FROM (SELECT *, lead(t) OVER (ORDER BY t) AS t2, lead(brier) OVER (ORDER BY t) AS b2 FROM brier_t)")
def ibs(spark, sf):
    return rounded(metrics.ibs(brier_scores(spark, sf)))


# Classification and regression metrics ----------------------------------------------------------

# The score is a ratio both engines compute alike; the label is the churn flag.
CTES["scored"] = "SELECT customer_id, recency / greatest(age_days, 1) AS score, CAST(recency > 45 AS INTEGER) AS label, frequency, total_spend FROM summary"
CTES["steps"] = """SELECT score, n, pos, sum(n) OVER (ORDER BY score DESC) AS cum_n, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, (SELECT count(*) FROM scored) AS total, (SELECT sum(label) FROM scored) AS total_pos
  FROM (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY 1)"""


def scored(spark, sf):
    return checkpointed(summary(spark, sf).select(
        "customer_id", S.safe_ratio("recency", "T").alias("score"), (F.col("recency") > 45).cast("int").alias("label"),
        "frequency", "total_spend"))


@query("m06_roc", "SELECT score AS threshold, round((cum_n - cum_pos) / (total - total_pos), 9) AS fpr, round(cum_pos / total_pos, 9) AS tpr FROM steps")
def roc(spark, sf):
    return metrics.roc(scored(spark, sf)).withColumns({c: F.round(c, 9) for c in ("fpr", "tpr")})


@query("m06b_auc", "SELECT round(sum((n - pos) * (cum_pos - pos + pos / 2.0::DOUBLE)) / max(total_pos * (total - total_pos)), 6) AS auc FROM steps")
def auc(spark, sf):
    return rounded(metrics.auc(scored(spark, sf)))


@query("m07_pr", "SELECT score AS threshold, round(cum_pos / cum_n, 9) AS precision, round(cum_pos / total_pos, 9) AS recall FROM steps")
def pr(spark, sf):
    return metrics.pr(scored(spark, sf)).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query("m07b_average_precision", "SELECT round(sum(pos / total_pos * cum_pos / cum_n), 6) AS average_precision FROM steps")
def average_precision(spark, sf):
    return rounded(metrics.average_precision(scored(spark, sf)))


@query("m08_class_metrics", """SELECT tp, fp, fn, tn, round(brier, 6) AS brier, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy
  FROM (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.3) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.3) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.3) AS fn,
  count(*) FILTER (WHERE label = 0 AND score < 0.3) AS tn, avg((score - label) * (score - label)) AS brier FROM scored)""")
def class_metrics(spark, sf):
    return rounded(metrics.classification(scored(spark, sf), threshold=0.3))


@query("m09_regression_metrics", "SELECT round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(1 - sum((a - b) * (a - b)) / (var_pop(a) * count(*)), 6) AS r2, round(corr(a, b), 6) AS pearson FROM pair")
def regression_metrics(spark, sf):
    return rounded(metrics.regression(agreement_input(spark, sf), "a", "b"))


@query("m10_spearman", f"SELECT round(corr(ra, rb), 6) AS spearman FROM {_RANKED.format(a='a', b='b', src='pair')}")
def spearman(spark, sf):
    return rounded(metrics.spearman(agreement_input(spark, sf), "a", "b"))


@query("m11_ks_2samp", "SELECT round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM ks_out")
def ks_2samp(spark, sf):
    return rounded(metrics.ks(agreement_input(spark, sf), "a", "b"))


CTES["edges"] = "SELECT " + ", ".join(f"quantile_cont(score, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM scored"


@query("m12_calibration_bins", "SELECT " + " + ".join(f"CAST(score > e{i} AS INTEGER)" for i in range(1, 10)) + " AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed FROM scored, edges GROUP BY 1")
def calibration_bins(spark, sf):
    return rounded(metrics.calibration(scored(spark, sf)))


@query("m13_gains_lift", "SELECT score AS threshold, round(cum_n / total, 9) AS share, round(cum_pos / total_pos, 9) AS gain, round(cum_pos / total_pos / (cum_n / total), 9) AS lift FROM steps")
def gains_lift(spark, sf):
    return metrics.gains_lift(scored(spark, sf)).withColumns({c: F.round(c, 9) for c in ("share", "gain", "lift")})


@query("m14_youden", "SELECT score AS threshold, round(j, 6) AS j FROM (SELECT score, round(cum_pos / total_pos - (cum_n - cum_pos) / (total - total_pos), 12) AS j FROM steps) ORDER BY j DESC, score DESC LIMIT 1")
def youden(spark, sf):
    return metrics.youden(scored(spark, sf)).withColumn("j", F.round("j", 6))


_CAT = "CASE WHEN label = 1 AND score >= 0.3 THEN 'True Positive' WHEN label = 0 AND score < 0.3 THEN 'True Negative' WHEN label = 1 THEN 'False Negative' ELSE 'False Positive' END"


@query("m15_error_categories", f"SELECT {_CAT} AS category, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(frequency), 6) AS frequency, round(avg(total_spend), 3) AS total_spend FROM scored GROUP BY 1")
def error_categories(spark, sf):
    cats = metrics.error_categories(scored(spark, sf), "score", "label", 0.3)
    return rounded(metrics.error_profile(cats, "score", ["frequency", "total_spend"]), total_spend=3)


@query("m15b_confident_errors", f"""(SELECT customer_id, category, score FROM (SELECT *, {_CAT} AS category FROM scored) WHERE category = 'False Negative' ORDER BY score, customer_id LIMIT 20)
  UNION ALL (SELECT customer_id, category, score FROM (SELECT *, {_CAT} AS category FROM scored) WHERE category = 'False Positive' ORDER BY score DESC, customer_id LIMIT 20)""")
def confident_errors(spark, sf):
    cats = metrics.error_categories(scored(spark, sf), "score", "label", 0.3)
    return metrics.confident_errors(cats, "score", "customer_id").select("customer_id", "category", "score")


# Value predictions: two closed-form forecasts of the holdout spend that need no fitting.

CTES["valued"] = """SELECT truth.customer_id, actual_clv_6m, returned, frequency, recency, total_spend / num_invoices AS pred_mean, coalesce(monetary_last_6m, 0) AS pred_last
  FROM truth JOIN clv_base USING (customer_id) LEFT JOIN windowed USING (customer_id)"""


def valued(spark, sf):
    tx = lines(spark, sf)
    train, holdout = labels.cutoff_split(tx)
    cutoff = labels.cutoff_date(tx)
    base = features.clv_base(train, cutoff).select("customer_id", "frequency", "recency", F.col("avg_spend_per_transaction").alias("pred_mean"))
    recent = features.windowed(train, cutoff).select("customer_id", F.col("monetary_last_6m").alias("pred_last"))
    return checkpointed(metrics.attach_predictions(
        features.with_labels(base, labels.ground_truth(train, holdout)), recent, ["pred_last"]))


_PREDS = {"mean_basket": "pred_mean", "last_half_year": "pred_last"}


@query("c07_prediction_join", "SELECT customer_id, frequency, recency, pred_mean, actual_clv_6m, returned, pred_last FROM valued")
def prediction_join(spark, sf):
    return valued(spark, sf)


def _clv_sql(m, p):
    return f"""SELECT '{m}' AS model, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, p), 6) AS pearson,
      round(avg(abs(y - p)) FILTER (WHERE y = 0), 4) AS mae_churned, round(avg(p) FILTER (WHERE y = 0), 4) AS mean_pred_churned, round(avg(abs(y - p)) FILTER (WHERE y > 0), 4) AS mae_returned,
      round(avg(CAST(p < 1 AS INTEGER)) FILTER (WHERE y = 0) * 100, 6) AS churn_detection_pct, round(corr(ra, rb), 6) AS spearman FROM {_RANKED.format(a='y', b='p', src=f'(SELECT actual_clv_6m AS y, {p} AS p FROM valued)')}"""


@query("m16_clv_comparison", " UNION ALL ".join(_clv_sql(m, p) for m, p in _PREDS.items()))
def clv_comparison(spark, sf):
    return rounded(metrics.clv_table(valued(spark, sf), "actual_clv_6m", _PREDS), mae=4, rmse=4, mae_churned=4, mean_pred_churned=4, mae_returned=4)


_ERR = ", ".join(f"round(avg(abs(actual_clv_6m - {c})), 4) AS mae_{m}, round(sqrt(avg((actual_clv_6m - {c}) * (actual_clv_6m - {c}))), 4) AS rmse_{m}" for m, c in _PREDS.items())


@query("d23_segment_error_pivot", f"SELECT {sql_bins('frequency', *FREQUENCY_BINS)} AS freq_bin, count(*) AS n, round(avg(CAST(actual_clv_6m = 0 AS INTEGER)) * 100, 6) AS churn_pct, round(avg(actual_clv_6m), 4) AS avg_actual, {_ERR} FROM valued GROUP BY 1")
def segment_error_pivot(spark, sf):
    binned = valued(spark, sf).withColumn("freq_bin", S.bin_right_closed("frequency", *FREQUENCY_BINS))
    return rounded(report.errors_by(binned, "freq_bin", "actual_clv_6m", _PREDS), 4, churn_pct=6)


def _errors_sql(bin_name, bins, col, src):
    return (f"SELECT {sql_bins(col, *bins)} AS {bin_name}, count(*) AS n, round(avg(CAST(actual_clv_6m = 0 AS INTEGER)) * 100, 6) AS churn_pct, "
            f"round(avg(actual_clv_6m), 4) AS avg_actual, {_ERR} FROM {src} GROUP BY 1")


@query("d23b_recency_errors", _errors_sql("recency_bin", RECENCY_BINS, "recency", "valued"))
def recency_errors(spark, sf):
    binned = valued(spark, sf).withColumn("recency_bin", S.bin_right_closed("recency", *RECENCY_BINS))
    return rounded(report.errors_by(binned, "recency_bin", "actual_clv_6m", _PREDS), 4, churn_pct=6)


CTES["train_cv"] = """SELECT customer_id, round(coalesce(stddev_samp(revenue) / greatest(avg(revenue), 1), 0), 9) AS spend_cv
  FROM (SELECT customer_id, invoice, CAST(sum(CAST(line_total AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM tx, cut WHERE invoice_date <= cutoff GROUP BY 1, 2) GROUP BY 1"""


@query("d23c_variability_errors", _errors_sql("cv_bin", CV_BINS, "spend_cv", "(SELECT * FROM valued JOIN train_cv USING (customer_id))"))
def variability_errors(spark, sf):
    train, _ = labels.cutoff_split(lines(spark, sf))
    spread = features.spend_cv(features.invoices(train)).select("customer_id", F.round("spend_cv", 9).alias("spend_cv"))
    binned = valued(spark, sf).join(spread, "customer_id").withColumn("cv_bin", S.bin_right_closed("spend_cv", *CV_BINS))
    return rounded(report.errors_by(binned, "cv_bin", "actual_clv_6m", _PREDS), 4, churn_pct=6)


@query("m17_error_distribution", """SELECT outcome, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, round(quantile_cont(value, 0.95), 4) AS q95
  FROM (SELECT CASE WHEN actual_clv_6m = 0 THEN 'churned' ELSE 'returned' END AS outcome, CASE WHEN actual_clv_6m = 0 THEN pred_last ELSE greatest(-1000, least(1000, pred_last - actual_clv_6m)) END AS value FROM valued) GROUP BY 1""")
def error_distribution(spark, sf):
    return rounded(metrics.error_spread(valued(spark, sf), "actual_clv_6m", "pred_last"), 4)


@query("m18_feature_distribution", """SELECT 'recency' AS feature, label, CAST(bin AS DOUBLE) AS bin, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM (
  SELECT CAST(recency > 45 AS INTEGER) AS label, CAST(least(29, floor((recency - lo) * 30 / CAST(hi - lo AS DOUBLE))) + 1 AS INTEGER) AS bin, count(*) AS n FROM summary, (SELECT min(recency) AS lo, max(recency) AS hi FROM summary) GROUP BY 1, 2)
  UNION ALL SELECT 'is_one_timer', label, CAST(v AS DOUBLE), n, round(n / sum(n) OVER (PARTITION BY label), 6) FROM (SELECT CAST(recency > 45 AS INTEGER) AS label, CAST(frequency = 0 AS INTEGER) AS v, count(*) AS n FROM summary GROUP BY 1, 2)""")
def feature_distribution(spark, sf):
    base = summary(spark, sf).withColumns({"label": (F.col("recency") > 45).cast("int"), "is_one_timer": (F.col("frequency") == 0).cast("int")})
    return rounded(metrics.feature_distribution(base, ["recency", "is_one_timer"], "label"))
