"""Scans, filters, scalar functions, joins, aggregates, windows and set operations."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from tenure.functions import scalars as S
from tenure.operators import clean, features, labels, ordered, report
from tenure.plans.base import (
    CTES, GROUPS, HOME, PATTERNS, capped, dates, first_lines, gap_table, invoices, lines, query, raw,
    rounded, summary, table,
)
from tenure.sources import transactions as io

MONEY = "CAST(sum(CAST(line_total AS DECIMAL(18,4))) AS DOUBLE)"


def scratch(spark, name):
    """Folder for a round trip: next to the checkpoints, or local on a local master."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tenure-")
    stamp = Path(tempfile.mktemp(prefix=f"{name}-")).name
    return f"{base.rstrip('/')}/{stamp}"


# Scans and sinks --------------------------------------------------------------

RAW_COLS = "invoice, stock_code, description, quantity, invoice_date, price, customer_id, country"


def _retail(df):
    names = {v: k for k, v in io.COLUMN_NAMES.items()}
    return df.withColumn("customer_id", F.col("customer_id").cast("double")).withColumnsRenamed(names)


@query("a01_scan_csv", f"SELECT {RAW_COLS} FROM tx_raw")
def scan_csv(spark, sf):
    path = scratch(spark, "lines-csv")
    io.write_csv(_retail(raw(spark, sf)), path)
    out = clean.cast_key(io.standard_names(io.read_transactions_csv(spark, path)))
    return out.withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz"))


@query("a02_scan_parquet", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def scan_parquet(spark, sf):
    return io.read_parquet(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")


METRICS_SQL = """
SELECT (SELECT count(*) FROM summary) AS n_customers, (SELECT sum(num_invoices)::BIGINT FROM summary) AS n_invoices,
       (SELECT avg(recency) FROM summary) AS mean_recency, (SELECT max(age_days) FROM summary) AS max_age"""


def _metrics(spark, sf):
    flat = summary(spark, sf).agg(
        F.count("*").alias("n_customers"), F.sum("num_invoices").alias("n_invoices"),
        F.avg("recency").alias("mean_recency"), F.max("T").alias("max_age"))
    return io.nest_metrics(flat, counts=["n_customers", "n_invoices"], times=["mean_recency", "max_age"])


@query("a03_scan_json_metrics", f"SELECT n_customers, n_invoices, round(mean_recency, 6) AS mean_recency, max_age FROM ({METRICS_SQL})")
def scan_json(spark, sf):
    path = scratch(spark, "metrics-json")
    nested = _metrics(spark, sf)
    io.write_metrics(nested, path)
    return rounded(io.read_metrics(spark, path, nested.schema).select("counts.*", "times.*"))


@query("a04_sink_csv", "SELECT customer_id, num_invoices, total_spend FROM summary")
def sink_csv(spark, sf):
    path = scratch(spark, "summary-csv")
    out = summary(spark, sf).select("customer_id", "num_invoices", "total_spend")
    io.write_csv(out, path)
    return spark.read.schema(out.schema).csv(path, header=True)


@query("a05_sink_parquet", "SELECT customer_id, invoice, revenue, quantity FROM inv")
def sink_parquet(spark, sf):
    path = scratch(spark, "invoices")
    io.write_parquet(invoices(spark, sf).select("customer_id", "invoice", "revenue", "quantity"), path)
    return io.read_parquet(spark, path)


@query("a06_sink_json_metrics", f"SELECT n_customers, n_invoices, round(mean_recency, 6) AS mean_recency, max_age FROM ({METRICS_SQL})")
def sink_json(spark, sf):
    path = scratch(spark, "report-json")
    nested = _metrics(spark, sf)
    io.write_metrics(nested, path)
    text = spark.read.text(path)
    return rounded(text.select(F.from_json("value", nested.schema).alias("m")).select("m.counts.*", "m.times.*"))


@query("a07_parse_ts", "SELECT invoice, invoice_date AS ts FROM tx_raw")
def parse_ts(spark, sf):
    text = raw(spark, sf).select("invoice", F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return text.select("invoice", S.parse_ts("t", "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("ts"))


# Filters and projections --------------------------------------------------------

LINE = "invoice, stock_code, quantity, customer_id"
LINE_COLS = ["invoice", "stock_code", "quantity", "customer_id"]


@query("b01_drop_null_key", f"SELECT {LINE} FROM tx_raw WHERE customer_id IS NOT NULL")
def drop_null_key(spark, sf):
    return clean.drop_null_key(raw(spark, sf)).select(*LINE_COLS)


@query("b02_cast_key", f"SELECT {LINE} FROM tx_raw")
def cast_key(spark, sf):
    as_float = raw(spark, sf).withColumn("customer_id", F.col("customer_id").cast("double"))
    return clean.cast_key(as_float).select(*LINE_COLS)


@query("b03_drop_cancelled", f"SELECT {LINE} FROM tx_raw WHERE NOT starts_with(invoice, 'C')")
def drop_cancelled(spark, sf):
    return clean.drop_cancelled(raw(spark, sf)).select(*LINE_COLS)


@query("b04_positive_lines", f"SELECT {LINE} FROM tx_raw WHERE quantity > 0 AND price > 0")
def positive_lines(spark, sf):
    return clean.positive_lines(raw(spark, sf)).select(*LINE_COLS)


@query("b05_dedup_exact", f"SELECT {LINE} FROM (SELECT DISTINCT * FROM tx_raw)")
def dedup_exact(spark, sf):
    return clean.dedup(raw(spark, sf)).select(*LINE_COLS)


@query("b06_line_total", f"SELECT {LINE}, round(quantity * price, 4) AS line_total FROM tx_raw")
def line_total(spark, sf):
    return rounded(clean.line_total(raw(spark, sf)).select(*LINE_COLS, "line_total"), 4)


@query("b07_quantile_cap", f"SELECT {LINE}, round(line_total, 4) AS line_total FROM tx_cap")
def quantile_cap(spark, sf):
    return rounded(clean.quantile_cap(lines(spark, sf)).select(*LINE_COLS, "line_total"), 4)


CTES["iqr1"] = """
SELECT tx.* FROM tx, (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM tx)
WHERE quantity >= q1 - 1.5 * (q3 - q1) AND quantity <= q3 + 1.5 * (q3 - q1)"""
CTES["iqr2"] = """
SELECT iqr1.* FROM iqr1, (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM iqr1)
WHERE price >= q1 - 1.5 * (q3 - q1) AND price <= q3 + 1.5 * (q3 - q1)"""


@query("b08_iqr_fence", f"SELECT {LINE} FROM iqr2")
def iqr_fence(spark, sf):
    return clean.iqr_fence(lines(spark, sf)).select(*LINE_COLS)


@query("b09_clean", "SELECT * FROM tx_cap")
def clean_all(spark, sf):
    return capped(spark, sf)


@query("b10_project_rename", "SELECT customer_id, frequency AS repeat_purchases, age_days AS age, recency FROM summary")
def project_rename(spark, sf):
    out = summary(spark, sf).drop("first_purchase", "last_purchase")
    return out.withColumnsRenamed({"frequency": "repeat_purchases", "T": "age"}).select(
        "customer_id", "repeat_purchases", "age", "recency")


@query("b11_clip", """SELECT customer_id, greatest(least(recency, 365), 30) AS recency_clipped,
  greatest(age_days, 1) AS age_floor FROM summary""")
def clip(spark, sf):
    return summary(spark, sf).select("customer_id", S.clip("recency", 30, 365).alias("recency_clipped"),
                                     S.clip("T", lo=1).alias("age_floor"))


@query("b12_case_when", """SELECT customer_id, CASE WHEN num_invoices > 1 THEN 'repeat'
  WHEN age_days >= 90 THEN 'lost' ELSE 'open' END AS status FROM summary""")
def case_when(spark, sf):
    return summary(spark, sf).select("customer_id", F.when(F.col("num_invoices") > 1, "repeat")
                                     .when(F.col("T") >= 90, "lost").otherwise("open").alias("status"))


def sql_bins(col, edges, names):
    whens = " ".join(f"WHEN {col} > {lo} THEN '{n}'" if hi == float("inf") else f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{n}'"
                     for lo, hi, n in zip(edges, edges[1:], names))
    return f"CASE {whens} END"


from tenure.constants import (  # noqa: E402
    BUCKET_BINS, CHURN_WINDOWS, CV_BINS, FREQUENCY_BINS, GAP_PERCENTILES, RECENCY_BINS,
)


@query("b13_bin_labels", f"""SELECT customer_id, {sql_bins('frequency', *FREQUENCY_BINS)} AS freq_bin,
  {sql_bins('recency', *RECENCY_BINS)} AS recency_bin FROM summary""")
def bin_labels(spark, sf):
    return summary(spark, sf).select("customer_id", S.bin_right_closed("frequency", *FREQUENCY_BINS).alias("freq_bin"),
                                     S.bin_right_closed("recency", *RECENCY_BINS).alias("recency_bin"))


@query("b14_bin_equal_width", """SELECT customer_id, CAST(least(10, greatest(1, ceil((age_days - lo) / ((hi - lo) / 10.0::DOUBLE)))) AS INTEGER) AS bin
  FROM summary, (SELECT min(age_days) AS lo, max(age_days) AS hi FROM summary)""")
def bin_equal_width(spark, sf):
    return features.bin_equal_width(summary(spark, sf), "T", 10).select("customer_id", "bin")


@query("b15_histogram", """SELECT CAST(least(49, floor((least(revenue, q) - lo) * 50 / (q - lo))) + 1 AS INTEGER) AS bin, count(*) AS n
  FROM inv, (SELECT min(revenue) AS lo, quantile_cont(revenue, 0.95) AS q FROM inv) GROUP BY 1""")
def histogram(spark, sf):
    return features.histogram(invoices(spark, sf), "revenue", 50, clip_quantile=0.95)


@query("b16_in_set", f"""SELECT invoice, stock_code, country IN {GROUPS['Europe_Major']} AS in_group FROM tx
  WHERE month(invoice_date) IN (11, 12)""")
def in_set(spark, sf):
    return lines(spark, sf).where(F.month("invoice_date").isin(11, 12)).select(
        "invoice", "stock_code", F.col("country").isin(*GROUPS["Europe_Major"]).alias("in_group"))


@query("b17_map_values", """SELECT customer_id, CASE churned WHEN 1 THEN 'Churned' WHEN 0 THEN 'Active/Censored' END AS status
  FROM (SELECT customer_id, CAST(recency > 45 AS INTEGER) AS churned FROM summary)""")
def map_values(spark, sf):
    from tenure.constants import STATUS
    churned = (F.col("recency") > 45).cast("int")
    return summary(spark, sf).select("customer_id", S.map_values(churned, STATUS).alias("status"))


@query("b18_one_hot_drop_first", "SELECT customer_id, " + ", ".join(
    f"CAST(max(CAST(country = 'NATION_{i}' AS INTEGER)) AS INTEGER) AS country_NATION_{i}" for i in sorted(range(25), key=str)[1:])
    + " FROM tx GROUP BY 1")
def one_hot(spark, sf):
    per = lines(spark, sf).groupBy("customer_id").agg(F.min("country").alias("country"))
    return S.one_hot(per, "country", "country").drop("country")


@query("b19_null_inf_policy", """SELECT customer_id, CASE WHEN age_days = 0 THEN 0 ELSE round(total_spend / age_days, 6) END AS spend_rate FROM summary""")
def null_inf(spark, sf):
    rate = F.when(F.col("T") == 0, F.lit(float("inf"))).otherwise(F.col("total_spend") / F.col("T"))
    out = summary(spark, sf).select("customer_id", rate.alias("spend_rate"))
    return rounded(clean.finite_cols(out, ["spend_rate"]))


FLAG_SQL = ", ".join(f"CAST(regexp_matches(upper(description), '{p}') AS INTEGER) AS {n}" for n, p in PATTERNS.items())


@query("b20_string_features", f"SELECT invoice, stock_code, {FLAG_SQL}, split_part(trim(upper(description)), ' ', 1) AS first_word FROM tx")
def string_features(spark, sf):
    return lines(spark, sf).select(
        "invoice", "stock_code", *[S.matches("description", p).cast("int").alias(n) for n, p in PATTERNS.items()],
        S.first_token("description").alias("first_word"))


PARTS_SQL = """CAST(hour({t}) AS INTEGER) AS {p}hour, CAST(isodow({t}) - 1 AS INTEGER) AS {p}day_of_week,
  CAST(isodow({t}) >= 6 AS INTEGER) AS {p}is_weekend, CAST(month({t}) AS INTEGER) AS {p}month,
  CAST(month({t}) IN (11, 12) AS INTEGER) AS {p}is_holiday_season"""


@query("b21_date_parts", "SELECT customer_id, invoice, " + PARTS_SQL.format(t="ts", p="") + " FROM inv")
def date_parts(spark, sf):
    return dates(spark, sf).select("customer_id", "invoice", *[c.alias(n) for n, c in S.date_parts("ts").items()])


@query("b22_month_trunc", "SELECT customer_id, CAST(date_trunc('month', first_purchase) AS DATE) AS cohort_month FROM summary")
def month_trunc(spark, sf):
    return summary(spark, sf).select("customer_id", S.month_of("first_purchase").cast("date").alias("cohort_month"))


@query("b23_date_arith", """SELECT customer_id, recency AS idle_days, obs_end - INTERVAL 6 MONTH AS cutoff,
  last_purchase + INTERVAL 45 DAY AS due_date, first_purchase - INTERVAL 7 DAY AS week_before FROM summary""")
def date_arith(spark, sf):
    tx = lines(spark, sf)
    end = features.observation_end(tx)
    return features.customer_summary(tx, end).select(
        "customer_id", F.col("recency").alias("idle_days"), S.minus_months(end, 6).alias("cutoff"),
        S.shift_days("last_purchase", 45).alias("due_date"), S.shift_days("first_purchase", -7).alias("week_before"))


@query("b24_math_scalars", """SELECT customer_id, round(ln(total_spend), 6) AS ln_spend, round(ln(1 + total_spend), 6) AS log1p_spend,
  round(exp(-recency / 365.0::DOUBLE), 6) AS decay, round(sqrt(total_spend), 6) AS sqrt_spend, abs(recency - age_days) AS span_days,
  round(pow(1.01::DOUBLE, frequency), 6) AS growth FROM summary""")
def math_scalars(spark, sf):
    return rounded(summary(spark, sf).select(
        "customer_id", F.ln("total_spend").alias("ln_spend"), F.log1p("total_spend").alias("log1p_spend"),
        F.exp(-F.col("recency") / 365.0).alias("decay"), F.sqrt("total_spend").alias("sqrt_spend"),
        F.abs(F.col("recency") - F.col("T")).alias("span_days"), F.pow(F.lit(1.01), F.col("frequency")).alias("growth")))


@query("b25_safe_ratio", """SELECT customer_id, round(recency / greatest(age_days, 1), 6) AS recency_ratio,
  round(CASE WHEN frequency > 0 THEN age_days / frequency ELSE 0 END, 6) AS days_per_repeat FROM summary""")
def safe_ratio(spark, sf):
    return rounded(summary(spark, sf).select("customer_id", S.safe_ratio("recency", "T").alias("recency_ratio"),
                                             S.ratio_or("T", "frequency", 0.0).alias("days_per_repeat")))


ERFC_T = "(1.0::DOUBLE / (1.0 + 0.5 * abs({z}) / sqrt(2.0::DOUBLE)))"


def sql_norm_cdf(z):
    """The same rational approximation as SQL."""
    t = ERFC_T.format(z=z)
    poly = "0.17087277::DOUBLE"
    for c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806",
              "0.09678418", "0.37409196", "1.00002368", "-1.26551223"):
        poly = f"({c}::DOUBLE + {t} * {poly})"
    erfc = f"({t} * exp(-({z}) * ({z}) / 2.0::DOUBLE + {poly}))"
    return f"CASE WHEN {z} >= 0 THEN 1 - 0.5 * {erfc} ELSE 0.5 * {erfc} END"


@query("b26_normal_cdf", f"""SELECT customer_id, round({sql_norm_cdf('z')}, 6) AS phi
  FROM (SELECT customer_id, (ln(total_spend) - 10.0::DOUBLE) / 1.5 AS z FROM summary)""")
def normal_cdf(spark, sf):
    return rounded(summary(spark, sf).select("customer_id", S.norm_cdf((F.ln("total_spend") - 10.0) / 1.5).alias("phi")))


@query("b27_linear_interp", """
, curve AS (SELECT frequency AS x, avg(total_spend) AS y FROM summary GROUP BY 1),
seg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM curve)
SELECT customer_id, round(CASE WHEN q >= (SELECT max(x) FROM curve) THEN (SELECT arg_max(y, x) FROM curve)
    WHEN q < (SELECT min(x) FROM curve) THEN (SELECT arg_min(y, x) FROM curve)
    ELSE y0 + (y1 - y0) * ((q - x0) / (x1 - x0)) END, 4) AS spend_at
FROM (SELECT customer_id, age_days / 180.0::DOUBLE AS q FROM summary) LEFT JOIN seg ON q >= x0 AND q < x1""")
def linear_interp(spark, sf):
    base = summary(spark, sf)
    # one point per purchase count, a table of any size
    points = base.groupBy("frequency").agg(F.avg("total_spend").alias("y"))
    out = ordered.interp_table(base.select("customer_id", (F.col("T") / 180.0).alias("q")), "q", points, "frequency", "y", "spend_at")
    return rounded(out.drop("q"), 4)


# Joins ------------------------------------------------------------------------


@query("c01_left_join_fill0", """SELECT customer_id, num_invoices, round(coalesce(avg_gap, 0), 6) AS avg_gap,
  coalesce(last_gap, 0) AS last_gap FROM summary LEFT JOIN gap_stats USING (customer_id)""")
def left_join_fill0(spark, sf):
    tx = lines(spark, sf)
    stats = features.gap_stats(features.gaps(features.invoice_dates(tx)))
    base = features.customer_summary(tx, features.observation_end(tx)).select("customer_id", "num_invoices")
    return rounded(features.left_fill(base, stats, "customer_id", ["avg_gap", "last_gap"]))


CTES["cut"] = "SELECT obs_end - INTERVAL 6 MONTH AS cutoff FROM obs"
CTES["truth"] = f"""
SELECT customer_id, coalesce(actual, 0) AS actual_clv_6m, CAST(coalesce(actual, 0) > 0 AS INTEGER) AS returned
FROM (SELECT DISTINCT customer_id FROM tx, cut WHERE invoice_date <= cutoff)
LEFT JOIN (SELECT customer_id, {MONEY} AS actual FROM tx, cut WHERE invoice_date > cutoff GROUP BY 1) USING (customer_id)"""


@query("c02_ground_truth_join", "SELECT * FROM truth")
def ground_truth_join(spark, sf):
    return labels.ground_truth(*labels.cutoff_split(lines(spark, sf)))


@query("c03_first_invoice_lines", "SELECT customer_id, invoice, stock_code, quantity FROM first_lines")
def first_invoice_lines(spark, sf):
    return first_lines(spark, sf).select("customer_id", "invoice", "stock_code", "quantity")


@query("c04_feature_assembly", f"""SELECT customer_id, count(stock_code) AS first_num_lines, round({MONEY}, 4) AS first_total_spend,
  round(CASE WHEN sum(line_total) = 0 THEN 1 ELSE sum(line_total * line_total) / (sum(line_total) * sum(line_total)) END, 6) AS first_spend_concentration,
  count(DISTINCT split_part(trim(upper(description)), ' ', 1)) AS first_desc_diversity FROM first_lines GROUP BY 1""")
def feature_assembly(spark, sf):
    first = first_lines(spark, sf)
    out = features.assemble(features.first_monetary(first), features.first_basket(first), features.herfindahl(first),
                            features.desc_diversity(first))
    return rounded(out.select("customer_id", "first_num_lines", "first_total_spend", "first_spend_concentration",
                              "first_desc_diversity"), first_total_spend=4)


CTES["cp"] = """
SELECT customer_id, min(ts) AS first_purchase_date, min(CASE WHEN rn = 2 THEN ts END) AS second_purchase_date, count(*) AS total_invoices
FROM (SELECT customer_id, ts, row_number() OVER (PARTITION BY customer_id ORDER BY ts, invoice) AS rn FROM inv) GROUP BY 1"""
CTES["conv"] = """
SELECT *, CASE WHEN total_invoices > 1 THEN 1 WHEN obs_days >= 90 THEN 0 ELSE -1 END AS label
FROM (SELECT cp.*, CAST(floor((epoch_us(obs_end) - epoch_us(first_purchase_date)) / 86400000000.0) AS INTEGER) AS obs_days,
  CAST(floor((epoch_us(second_purchase_date) - epoch_us(first_purchase_date)) / 86400000000.0) AS INTEGER) AS days_to_second FROM cp, obs)"""


def conversion_labels(spark, sf):
    tx = lines(spark, sf)
    cp = labels.first_second(features.invoice_dates(tx))
    return labels.conversion(cp, features.observation_end(tx))


@query("c05_label_join", "SELECT customer_id, count(*) AS first_num_lines, any_value(label) AS label FROM first_lines JOIN conv USING (customer_id) WHERE label >= 0 GROUP BY 1")
def label_join(spark, sf):
    first = features.first_basket(first_lines(spark, sf)).select("customer_id", "first_num_lines")
    labeled = conversion_labels(spark, sf).where("label >= 0").select("customer_id", "label")
    return features.with_labels(first, labeled)


@query("c09_index_align_assign", """SELECT customer_id, CASE WHEN frequency = 0 THEN 'One-Timer'
  WHEN recency > 365 THEN 'Dormant' ELSE 'Repeat' END AS segment FROM summary""")
def index_align(spark, sf):
    base = summary(spark, sf).select("customer_id", "frequency", "recency")
    seg = base.where("frequency > 0").select(
        "customer_id", F.when(F.col("recency") > 365, "Dormant").otherwise("Repeat").alias("segment"))
    out = features.update_from(base.withColumn("segment", F.lit("One-Timer")), seg, "customer_id", ["segment"])
    return out.select("customer_id", "segment")


# Aggregations -----------------------------------------------------------------


@query("d01_customer_summary", """SELECT customer_id, first_purchase, last_purchase, num_invoices, total_spend, total_quantity, unique_products,
  recency, age_days AS "T", frequency, avg_spend, avg_basket FROM summary""")
def customer_summary(spark, sf):
    return summary(spark, sf)


CTES["clv_base"] = f"""
SELECT *, CAST(floor((epoch_us(cutoff) - epoch_us(last_purchase)) / 86400000000.0) AS INTEGER) AS recency,
  CAST(floor((epoch_us(cutoff) - epoch_us(first_purchase)) / 86400000000.0) AS INTEGER) AS age_days, num_invoices - 1 AS frequency
FROM (SELECT customer_id, min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase, count(DISTINCT invoice) AS num_invoices,
  count(invoice) AS num_line_items, {MONEY} AS total_spend, CAST(sum(quantity) AS BIGINT) AS total_quantity,
  count(DISTINCT stock_code) AS unique_products, count(DISTINCT country) AS num_countries
  FROM tx, cut WHERE invoice_date <= cutoff GROUP BY 1), cut"""


@query("d02_clv_customer_features", """SELECT customer_id, num_invoices, num_line_items, total_spend, total_quantity, unique_products, num_countries,
  recency, age_days AS "T", frequency, total_spend / num_invoices AS avg_spend_per_transaction, total_quantity / num_invoices AS avg_basket_size,
  num_line_items / num_invoices AS avg_items_per_visit, recency / greatest(age_days, 1) AS recency_ratio FROM clv_base""")
def clv_customer_features(spark, sf):
    tx = lines(spark, sf)
    train, _ = labels.cutoff_split(tx)
    return features.clv_base(train, labels.cutoff_date(tx)).drop("first_purchase", "last_purchase")


def _window_sql(name, cond):
    return (f"count(DISTINCT CASE WHEN {cond} THEN invoice END) AS freq_{name}, "
            f"CAST(coalesce(sum(CASE WHEN {cond} THEN CAST(line_total AS DECIMAL(18,4)) END), 0) AS DOUBLE) AS monetary_{name}, "
            f"CAST(coalesce(sum(CASE WHEN {cond} THEN quantity END), 0) AS BIGINT) AS qty_{name}")


_M3, _M6 = "cutoff - INTERVAL 3 MONTH", "cutoff - INTERVAL 6 MONTH"
CTES["windowed"] = f"""
SELECT * EXCLUDE (qty_last_6m) FROM (SELECT customer_id, {_window_sql('last_3m', f'invoice_date > {_M3}')},
  {_window_sql('months_3_to_6', f'invoice_date > {_M6} AND invoice_date <= {_M3}')}, {_window_sql('last_6m', f'invoice_date > {_M6}')}
  FROM tx, cut WHERE invoice_date <= cutoff GROUP BY 1)"""


@query("d03_windowed_rfm", "SELECT * FROM windowed")
def windowed_rfm(spark, sf):
    tx = lines(spark, sf)
    train, _ = labels.cutoff_split(tx)
    return features.windowed(train, labels.cutoff_date(tx))


CTES["train_gap_stats"] = """
SELECT customer_id, avg(gap) AS avg_gap, coalesce(stddev_samp(gap), 0) AS std_gap, min(gap) AS min_gap, max(gap) AS max_gap, arg_max(gap, (ts, invoice)) AS last_gap
FROM (SELECT customer_id, ts, invoice, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, invoice))) / 86400000000.0) AS INTEGER) AS gap
  FROM (SELECT customer_id, invoice, min(invoice_date) AS ts FROM tx, cut WHERE invoice_date <= cutoff GROUP BY 1, 2)) WHERE gap IS NOT NULL GROUP BY 1"""


@query("d04_trend_features", """SELECT customer_id, round(monetary_last_3m / greatest(monetary_months_3_to_6, 1), 4) AS monetary_trend,
  round(freq_last_3m / greatest(freq_months_3_to_6, 1), 6) AS freq_trend, round(coalesce(last_gap / greatest(avg_gap, 1), 0), 6) AS gap_acceleration,
  CAST(frequency = 0 AS INTEGER) AS is_one_timer, min_gap, round(coalesce(avg_gap, 0), 6) AS avg_gap, round(coalesce(std_gap, 0), 6) AS std_gap
  FROM clv_base JOIN windowed USING (customer_id) LEFT JOIN train_gap_stats USING (customer_id)""")
def trend_features(spark, sf):
    tx = lines(spark, sf)
    train, _ = labels.cutoff_split(tx)
    out = features.clv_features(train, labels.cutoff_date(tx))
    return rounded(out.select("customer_id", "monetary_trend", "freq_trend", "gap_acceleration", "is_one_timer",
                              "min_gap", "avg_gap", "std_gap"), monetary_trend=4)


@query("d05_invoice_rollup", "SELECT * FROM inv")
def invoice_rollup(spark, sf):
    return invoices(spark, sf)


@query("d06_gap_stats", """SELECT customer_id, round(avg_gap, 6) AS avg_gap, round(std_gap, 6) AS std_gap, min_gap, max_gap, last_gap FROM gap_stats""")
def gap_stats(spark, sf):
    return rounded(features.gap_stats(gap_table(spark, sf)))


CTES["behave"] = """
SELECT *, CASE WHEN avg_spend > 0 THEN last_spend / avg_spend ELSE 1 END AS monetary_trend, last_gap - avg_gap AS gap_acceleration,
  CASE WHEN avg_gap > 0 THEN last_gap / avg_gap ELSE 0 END AS recency_ratio, ln(1 + total_spend) AS total_spend_log, ln(1 + avg_spend) AS avg_spend_log
FROM (SELECT s.*, total_spend / num_transactions AS avg_spend, total_qty / num_transactions AS avg_basket_size,
  coalesce(avg_gap, 0) AS avg_gap, coalesce(std_gap, 0) AS std_gap, coalesce(min_gap, 0) AS min_gap, coalesce(max_gap, 0) AS max_gap, coalesce(last_gap, 0) AS last_gap
  FROM (SELECT customer_id, count(*) AS num_transactions, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS total_spend,
    coalesce(stddev_samp(revenue), 0) AS std_spend, CAST(sum(quantity) AS BIGINT) AS total_qty, avg(n_items) AS avg_items_per_visit,
    arg_max(revenue, (ts, invoice)) AS last_spend FROM inv GROUP BY 1) s LEFT JOIN gap_stats USING (customer_id))"""
BEHAVE = ["num_transactions", "total_spend", "std_spend", "total_qty", "avg_items_per_visit", "last_spend", "avg_spend", "avg_basket_size",
          "avg_gap", "std_gap", "min_gap", "max_gap", "last_gap", "monetary_trend", "gap_acceleration", "recency_ratio", "total_spend_log", "avg_spend_log"]
_ROUNDED = {"std_spend", "avg_items_per_visit", "avg_gap", "std_gap", "gap_acceleration", "recency_ratio", "total_spend_log", "avg_spend_log"}


@query("d07_behaviour_features", "SELECT customer_id, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _ROUNDED else c for c in BEHAVE) + " FROM behave")
def behaviour_features(spark, sf):
    out = features.behaviour(invoices(spark, sf)).select("customer_id", *BEHAVE)
    return out.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query("d08_customer_dates", """SELECT customer_id, first_purchase, last_purchase,
  CAST(floor((epoch_us(last_purchase) - epoch_us(first_purchase)) / 86400000000.0) AS INTEGER) AS duration, recency AS days_since_last FROM summary""")
def customer_dates(spark, sf):
    from tenure.operators import survival
    tx = lines(spark, sf)
    return survival.customer_dates(tx, features.observation_end(tx))


@query("d09_holdout_spend", f"SELECT customer_id, {MONEY} AS actual_clv_6m FROM tx, cut WHERE invoice_date > cutoff GROUP BY 1")
def holdout_spend(spark, sf):
    return labels.holdout_spend(labels.cutoff_split(lines(spark, sf))[1])


@query("d10_first_invoice_monetary", f"""SELECT customer_id, {MONEY} AS first_total_spend, round(avg(price), 8) AS first_avg_price, max(price) AS first_max_price,
  min(price) AS first_min_price, round(coalesce(stddev_samp(price), 0), 4) AS first_price_std, max(price) - min(price) AS first_price_range,
  round(ln(1 + {MONEY}), 4) AS first_total_spend_log FROM first_lines GROUP BY 1""")
def first_invoice_monetary(spark, sf):
    return features.first_monetary(first_lines(spark, sf)).withColumns({
        "first_avg_price": F.round("first_avg_price", 8), "first_price_std": F.round("first_price_std", 4),
        "first_total_spend_log": F.round("first_total_spend_log", 4)})


@query("d11_first_invoice_basket", """SELECT customer_id, count(stock_code) AS first_num_lines, count(DISTINCT stock_code) AS first_unique_items,
  CAST(sum(quantity) AS BIGINT) AS first_total_qty, round(avg(quantity), 6) AS first_avg_qty, round(sum(quantity) / count(DISTINCT stock_code), 6) AS first_qty_per_unique
  FROM first_lines GROUP BY 1""")
def first_invoice_basket(spark, sf):
    return rounded(features.first_basket(first_lines(spark, sf)))


@query("d12_herfindahl", """SELECT customer_id, round(sum(line_total * line_total) / (sum(line_total) * sum(line_total)), 6) AS first_spend_concentration
  FROM first_lines GROUP BY 1""")
def herfindahl(spark, sf):
    return rounded(features.herfindahl(first_lines(spark, sf)))


@query("d13_first_invoice_temporal", "SELECT customer_id, " + PARTS_SQL.format(t="t", p="first_") +
       " FROM (SELECT customer_id, min(invoice_date) AS t FROM first_lines GROUP BY 1)")
def first_invoice_temporal(spark, sf):
    return features.first_temporal(first_lines(spark, sf))


_GROUP_SQL = "CASE WHEN country = 'NATION_0' THEN 'UK' " + " ".join(f"WHEN country IN {m} THEN '{g}'" for g, m in GROUPS.items()) + " ELSE 'Non_Europe' END"


@query("d14_geo_features", f"""SELECT *, CAST(country = 'NATION_0' AS INTEGER) AS is_uk, CAST(country_group = 'Europe_Other' AS INTEGER) AS "geo_Europe_Other",
  CAST(country_group = 'Non_Europe' AS INTEGER) AS "geo_Non_Europe", CAST(country_group = 'UK' AS INTEGER) AS "geo_UK"
  FROM (SELECT customer_id, country, {_GROUP_SQL} AS country_group FROM (SELECT customer_id, arg_min(country, (invoice_date, country)) AS country FROM first_lines GROUP BY 1))""")
def geo_features(spark, sf):
    return features.geo(first_lines(spark, sf), HOME, GROUPS)


@query("d15_product_flags", "SELECT customer_id, " + ", ".join(
    f"CAST(max(CAST(regexp_matches(upper(coalesce(description, '')), '{p}') AS INTEGER)) AS INTEGER) AS {n}" for n, p in PATTERNS.items()) + " FROM first_lines GROUP BY 1")
def product_flags(spark, sf):
    return features.product_flags(first_lines(spark, sf), PATTERNS)


@query("d16_desc_diversity", "SELECT customer_id, count(DISTINCT split_part(trim(upper(description)), ' ', 1)) AS first_desc_diversity FROM first_lines GROUP BY 1")
def desc_diversity(spark, sf):
    return features.desc_diversity(first_lines(spark, sf))


@query("d17_count_distinct", "SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT invoice) AS invoices, count(DISTINCT country) AS countries, count(DISTINCT stock_code) AS products FROM tx")
def count_distinct(spark, sf):
    return lines(spark, sf).agg(F.count_distinct("customer_id").alias("customers"), F.count_distinct("invoice").alias("invoices"),
                                F.count_distinct("country").alias("countries"), F.count_distinct("stock_code").alias("products"))


def _describe_sql(src, c, label):
    return (f"SELECT '{label}' AS variable, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
            f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, "
            f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {src}")


@query("d18_describe", " UNION ALL ".join(_describe_sql("summary", c, n) for c, n in (("total_spend", "total_spend"), ("recency", "recency"), ("frequency", "frequency"))))
def describe(spark, sf):
    return rounded(report.describe(summary(spark, sf), ["total_spend", "recency", "frequency"]), 4)


@query("d19_percentile_list", "SELECT " + ", ".join(f"quantile_cont(gap_days, {p / 100}) AS p{p}" for p in GAP_PERCENTILES) + " FROM gaps")
def percentile_list(spark, sf):
    return ordered.quantiles(gap_table(spark, sf), "gap_days", [p / 100 for p in GAP_PERCENTILES], [f"p{p}" for p in GAP_PERCENTILES])


@query("d20_value_counts", "SELECT label, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT label, count(*) AS n FROM conv GROUP BY 1)")
def value_counts(spark, sf):
    return rounded(report.value_counts(conversion_labels(spark, sf), "label"))


@query("d21_pivot_counts", """SELECT cohort_month, count(*) FILTER (WHERE label = -1) AS censored, count(*) FILTER (WHERE label = 0) AS one_timer,
  count(*) FILTER (WHERE label = 1) AS repeater FROM (SELECT CAST(date_trunc('month', first_purchase_date) AS DATE) AS cohort_month, label FROM conv) GROUP BY 1""")
def pivot_counts(spark, sf):
    named = conversion_labels(spark, sf).withColumns({
        "cohort_month": S.month_of("first_purchase_date").cast("date"),
        "kind": S.map_values("label", {-1: "censored", 0: "one_timer", 1: "repeater"})})
    return report.pivot_counts(named, "cohort_month", "kind", ["censored", "one_timer", "repeater"])


CTES["seg_risk"] = f"SELECT customer_id, {sql_bins('frequency', *FREQUENCY_BINS)} AS segment, CASE WHEN recency > 45 THEN 'churned' ELSE 'active' END AS risk, frequency, recency, total_spend, age_days FROM summary"


def segment_risk(spark, sf):
    return summary(spark, sf).withColumns({
        "segment": S.bin_right_closed("frequency", *FREQUENCY_BINS),
        "risk": F.when(F.col("recency") > 45, "churned").otherwise("active")})


@query("d22_crosstab", """SELECT coalesce(segment, 'All') AS segment, count(*) FILTER (WHERE risk = 'active') AS active, count(*) FILTER (WHERE risk = 'churned') AS churned,
  count(*) AS "All" FROM seg_risk GROUP BY GROUPING SETS ((segment), ())""")
def crosstab(spark, sf):
    return report.crosstab(segment_risk(spark, sf), "segment", "risk", ["active", "churned"], margins=True)


@query("d22b_crosstab_share", """SELECT segment, round(count(*) FILTER (WHERE risk = 'active') / count(*), 6) AS active,
  round(count(*) FILTER (WHERE risk = 'churned') / count(*), 6) AS churned FROM seg_risk GROUP BY 1""")
def crosstab_share(spark, sf):
    return rounded(report.crosstab(segment_risk(spark, sf), "segment", "risk", ["active", "churned"], normalize=True))


@query("d24_profile_means", """SELECT segment, round(frequency, 6) AS frequency, round(recency, 6) AS recency, round(total_spend, 4) AS total_spend,
  round(frequency / max(frequency) OVER (), 6) AS frequency_rel, round(recency / max(recency) OVER (), 6) AS recency_rel, round(total_spend / max(total_spend) OVER (), 6) AS total_spend_rel
  FROM (SELECT segment, avg(frequency) AS frequency, avg(recency) AS recency, avg(total_spend) AS total_spend FROM seg_risk GROUP BY 1)""")
def profile_means(spark, sf):
    return rounded(report.profile(segment_risk(spark, sf), "segment", ["frequency", "recency", "total_spend"]), total_spend=4)


@query("d24b_profile_median", "SELECT segment, quantile_cont(recency, 0.5) AS recency_median FROM seg_risk GROUP BY 1")
def profile_median(spark, sf):
    return ordered.quantiles(segment_risk(spark, sf), "recency", [0.5], ["recency_median"], by=["segment"])


@query("d26_spend_variability", """SELECT customer_id, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS spend_mean, count(*) AS n_invoices,
  round(coalesce(stddev_samp(revenue) / greatest(avg(revenue), 1), 0), 6) AS spend_cv FROM inv GROUP BY 1""")
def spend_variability(spark, sf):
    return features.spend_cv(invoices(spark, sf)).withColumn("spend_cv", F.round("spend_cv", 6))


@query("d27_cohort_composition", "SELECT CAST(date_trunc('month', first_purchase_date) AS DATE) AS cohort_month, label, count(*) AS n FROM conv GROUP BY 1, 2")
def cohort_composition(spark, sf):
    return labels.cohort_mix(conversion_labels(spark, sf))


def _overview_sql(stage, src):
    return (f"SELECT '{stage}' AS stage, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, count(DISTINCT invoice) AS n_invoices, "
            f"min(invoice_date) AS first_date, max(invoice_date) AS last_date FROM {src}")


@query("d28_dataset_overview", " UNION ALL ".join(_overview_sql(s, t) for s, t in (
    ("raw", "tx_raw"), ("identified", "(SELECT * FROM tx_raw WHERE customer_id IS NOT NULL)"),
    ("uncancelled", "(SELECT * FROM tx_raw WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C'))"), ("clean", "tx"))))
def dataset_overview(spark, sf):
    r = raw(spark, sf)
    identified = clean.drop_null_key(r)
    return clean.funnel({"raw": r, "identified": identified, "uncancelled": clean.drop_cancelled(identified), "clean": lines(spark, sf)})


# Windows, ranking, top-k --------------------------------------------------------


@query("e01_lag_gap", "SELECT * FROM gaps")
def lag_gap(spark, sf):
    return gap_table(spark, sf)


@query("e01b_event_gap_hours", """SELECT user_id, event_id, gap_hours FROM (
  SELECT user_id, event_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000.0) AS INTEGER) AS gap_hours FROM events) WHERE gap_hours IS NOT NULL""")
def event_gap_hours(spark, sf):
    prev = ordered.previous_time(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")
    return prev.where("prev_ts IS NOT NULL").select("user_id", "event_id", S.elapsed("prev_ts", "ts", 3_600_000_000).alias("gap_hours"))


@query("e02_nth_purchase", "SELECT * FROM cp")
def nth_purchase(spark, sf):
    return labels.first_second(dates(spark, sf))


@query("e03_first_row_per_key", "SELECT customer_id, arg_min(invoice, (ts, invoice)) AS invoice, min(ts) AS first_ts FROM inv GROUP BY 1")
def first_row(spark, sf):
    return features.first_invoice(dates(spark, sf))


@query("e04_last_value_per_key", "SELECT customer_id, arg_max(revenue, (ts, invoice)) AS last_revenue FROM inv GROUP BY 1")
def last_value(spark, sf):
    return features.last_by(invoices(spark, sf), "revenue", ["ts", "invoice"])


@query("e05_rank_average", """SELECT customer_id, frequency, round(rk + (n - 1) / 2.0, 6) AS freq_rank FROM (
  SELECT customer_id, frequency, rank() OVER (ORDER BY frequency DESC) AS rk, count(*) OVER (PARTITION BY frequency) AS n FROM summary)""")
def rank_average(spark, sf):
    return rounded(ordered.with_rank(summary(spark, sf).select("customer_id", "frequency"), "frequency", "freq_rank", descending=True))


@query("e06_cumulative_sum", """SELECT total_spend, CAST(sum(n) OVER (ORDER BY total_spend DESC) AS BIGINT) AS cum_n, CAST(sum(pos) OVER (ORDER BY total_spend DESC) AS BIGINT) AS cum_pos
  FROM (SELECT total_spend, count(*) AS n, sum(CAST(frequency > 0 AS INTEGER)) AS pos FROM summary GROUP BY 1)""")
def cumulative_sum(spark, sf):
    out = ordered.prefix_sum(summary(spark, sf), "total_spend", {"n": F.lit(1), "pos": (F.col("frequency") > 0).cast("int")}, descending=True)
    return out.select("total_spend", "cum_n", "cum_pos")


@query("e07_top_n", "SELECT customer_id, num_invoices, total_spend FROM summary ORDER BY total_spend DESC, customer_id LIMIT 20")
def top_n(spark, sf):
    return ordered.top_n(summary(spark, sf), "total_spend", 20, "customer_id", ["customer_id", "num_invoices", "total_spend"])


@query("e08_sort_output", "SELECT customer_id, recency, total_spend FROM summary ORDER BY recency, total_spend DESC, customer_id")
def sort_output(spark, sf):
    return summary(spark, sf).select("customer_id", "recency", "total_spend").orderBy("recency", F.desc("total_spend"), "customer_id")


@query("e09_arg_extreme", "SELECT segment, customer_id, total_spend FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY total_spend DESC, customer_id) AS rn FROM seg_risk) WHERE rn = 1")
def arg_extreme(spark, sf):
    return ordered.arg_best(segment_risk(spark, sf), "total_spend", ["customer_id"], by=["segment"])


@query("e10_nearest_to_stat", """SELECT segment, customer_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY abs(recency - med), customer_id) AS rn
  FROM seg_risk JOIN (SELECT segment, quantile_cont(recency, 0.5) AS med FROM seg_risk GROUP BY 1) USING (segment)) WHERE rn = 1""")
def nearest_to_stat(spark, sf):
    base = segment_risk(spark, sf).select("customer_id", "segment", "recency")
    med = ordered.quantiles(base, "recency", [0.5], ["med"], by=["segment"])
    return ordered.nearest_row(base.join(med, "segment"), "recency", F.col("med"), ["customer_id", "recency"], by=["segment"])


@query("e11_fold_assign", "SELECT customer_id, CAST(ntile(5) OVER (ORDER BY customer_id) AS INTEGER) AS fold FROM summary")
def fold_assign(spark, sf):
    return ordered.folds(dates(spark, sf).select("customer_id").distinct(), "customer_id", 5)


@query("e11b_fold_stratified_sizes", """SELECT churned, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM (
  SELECT churned, ntile(5) OVER (PARTITION BY churned ORDER BY customer_id) AS fold
  FROM (SELECT customer_id, CAST(recency > 45 AS INTEGER) AS churned FROM summary)) GROUP BY 1, 2""")
def fold_stratified(spark, sf):
    base = summary(spark, sf).select("customer_id", (F.col("recency") > 45).cast("int").alias("churned"))
    out = ordered.folds(base, "customer_id", 5, how="stratified", label="churned")
    return out.groupBy("churned", "fold").agg(F.count("*").alias("n"))


# Set operations ---------------------------------------------------------------


@query("f01_union_all", """SELECT customer_id, CASE WHEN frequency > 0 THEN recency END AS recency, CASE WHEN frequency > 0 THEN 'repeat' ELSE 'one-timer' END AS kind FROM summary""")
def union_all(spark, sf):
    base = summary(spark, sf)
    repeat = base.where("frequency > 0").select("customer_id", "recency", F.lit("repeat").alias("kind"))
    single = base.where("frequency = 0").select("customer_id", F.lit("one-timer").alias("kind"))
    return repeat.unionByName(single, allowMissingColumns=True)


def _overlap_sql(k):
    return (f"SELECT CAST({k} AS BIGINT) AS k, count(*) AS overlap FROM (SELECT customer_id FROM summary ORDER BY total_spend DESC, customer_id LIMIT {k}) "
            f"JOIN (SELECT customer_id FROM summary ORDER BY frequency DESC, customer_id LIMIT {k}) USING (customer_id)")


@query("f02_topk_overlap", f"({_overlap_sql(50)}) UNION ALL ({_overlap_sql(100)})")
def topk_overlap(spark, sf):
    base = summary(spark, sf)
    return ordered.topk_overlap(base, "total_spend", "frequency", 50, "customer_id").union(
        ordered.topk_overlap(base, "total_spend", "frequency", 100, "customer_id"))


# Labels and splits ------------------------------------------------------------


@query("g01_churn_labels", "SELECT customer_id, recency, " + ", ".join(f"CAST(recency > {w} AS INTEGER) AS churn_{w}" for w in CHURN_WINDOWS) + " FROM summary")
def churn_labels(spark, sf):
    return labels.churn(summary(spark, sf).select("customer_id", "recency"))


@query("g01b_churn_rates", " UNION ALL ".join(f"SELECT {w} AS window_days, count(*) FILTER (WHERE recency > {w}) AS churned, count(*) AS n, round(count(*) FILTER (WHERE recency > {w}) * 100.0::DOUBLE / count(*), 6) AS churn_pct FROM summary" for w in CHURN_WINDOWS))
def churn_rates(spark, sf):
    return rounded(labels.churn_rates(summary(spark, sf)))


@query("g02_label_stability", " UNION ALL ".join(
    f"SELECT {a} AS window_a, {b} AS window_b, count(*) FILTER (WHERE (recency > {a}) != (recency > {b})) AS flipped, count(*) FILTER (WHERE recency > {a} AND recency <= {b}) AS rescued, "
    f"round(count(*) FILTER (WHERE (recency > {a}) = (recency > {b})) * 100.0::DOUBLE / count(*), 6) AS agreement_pct FROM summary" for a, b in zip(CHURN_WINDOWS, CHURN_WINDOWS[1:])))
def label_stability(spark, sf):
    return rounded(labels.stability(summary(spark, sf)))


@query("g03_label_confusion", " UNION ALL ".join(
    f"SELECT {w} AS window_days, CAST(recency > 45 AS INTEGER) AS ref_label, CAST(recency > {w} AS INTEGER) AS other_label, count(*) AS n FROM summary GROUP BY 2, 3" for w in (30, 40, 50, 60)))
def label_confusion(spark, sf):
    return labels.confusion(summary(spark, sf))


@query("g04_conversion_label", "SELECT customer_id, total_invoices, obs_days, days_to_second, label FROM conv")
def conversion_label(spark, sf):
    return conversion_labels(spark, sf).select("customer_id", "total_invoices", "obs_days", "days_to_second", "label")


@query("g05_window_sensitivity", " UNION ALL ".join(
    f"SELECT {w} AS window_days, rep + one AS labeled, one AS one_timers, rep AS repeaters, n - rep - one AS censored, round(rep * 100.0::DOUBLE / (rep + one), 6) AS repeater_pct FROM ("
    f"SELECT count(*) AS n, count(*) FILTER (WHERE total_invoices > 1) AS rep, count(*) FILTER (WHERE total_invoices = 1 AND obs_days >= {w}) AS one FROM conv)" for w in (45, 60, 90, 120)))
def window_sensitivity(spark, sf):
    return rounded(labels.sensitivity(conversion_labels(spark, sf)))


@query("g06_temporal_split", """SELECT customer_id, label, CASE WHEN first_purchase_date < cutoff THEN 'train' ELSE 'test' END AS split FROM conv, cut, obs
  WHERE label >= 0 AND (first_purchase_date < cutoff OR first_purchase_date <= obs_end - INTERVAL 90 DAY)""")
def temporal_split(spark, sf):
    tx = lines(spark, sf)
    labeled = conversion_labels(spark, sf).where("label >= 0")
    out = labels.temporal_split(labeled, labels.cutoff_date(tx), features.observation_end(tx))
    return out.select("customer_id", "label", "split")


@query("g06b_split_check", """SELECT count(*) FILTER (WHERE s = 'train') AS n_train, count(*) FILTER (WHERE s = 'test') AS n_test, max(CASE WHEN s = 'train' THEN d END) AS train_last, min(CASE WHEN s = 'test' THEN d END) AS test_first
  FROM (SELECT first_purchase_date AS d, CASE WHEN first_purchase_date < cutoff THEN 'train' WHEN first_purchase_date <= obs_end - INTERVAL 90 DAY THEN 'test' END AS s FROM conv, cut, obs WHERE label >= 0) WHERE s IS NOT NULL""")
def split_check(spark, sf):
    tx = lines(spark, sf)
    labeled = conversion_labels(spark, sf).where("label >= 0")
    return labels.assert_no_overlap(labels.temporal_split(labeled, labels.cutoff_date(tx), features.observation_end(tx)))


@query("g07_cutoff_split", "SELECT CASE WHEN invoice_date <= cutoff THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, count(DISTINCT customer_id) AS customers, max(invoice_date) AS last_date FROM tx, cut GROUP BY 1")
def cutoff_split(spark, sf):
    train, holdout = labels.cutoff_split(lines(spark, sf))
    def one(df, name):
        return df.agg(F.count("*").alias("n"), F.count_distinct("customer_id").alias("customers"), F.max("invoice_date").alias("last_date")).select(F.lit(name).alias("part"), "*")
    return one(train, "train").unionByName(one(holdout, "holdout"))


@query("g09_random_split")
def random_split(spark, sf):
    return labels.split(summary(spark, sf).select("customer_id", "recency"), test=0.2)


@query("g09b_stratified_split_sizes", """SELECT churned, count(*) AS n, CAST(round(count(*) * 0.25::DOUBLE) AS BIGINT) AS n_test FROM (SELECT CAST(recency > 45 AS INTEGER) AS churned FROM summary) GROUP BY 1""")
def stratified_split(spark, sf):
    base = summary(spark, sf).select("customer_id", (F.col("recency") > 45).cast("int").alias("churned"))
    out = labels.split(base, test=0.25, stratify="churned")
    return out.groupBy("churned").agg(F.count("*").alias("n"), F.sum((F.col("split") == "test").cast("long")).alias("n_test"))


@query("g10_one_timer_split", "SELECT customer_id, CASE WHEN frequency = 0 THEN 'one-timer' ELSE 'repeat' END AS part FROM summary")
def one_timer_split(spark, sf):
    from tenure.operators import btyd
    repeat, single = btyd.split_one_timers(summary(spark, sf))
    return repeat.select("customer_id", F.lit("repeat").alias("part")).unionByName(single.select("customer_id", F.lit("one-timer").alias("part")))
