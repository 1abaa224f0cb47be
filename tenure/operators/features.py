"""Customer, invoice and first-invoice features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.constants import COUNTRY_GROUPS, HOME_COUNTRY, PRODUCT_PATTERNS
from tenure.functions.scalars import (
    country_group, date_parts, elapsed_days, first_token, matches, minus_months, money_sum,
    ratio_or, safe_ratio,
)
from tenure.operators.ordered import previous_time, quantiles

KEY = "customer_id"


def observation_end(tx: DataFrame, ts: str = "invoice_date") -> Column:
    """Latest transaction time, as a scalar subquery."""
    return tx.agg(F.max(ts)).scalar()


def invoices(tx: DataFrame) -> DataFrame:
    """One row per (customer, invoice)."""
    return tx.groupBy(KEY, "invoice").agg(
        F.min("invoice_date").alias("ts"),
        money_sum("line_total").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.count_distinct("stock_code").alias("n_items"),
        F.count("*").alias("n_lines"),
    )


def invoice_dates(tx: DataFrame) -> DataFrame:
    """Only the date of each invoice: the narrow input of the gap operators."""
    return tx.groupBy(KEY, "invoice").agg(F.min("invoice_date").alias("ts"))


def gaps(inv: DataFrame) -> DataFrame:
    """Elapsed-day gap to the previous invoice; first invoices drop out."""
    prev = previous_time(inv.select(KEY, "invoice", "ts"))
    return prev.where(F.col("prev_ts").isNotNull()).withColumn(
        "gap_days", elapsed_days("prev_ts", "ts"))


def gap_stats(gap: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for a single gap), range and last gap per customer."""
    return gap.groupBy(KEY).agg(
        F.avg("gap_days").alias("avg_gap"),
        F.coalesce(F.stddev_samp("gap_days"), F.lit(0.0)).alias("std_gap"),
        F.min("gap_days").alias("min_gap"),
        F.max("gap_days").alias("max_gap"),
        F.max_by("gap_days", F.struct("ts", "invoice")).alias("last_gap"),
    )


def last_by(df: DataFrame, value: str, order: Sequence[str], key: str = KEY,
            out: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(out or f"last_{value}"))


def first_invoice(inv: DataFrame) -> DataFrame:
    """First invoice per customer by (time, invoice), found by aggregation."""
    return inv.groupBy(KEY).agg(F.min(F.struct("ts", "invoice")).alias("_f")).select(
        KEY, F.col("_f.invoice").alias("invoice"), F.col("_f.ts").alias("first_ts"))


def first_invoice_lines(tx: DataFrame) -> DataFrame:
    ids = first_invoice(invoice_dates(tx))
    return tx.join(ids.select(KEY, "invoice"), [KEY, "invoice"], "left_semi")


def per_customer(tx: DataFrame, distinct: Mapping[str, str]) -> DataFrame:
    """Dates, invoices, lines, spend and quantity per customer, with counts of distinct values.

    Lines roll up to invoices first, so invoices are counted and not made distinct; every other
    count is a roll-up of its own to (customer, value). No line is multiplied before a shuffle.
    """
    bills = tx.groupBy(KEY, "invoice").agg(
        F.min("invoice_date").alias("_from"), F.max("invoice_date").alias("_to"), F.count("invoice").alias("_lines"),
        F.sum(F.col("line_total").cast("decimal(18,4)")).alias("_spend"), F.sum("quantity").alias("_quantity"))
    out = bills.groupBy(KEY).agg(
        F.min("_from").alias("first_purchase"), F.max("_to").alias("last_purchase"), F.count("invoice").alias("num_invoices"),
        F.sum("_lines").alias("num_line_items"), F.sum("_spend").cast("double").alias("total_spend"), F.sum("_quantity").alias("total_quantity"))
    for name, col in distinct.items():
        kinds = tx.where(F.col(col).isNotNull()).select(KEY, col).distinct().groupBy(KEY).agg(F.count("*").alias(name))
        out = out.join(kinds, KEY, "left").fillna(0, [name])
    return out


def customer_summary(tx: DataFrame, obs_end: Column) -> DataFrame:
    """First and last purchase, invoices, spend, quantity, products and derived ratios."""
    agg = per_customer(tx, {"unique_products": "stock_code"}).drop("num_line_items")
    return agg.withColumns({
        "recency": elapsed_days(F.col("last_purchase"), obs_end),
        "T": elapsed_days(F.col("first_purchase"), obs_end),
        "frequency": F.col("num_invoices") - 1,
        "avg_spend": F.col("total_spend") / F.col("num_invoices"),
        "avg_basket": F.col("total_quantity") / F.col("num_invoices"),
    })


def left_fill(df: DataFrame, other: DataFrame, key: str, cols: Sequence[str],
              value: float = 0) -> DataFrame:
    """Left join and fill the joined columns."""
    return df.join(other.select(key, *cols), key, "left").fillna(value, list(cols))


def churn_dataset(tx: DataFrame, obs_end: Column) -> DataFrame:
    """Customer summary with gap statistics and the recency ratio."""
    stats = gap_stats(gaps(invoice_dates(tx)))
    out = left_fill(customer_summary(tx, obs_end), stats, KEY, ["avg_gap", "std_gap", "last_gap"])
    return out.withColumn("recency_ratio", safe_ratio("recency", "T"))


def clv_base(tx: DataFrame, cutoff: Column) -> DataFrame:
    """Training-period customer aggregates with line counts and countries."""
    agg = per_customer(tx, {"unique_products": "stock_code", "num_countries": "country"})
    out = agg.withColumns({
        "recency": elapsed_days(F.col("last_purchase"), cutoff),
        "T": elapsed_days(F.col("first_purchase"), cutoff),
        "frequency": F.col("num_invoices") - 1,
        "avg_spend_per_transaction": F.col("total_spend") / F.col("num_invoices"),
        "avg_basket_size": F.col("total_quantity") / F.col("num_invoices"),
        "avg_items_per_visit": F.col("num_line_items") / F.col("num_invoices"),
    })
    return out.withColumn("recency_ratio", safe_ratio("recency", "T"))


def windowed(tx: DataFrame, cutoff: Column) -> DataFrame:
    """Invoices, spend and quantity of the last 3 months, months 3-6 and the last 6 months.

    One pass: conditional sums per (customer, invoice), then per customer, so invoices
    are counted without a distinct over expanded rows.
    """
    ts = F.col("invoice_date")
    spans = {
        "last_3m": ts > minus_months(cutoff, 3),
        "months_3_to_6": (ts > minus_months(cutoff, 6)) & (ts <= minus_months(cutoff, 3)),
        "last_6m": ts > minus_months(cutoff, 6),
    }
    marked = tx.withColumns({f"_in_{s}": cond for s, cond in spans.items()})
    per_invoice, per_customer = [], []
    for s in spans:
        inside = F.col(f"_in_{s}")
        per_invoice += [
            F.max(inside.cast("int")).alias(f"freq_{s}"),
            F.sum(F.when(inside, F.col("line_total").cast("decimal(18,4)"))).alias(f"monetary_{s}"),
            F.sum(F.when(inside, F.col("quantity"))).alias(f"qty_{s}"),
        ]
        per_customer += [
            F.sum(f"freq_{s}").alias(f"freq_{s}"),
            F.coalesce(F.sum(f"monetary_{s}").cast("double"), F.lit(0.0)).alias(f"monetary_{s}"),
            F.coalesce(F.sum(f"qty_{s}"), F.lit(0)).alias(f"qty_{s}"),
        ]
    out = marked.groupBy(KEY, "invoice").agg(*per_invoice).groupBy(KEY).agg(*per_customer)
    return out.drop("qty_last_6m")


def trends(df: DataFrame) -> DataFrame:
    """Spend and frequency trend, gap acceleration and the one-timer flag."""
    return df.withColumns({
        "monetary_trend": safe_ratio("monetary_last_3m", "monetary_months_3_to_6"),
        "freq_trend": safe_ratio("freq_last_3m", "freq_months_3_to_6"),
        "gap_acceleration": F.coalesce(safe_ratio("last_gap", "avg_gap"), F.lit(0.0)),
        "is_one_timer": (F.col("frequency") == 0).cast("int"),
    }).fillna(0, ["avg_gap", "std_gap", "last_gap"])


def clv_features(tx: DataFrame, cutoff: Column) -> DataFrame:
    """All regression features of the training period.

    One-timers keep NULL shortest and longest gaps; the other gap columns become 0.
    """
    out = clv_base(tx, cutoff).join(windowed(tx, cutoff), KEY)
    out = out.join(gap_stats(gaps(invoice_dates(tx))), KEY, "left")
    return trends(out)


def behaviour(inv: DataFrame) -> DataFrame:
    """Spend, basket and gap dynamics per customer from the invoice roll-up."""
    spend = inv.groupBy(KEY).agg(
        F.count("*").alias("num_transactions"),
        money_sum("revenue").alias("total_spend"),
        F.coalesce(F.stddev_samp("revenue"), F.lit(0.0)).alias("std_spend"),
        F.sum("quantity").alias("total_qty"),
        F.avg("n_items").alias("avg_items_per_visit"),
        F.min("ts").alias("first_purchase"),
        F.max("ts").alias("last_purchase"),
        F.max_by("revenue", F.struct("ts", "invoice")).alias("last_spend"),
    ).withColumns({
        "avg_spend": F.col("total_spend") / F.col("num_transactions"),
        "avg_basket_size": F.col("total_qty") / F.col("num_transactions"),
    })
    gap_cols = ["avg_gap", "std_gap", "min_gap", "max_gap", "last_gap"]
    out = left_fill(spend, gap_stats(gaps(inv)), KEY, gap_cols)
    return out.withColumns({
        "monetary_trend": ratio_or("last_spend", "avg_spend", 1.0),
        "gap_acceleration": F.col("last_gap") - F.col("avg_gap"),
        "recency_ratio": ratio_or("last_gap", "avg_gap", 0.0),
        "total_spend_log": F.log1p("total_spend"),
        "avg_spend_log": F.log1p("avg_spend"),
    })


def spend_cv(inv: DataFrame) -> DataFrame:
    """Variability of invoice spend: deviation over mean, 0 for single invoices."""
    return inv.groupBy(KEY).agg(
        (money_sum("revenue") / F.count("*")).alias("spend_mean"),
        F.stddev_samp("revenue").alias("_sd"),
        F.count("*").alias("n_invoices"),
    ).select(KEY, "spend_mean", "n_invoices",
             F.coalesce(safe_ratio("_sd", "spend_mean"), F.lit(0.0)).alias("spend_cv"))


# First-invoice features -------------------------------------------------------


def _monetary() -> list[Column]:
    return [
        money_sum("line_total").alias("first_total_spend"),
        F.avg("price").alias("first_avg_price"),
        F.max("price").alias("first_max_price"),
        F.min("price").alias("first_min_price"),
        F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("first_price_std"),
        (F.max("price") - F.min("price")).alias("first_price_range"),
        F.log1p(money_sum("line_total")).alias("first_total_spend_log"),
    ]


def _basket() -> list[Column]:
    return [
        F.count("stock_code").alias("first_num_lines"),
        F.count_distinct("stock_code").alias("first_unique_items"),
        F.sum("quantity").alias("first_total_qty"),
        F.avg("quantity").alias("first_avg_qty"),
        (F.sum("quantity") / F.count_distinct("stock_code")).alias("first_qty_per_unique"),
    ]


def _herfindahl(val: str, out: str) -> Column:
    total = F.sum(val)
    return F.when(total == 0, 1.0).otherwise(
        F.try_divide(F.sum(F.col(val) * F.col(val)), total * total)).alias(out)


def first_monetary(first_lines: DataFrame) -> DataFrame:
    return first_lines.groupBy(KEY).agg(*_monetary())


def first_basket(first_lines: DataFrame) -> DataFrame:
    return first_lines.groupBy(KEY).agg(*_basket())


def herfindahl(df: DataFrame, key: str = KEY, val: str = "line_total",
               out: str = "first_spend_concentration") -> DataFrame:
    """Sum of squared spend shares; 1 where the total is 0."""
    return df.groupBy(key).agg(_herfindahl(val, out))


def first_temporal(first_lines: DataFrame) -> DataFrame:
    first = first_lines.groupBy(KEY).agg(F.min("invoice_date").alias("_ts"))
    return first.select(KEY, *[c.alias(n) for n, c in date_parts("_ts", "first_").items()])


def geo(first_lines: DataFrame, home: str = HOME_COUNTRY,
        groups: Mapping[str, Sequence[str]] = COUNTRY_GROUPS) -> DataFrame:
    """Home flag, country group and group indicators with the first level dropped."""
    one = first_lines.groupBy(KEY).agg(
        F.min_by("country", F.struct("invoice_date", "country")).alias("country"))
    out = one.withColumns({
        "is_uk": (F.col("country") == home).cast("int"),
        "country_group": country_group("country", home, groups),
    })
    levels = sorted(["UK", "Non_Europe", *groups])[1:]
    return out.withColumns({f"geo_{v}": (F.col("country_group") == v).cast("int") for v in levels})


def product_flags(first_lines: DataFrame,
                  patterns: Mapping[str, str] = PRODUCT_PATTERNS) -> DataFrame:
    return first_lines.groupBy(KEY).agg(
        *[F.max(matches("description", p).cast("int")).alias(n) for n, p in patterns.items()])


def desc_diversity(first_lines: DataFrame) -> DataFrame:
    return first_lines.groupBy(KEY).agg(
        F.count_distinct(first_token("description")).alias("first_desc_diversity"))


def assemble(*groups: DataFrame, key: str = KEY) -> DataFrame:
    """Left join feature groups that share a key."""
    return reduce(lambda a, b: a.join(b, key, "left"), groups)


def first_invoice_features(tx: DataFrame, home: str = HOME_COUNTRY,
                           groups: Mapping[str, Sequence[str]] = COUNTRY_GROUPS,
                           patterns: Mapping[str, str] = PRODUCT_PATTERNS) -> DataFrame:
    """The conversion model's features in a single grouping of first-invoice lines."""
    lines = first_invoice_lines(tx)
    agg = lines.groupBy(KEY).agg(
        *_monetary(), *_basket(), _herfindahl("line_total", "first_spend_concentration"),
        F.min("invoice_date").alias("_ts"),
        F.min_by("country", F.struct("invoice_date", "country")).alias("country"),
        *[F.max(matches("description", p).cast("int")).alias(n) for n, p in patterns.items()],
        F.count_distinct(first_token("description")).alias("first_desc_diversity"),
    )
    out = agg.withColumns(date_parts("_ts", "first_")).withColumns({
        "is_uk": (F.col("country") == home).cast("int"),
        "_group": country_group("country", home, groups),
    })
    levels = sorted(["UK", "Non_Europe", *groups])[1:]
    out = out.withColumns({f"geo_{v}": (F.col("_group") == v).cast("int") for v in levels})
    return out.drop("_ts", "_group", "country", "first_total_spend", "first_min_price")


def update_from(df: DataFrame, sub: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Write a subset's values back by key; other rows keep theirs."""
    new = sub.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = df.join(new, key, "left").withColumns(
        {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in df.columns else F.col(f"_new_{c}")
         for c in cols})
    return out.drop(*[f"_new_{c}" for c in cols])


def with_labels(features: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    return features.join(labels, key, "inner")


def bin_equal_width(df: DataFrame, col: str, n: int, out: str = "bin") -> DataFrame:
    """1..n equal-width bins over the observed range, closed on the right."""
    span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    width = (span["hi"] - span["lo"]) / n
    k = F.when(width == 0, 1).otherwise(F.greatest(
        F.lit(1), F.ceil(F.try_divide(F.col(col) - span["lo"], width)).cast("int")))
    return df.withColumn(out, F.least(F.lit(n), k).cast("int"))


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None,
              by: Sequence[str] = (), clip_quantile: float | None = None,
              density: bool = False) -> DataFrame:
    """Counts per fixed bin; the last bin includes the upper edge.

    Bounds default to the observed range; ``clip_quantile`` lowers values above that
    quantile onto it first.
    """
    if clip_quantile is not None:
        top = quantiles(df, col, [clip_quantile], ["q"]).scalar()
        df = df.withColumn(col, F.when(F.col(col).isNotNull(), F.least(F.col(col), top)))
    if lo is None or hi is None:
        bounds = df.agg(F.struct(F.min(col).cast("double").alias("lo"),
                                 F.max(col).cast("double").alias("hi")).alias("s")).scalar()
    else:
        bounds = F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    rows = df.select(*by, F.col(col).cast("double").alias("_v"), bounds.alias("_b"))
    v, low, high = F.col("_v"), F.col("_b.lo"), F.col("_b.hi")
    rows = rows.where(v.isNotNull() & (v >= low) & (v <= high))
    # a single-valued column falls into the first bin
    k = F.when(high > low, F.least(F.lit(bins), F.floor(
        F.try_divide((v - low) * bins, high - low)).cast("int") + 1)).otherwise(1)
    counts = rows.groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))
    if not density:
        return counts
    total = rows.groupBy(*by).agg(F.count("*").alias("_total"), F.first("_b").alias("_b"))
    if by:
        joined = counts.join(total, list(by))
    else:
        joined = counts.withColumn("_x", total.select(F.struct("_total", "_b").alias("x")).scalar()).select(
            "bin", "n", "_x._total", "_x._b")
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    return joined.withColumn("density", F.try_divide(
        F.col("n").cast("double"), F.col("_total") * width)).drop("_total", "_b")
