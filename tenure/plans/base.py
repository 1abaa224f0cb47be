"""Registry of queries and the shared inputs they start from.

The retail log the operators work on is derived from the whole order tables: every line
item is a transaction line. A share of the keys is turned into dirt (missing ids,
cancellations, negative quantities, exact copies), some orders belong to guests who buy
once, and accounts change their id at some date, which gives one-timers and drop-out.
``CTES`` states the same derivation as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators import clean, features
from tenure.session import written_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

HOME = "NATION_0"
GROUPS = {
    "Europe_Major": ("NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5"),
    "Europe_Other": ("NATION_6", "NATION_7", "NATION_8"),
}
PATTERNS = {
    "has_christmas": "RING|GEAR",
    "has_gift": "BOLT|NUT",
    "has_vintage": "PLATE|WIDGET",
    "has_heart": "RED|BLUE",
}


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can state it, its oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def with_ctes(body: str) -> str:
    """Prefix a statement with the named tables it uses, in dependency order."""
    ordered: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            used = re.search(rf"(\bFROM|\bJOIN|,)\s+{name}\b(?!\.)", text)
            if used and name not in ordered and name not in open_names:
                open_names.add(name)
                visit(CTES[name])
                ordered.append(name)

    visit(body)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{body}"


CTES["tx_base"] = """
SELECT CASE WHEN l_returnflag = 'R' AND l_orderkey % 5 = 0 THEN 'C' ELSE '' END
         || CAST(l_orderkey AS VARCHAR) AS invoice,
       CAST(l_partkey AS VARCHAR) AS stock_code,
       p_name AS description,
       CAST(CASE WHEN l_orderkey % 41 = 0 AND l_linenumber = 1
                 THEN -l_quantity ELSE l_quantity END AS INTEGER) AS quantity,
       o_orderdate + to_minutes(CAST(l_orderkey * 7919 % 1440 AS INTEGER)) AS invoice_date,
       l_extendedprice / l_quantity AS price,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL
            WHEN l_orderkey % 10 = 7 THEN 1000000000 + l_orderkey
            WHEN date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) > o_custkey * 613 % 2400
            THEN 500000000 + o_custkey
            ELSE o_custkey END AS customer_id,
       n_name AS country,
       l_orderkey AS order_key
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN part ON l_partkey = p_partkey
              JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey"""
CTES["tx_raw"] = """
SELECT * EXCLUDE (order_key) FROM tx_base
UNION ALL SELECT * EXCLUDE (order_key) FROM tx_base WHERE order_key % 100 = 13"""
CTES["tx"] = """
SELECT *, quantity * price AS line_total FROM (
  SELECT DISTINCT * FROM tx_raw
  WHERE customer_id IS NOT NULL AND NOT starts_with(invoice, 'C') AND quantity > 0 AND price > 0)"""
CTES["tx_cap"] = """
SELECT * FROM tx WHERE line_total <= (SELECT quantile_cont(line_total, 0.999) FROM tx)"""
CTES["obs"] = "SELECT max(invoice_date) AS obs_end FROM tx"
CTES["inv"] = """
SELECT customer_id, invoice, min(invoice_date) AS ts,
       CAST(sum(CAST(line_total AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
       CAST(sum(quantity) AS BIGINT) AS quantity, count(DISTINCT stock_code) AS n_items,
       count(*) AS n_lines
FROM tx GROUP BY 1, 2"""
CTES["gaps"] = """
SELECT customer_id, invoice, ts, prev_ts,
       CAST(floor((epoch_us(ts) - epoch_us(prev_ts)) / 86400000000.0) AS INTEGER) AS gap_days
FROM (SELECT customer_id, invoice, ts,
             lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, invoice) AS prev_ts FROM inv)
WHERE prev_ts IS NOT NULL"""
CTES["gap_stats"] = """
SELECT customer_id, avg(gap_days) AS avg_gap, coalesce(stddev_samp(gap_days), 0) AS std_gap,
       min(gap_days) AS min_gap, max(gap_days) AS max_gap,
       arg_max(gap_days, (ts, invoice)) AS last_gap
FROM gaps GROUP BY 1"""
CTES["summary"] = """
SELECT *, CAST(floor((epoch_us(obs_end) - epoch_us(last_purchase)) / 86400000000.0) AS INTEGER) AS recency,
       CAST(floor((epoch_us(obs_end) - epoch_us(first_purchase)) / 86400000000.0) AS INTEGER) AS age_days,
       num_invoices - 1 AS frequency, total_spend / num_invoices AS avg_spend,
       total_quantity / num_invoices AS avg_basket
FROM (SELECT customer_id, min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase,
             count(DISTINCT invoice) AS num_invoices,
             CAST(sum(CAST(line_total AS DECIMAL(18,4))) AS DOUBLE) AS total_spend,
             CAST(sum(quantity) AS BIGINT) AS total_quantity,
             count(DISTINCT stock_code) AS unique_products
      FROM tx GROUP BY 1), obs"""
CTES["first_lines"] = """
SELECT tx.* FROM tx JOIN (
  SELECT customer_id, invoice FROM (
    SELECT customer_id, invoice, row_number() OVER (PARTITION BY customer_id ORDER BY ts, invoice) AS rn
    FROM inv) WHERE rn = 1) f USING (customer_id, invoice)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """All line items as raw transaction lines, dirt included, without the product's description.

    Orders meet their customer and country before the lines, of which there are more; the keys of order and part stay.
    """
    key = F.col("l_orderkey")
    orders = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    cancelled = (F.col("l_returnflag") == "R") & (key % 5 == 0)
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    copies = F.when(key % 100 == 13, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return table(spark, sf, "lineitem").join(orders, key == F.col("o_orderkey")).select(
        key.alias("order_key"),
        F.col("l_partkey").alias("part_key"),
        F.concat(F.when(cancelled, "C").otherwise(""), key.cast("string")).alias("invoice"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.when((key % 41 == 0) & (F.col("l_linenumber") == 1), -F.col("l_quantity"))
        .otherwise(F.col("l_quantity")).cast("int").alias("quantity"),
        F.expr("o_orderdate + make_dt_interval(0, 0, cast(l_orderkey * 7919 % 1440 as int))")
        .alias("invoice_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(key % 97 == 0, F.lit(None).cast("long"))
        .when(key % 10 == 7, key + 1_000_000_000)
        .when(days > F.col("o_custkey") * 613 % 2400, F.col("o_custkey") + 500_000_000)
        .otherwise(F.col("o_custkey")).alias("customer_id"),
        F.col("n_name").alias("country"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def described(sold: DataFrame, products: DataFrame) -> DataFrame:
    """Sold lines with the description of their product."""
    return sold.join(products, F.col("part_key") == F.col("p_partkey")).select(
        "invoice", "stock_code", F.col("p_name").alias("description"), "quantity", "invoice_date", "price", "customer_id", "country")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """All line items as raw transaction lines, dirt included."""
    return described(sales(spark, sf), table(spark, sf, "part"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned lines before the outlier rule and without totals.

    Distinct lines of distinct products are distinct, as lines hold the product's key. So lines are made distinct before they
    get a description: where they lie after the join with their order, and without the text.
    """
    products = table(spark, sf, "part").select("p_partkey", "p_name").distinct()
    return described(clean.clean(sales(spark, sf), outlier="none"), products)


_LINES: dict[tuple, tuple] = {}


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned lines before the outlier rule, written once for all queries of a session on the same files.

    Totals are products of two columns and are not stored. The key holds length and time of the source tables, so tables that were written anew are cleaned anew.
    """
    key = [spark.sparkContext.applicationId, sf]
    for name in ("lineitem", "orders", "part", "customer", "nation"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        key += [status.getLen(), status.getModificationTime()]
    if tuple(key) not in _LINES:
        kept = cleaned(spark, sf)
        _LINES[tuple(key)] = kept.schema, written_path(kept)
    schema, path = _LINES[tuple(key)]
    return clean.line_total(spark.read.schema(schema).parquet(path))


def capped(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean(raw(spark, sf), outlier="quantile")


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    return features.invoices(lines(spark, sf))


def dates(spark: SparkSession, sf: str) -> DataFrame:
    return features.invoice_dates(lines(spark, sf))


def gap_table(spark: SparkSession, sf: str) -> DataFrame:
    return features.gaps(dates(spark, sf))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    tx = lines(spark, sf)
    return features.customer_summary(tx, features.observation_end(tx))


def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    return features.first_invoice_lines(lines(spark, sf))


def rounded(df: DataFrame, digits: int = 6, **overrides: int) -> DataFrame:
    """Round every double column, so engines that add in another order agree."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, overrides.get(c, digits)) for c in doubles})
